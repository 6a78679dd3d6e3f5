"""Language identification by word-first backoff.

A model holds, per language, the log10 relative frequency of lower-cased words and of character n-grams (5 down to 1,
words padded with one blank on each side). A known word scores by its word frequencies; an unseen word by the mean of
its n-grams of the longest order of which any is known. A text's score per language is the mean over its words; where
a language lacks a word or n-gram that others have, a fixed penalty stands in.

The model is fitted on a bounded sample: of each of the `languages` most frequent languages, the documents whose hashed
id falls under `docs_per_language` / count. Its size is bounded by these parameters, so it may be collected and broadcast.

Defined cases: null texts and texts without a letter are `und` with score 0; without any training row every text with a
letter is `und`; rows repeat as they do in the input; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared

ORDERS = (5, 4, 3, 2, 1)
#: Bounds of the sample that the model is fitted on: documents of a language (about), and languages.
DOCS_PER_LANGUAGE, LANGUAGES = 1500, 256
PENALTY = 7.0
#: Distinct unseen words whose scores a worker keeps; a speed matter only.
MEMO = 200_000

WORD = re.compile(r"[^\W\d_]+")


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(k))


def letters(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _count(batches):
    for batch in batches:
        counts: dict[tuple, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts.setdefault((lang, 0), Counter()).update(letters(text))
        for (lang, _), words in list(counts.items()):
            for word, c in words.items():
                for n in ORDERS:
                    own = counts.setdefault((lang, n), Counter())
                    for g in ngrams(word, n):
                        own[g] += c
        for (lang, n), own in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "n": pa.array([n] * len(own), pa.int32()), "gram": pa.array(list(own), pa.string()), "c": pa.array(list(own.values()), pa.int64())})


class Model:
    def __init__(self, counts: pa.Table):
        self.langs = sorted(set(counts["lang"].to_pylist()))
        place = {k: i for i, k in enumerate(self.langs)}
        lang = np.array([place[x] for x in counts["lang"].to_pylist()], dtype=np.int64)
        order, c = counts["n"].to_numpy(), counts["c"].to_numpy()
        grams = counts["gram"].to_pylist()
        self.index: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        total = np.zeros((max(ORDERS) + 1, len(self.langs)))
        np.add.at(total, (order, lang), c)
        rows = np.empty(len(grams), dtype=np.int64)
        size = 0
        for i, (n, g) in enumerate(zip(order.tolist(), grams)):
            own = self.index[n]
            at = own.get(g)
            if at is None:
                at = own[g] = size
                size += 1
            rows[i] = at
        self.scores = np.full((size, len(self.langs)), -PENALTY, dtype=np.float32)
        self.scores[rows, lang] = np.maximum(np.log10(c / total[order, lang]), -PENALTY)

    def unseen(self, word: str) -> np.ndarray:
        for n in ORDERS:
            own = self.index[n]
            known = [own[g] for g in ngrams(word, n) if g in own]
            if known:
                return self.scores[known].mean(axis=0)
        return np.full(len(self.langs), -PENALTY, dtype=np.float32)


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the rows with a text and a language, for the `languages` most frequent (ties by name); None if there are
    none. Reads text of the sampled rows only."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    rate = most.select("lang", F.least(F.lit(1.0), docs_per_language / F.col("n")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.coalesce(F.col("id"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(rate), "lang").where(draw < F.col("rate")).select("text", "lang")
    table = sample.mapInArrow(shared.lean(_count), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).toArrow()
    return Model(table) if table.num_rows else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns (the id, if not said), lang_pred and score: the softmax, over languages, of the mean word
    score in natural units. `names` are those of the two new columns; kept columns of these names give way to them."""
    own = {n.lower() for n in names}
    keep = [k for k in ([id_col] if keep is None else keep) if k.lower() not in own]
    held = docs.sparkSession.sparkContext.broadcast(model)
    # Columns go by place: a kept one may have any name.
    source = docs.select(*(docs[k].alias(f"c{i}") for i, k in enumerate(keep)), docs[text_col].cast("string").alias("text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches):
        m = held.value
        known = m.index[0] if m else {}
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, scores = [], []
            for item in batch.column(len(keep)):
                words = letters(item.as_py() or "")
                if not words or m is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.array([known.get(w, -1) for w in words])
                total = m.scores[at[at >= 0]].sum(axis=0, dtype=np.float64)
                for i in np.flatnonzero(at < 0).tolist():
                    w = words[i]
                    s = memo.get(w)
                    if s is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        s = memo[w] = m.unseen(w)
                    total += s
                mean = total / len(words) * math.log(10)
                best = int(mean.argmax())
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return source.mapInArrow(shared.lean(run), schema)
