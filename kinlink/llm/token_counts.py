"""Token counts of byte-level BPE without token ids.

Pieces are counted once per distinct pre-token of the corpus. Documents become pre-token frequencies, and counts are
joined to them and summed. The join has two arms: the `heavy` most frequent pre-tokens (a bounded number) are broadcast
and summed where the text is read; the rest is dealt out by pre-token.

Pre-tokens follow the tokenizer file's byte-level pattern: contractions, letters, numbers, other signs, white space.
Special strings such as the end-of-text mark are handled as the library does by default: each is one token, and the text is cut
there first.

Defined cases: a null text counts as empty (0 tokens); rows that repeat stay apart; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared

#: The byte-level pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAVY = 100_000
#: Distinct pre-tokens that a worker holds before it passes their counts on.
FLUSH = 100_000
#: Documents of an Arrow batch that are held as Python strings at once.
SLICE = 256


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)



@functools.cache
def _splitter(path: str):
    """Text to pre-tokens: special strings are cut out first. Read once in a worker; its tasks are what runs in parallel,
    so the library's own threads, each with its own memory, are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut = regex.compile("|".join(regex.escape(s) for s in specials)) if specials else None
    words = regex.compile(PATTERN)

    def split(text: str) -> list[str]:
        if cut is None or not any(s in text for s in specials):
            return words.findall(text)
        out, at = [], 0
        for m in cut.finditer(text):
            out += words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + words.findall(text[at:])

    return tokenizer, split


def pre_token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(piece, n): each distinct pre-token and how often it occurs."""

    def run(batches):
        _, split = _splitter(path)
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in _slices(batches):
            for text in batch.column(0):
                held.update(split(text.as_py() or ""))
                if len(held) > FLUSH:
                    yield from out()
                    held.clear()
        yield from out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def pieces(counts: DataFrame, path: str) -> DataFrame:
    """(piece, n, k): k tokens in each distinct pre-token, counted once."""

    def run(batches):
        tokenizer, _ = _splitter(path)
        for batch in _slices(batches):
            found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int32())], names=["piece", "n", "k"])

    return counts.mapInArrow(run, "piece string, n long, k int")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    table = shared.stored(pieces(pre_token_counts(docs, path, text_col), path), "pieces")
    # The floor is the heavy-th count, so at most `heavy` pre-tokens stand above it.
    by_count = [(r.n, r["count"]) for r in table.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).collect()]
    floor, above = 1 << 62, 0
    for n, c in by_count:
        if above + c > heavy:
            break
        floor, above = n, above + c
    top = table.where(F.col("n") >= floor).select("piece", "k").toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top["piece"].to_pylist(), top["k"].to_pylist())))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))

    def run(batches):
        _, split = _splitter(path)
        known = common.value
        for batch in _slices(batches):
            sums, tails, freqs = [], [], []
            for text in batch.column("text"):
                own, total, tail, freq = Counter(split(text.as_py() or "")), 0, [], []
                for piece, c in own.items():
                    k = known.get(piece)
                    if k is None:
                        tail.append(piece)
                        freq.append(c)
                    else:
                        total += k * c
                sums.append(total)
                tails.append(tail)
                freqs.append(freq)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(tails, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int64()))], names=["doc_id", "row", "n_bytes", "part", "tail", "freq"])

    read = source.mapInArrow(run, "doc_id long, row long, n_bytes long, part long, tail array<string>, freq array<long>")
    # Each document is a row of its own with no pre-token, then one row for each pre-token of the tail. Pre-tokens are
    # never null in the join: the document's row looks for itself under a key that no pre-token has.
    entry = F.struct(F.concat(F.lit("\u0000doc "), F.col("row").cast("string")).alias("piece"), F.lit(None).cast("long").alias("f"))
    tail = F.transform(F.arrays_zip("tail", "freq"), lambda x: F.struct(x["tail"].alias("piece"), x["freq"].alias("f")))
    flat = read.select("doc_id", "row", "n_bytes", "part", F.explode(F.concat(F.array(entry), tail)).alias("x")).select("doc_id", "row", F.when(F.col("x.f").isNull(), F.col("n_bytes")).alias("n_bytes"), F.when(F.col("x.f").isNull(), F.col("part")).alias("part"), "x.piece", "x.f")
    rare = table.where(F.col("n") < floor).select("piece", "k")
    joined = flat.join(rare, "piece", "left")
    sums = joined.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.count("part").alias("copies"), (F.sum(F.coalesce("part", F.lit(0))) + F.sum(F.coalesce(F.col("f") * F.col("k"), F.lit(0)))).alias("all"))
    one = sums.select("doc_id", "n_bytes", F.expr("`all` div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return one.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
