"""Language-model scores by deleted interpolation of n-grams, up to trigrams.

Probability of a token w after (u, v): with P2 = a2 c(vw)/c(v) + a1 c(w)/N + a0/(V + 1), it's b3 c(uvw)/c(uv) + (1 - b3) P2.
The weights a depend on the bucket of c(v), b on that of c(uv) (powers of two); both come from
expectation-maximisation on held-out counts: one part of the training documents (`fold` 1) is left out of the counts
that its tokens are judged by. The statistics that EM needs are summed into cells (context bucket, steps of a quarter
octave of two estimates), whose number is bounded at any corpus size.

Counts are exact over all training documents, by 64-bit word hashes and keys of 48 bits and more within a bucket.

Defined cases: a null text counts as empty (its end token alone); without training documents all counts are 0; rows
that repeat are scored each by itself; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm import exchange, shared, tokens

TRAIN, HELD, TEST = 0, 1, 2
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ODD, EVEN = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFE)
#: Largest context bucket, quarter octaves of an estimate.
BUCKETS, STEPS = 48, 160
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Sequence:
    """Tokens of a chunk's documents, each with its end, and the distinct keys: words (even), longer n-grams and the
    contexts before a document's first token (odd)."""

    def __init__(self, chunk: exchange.Chunk, order: int):
        hashes, counts = [], []
        for a, b in tokens.slices(chunk.offsets, tokens.PIECE):
            at = chunk.offsets[a : b + 1]
            _, _, h, bounds = tokens.words(tokens.lower(chunk.data[at[0] : at[-1]]), at - at[0], tokens.SPACE_SEPARATED)
            hashes.append(h)
            counts.append(np.diff(bounds))
        n = np.concatenate(counts) + 1
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        word = np.full(self.bounds[-1], END, dtype=np.uint64)
        ends = np.zeros(len(word), bool)
        ends[self.bounds[1:] - 1] = True
        word[~ends] = np.concatenate(hashes)
        grams, starts = [word & EVEN], []
        for k in range(2, order + 1):
            start = START * np.uint64(k)
            before = np.empty_like(word)
            before[1:] = grams[-1][:-1]
            before[self.bounds[:-1]] = start
            grams.append(tokens.mix(before * np.uint64(0xA0761D6478BD642F) ^ (before >> np.uint64(32)) ^ word * np.uint64(0xE7037ED1A0B428DB)) | ODD)
            starts.append(start | ODD)
        own = [np.unique(g, return_inverse=True, return_counts=True) for g in grams]
        both = np.concatenate([*(u for u, _, _ in own), np.array(starts, dtype=np.uint64)])
        order_ = np.argsort(both, kind="stable")
        place = np.empty_like(order_)
        place[order_] = np.arange(len(order_))
        self.keys = both[order_]
        self.counts = np.concatenate([*(c for _, _, c in own), np.full(len(starts), len(n))])[order_]
        cuts = np.cumsum([0, *(len(u) for u, _, _ in own)])
        #: Number, among the keys, of each token's n-grams, shortest first, and of the contexts at a document's start.
        self.grams = [place[a + inverse] for a, (_, inverse, _) in zip(cuts, own)]
        self.starts = place[cuts[-1] :]

    def context(self, k: int) -> np.ndarray:
        """Numbers of the contexts of the k-grams."""
        out = np.empty_like(self.grams[0])
        out[1:] = self.grams[k - 2][:-1]
        out[self.bounds[:-1]] = self.starts[k - 2]
        return out


def _send(bits: int, order: int):
    def keys(chunk):
        s = Sequence(chunk, order)
        counts = s.counts if chunk.tag != TEST else s.counts * 0
        for bucket, at in exchange.by_bucket(s.keys, bits):
            raw = exchange.six(s.keys[at])
            yield bucket, np.array([chunk.tag, len(raw)], np.int64).tobytes() + raw + exchange.pack(counts[at])

    return keys


def _answer(bucket, rows):
    """Counts over training parts for every row's keys, and the bucket's totals."""
    tags, keys, counts = [], [], []
    for raw in rows["payload"]:
        tag, n = np.frombuffer(raw, np.int64, 2).tolist()
        tags.append(tag)
        keys.append(exchange.from_six(raw[16 : 16 + n]))
        counts.append(exchange.unpack(raw[16 + n :])[0])
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, held = np.concatenate(counts), np.repeat(np.array(tags) == HELD, sizes)
    every = np.bincount(at, n, len(distinct)).astype(np.int64)
    fit = np.bincount(at, np.where(held, 0, n), len(distinct)).astype(np.int64)
    words = (distinct & ODD) == 0
    cuts = np.cumsum([0, *sizes])
    out = [exchange.pack(every[at[a:b]], *([fit[at[a:b]]] if t == HELD else [])) for t, a, b in zip(tags, cuts[:-1], cuts[1:])]
    k = len(out)
    totals = [int(every[words].sum()), int((every[words] > 0).sum()), int(fit[words].sum()), int((fit[words] > 0).sum())]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows["chunk"] + [0], pa.int64()), pa.array([1] * k + [9], pa.int32()), pa.array([bucket] * (k + 1), pa.int32()), pa.array(out + [None], pa.binary()), pa.array(tags + [None], pa.int32()), *(pa.array([None] * k + [x], pa.int64()) for x in totals)],
        names=["chunk", "kind", "bucket", "payload", "tag", "n", "v", "fit_n", "fit_v"],
    )


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS).astype(np.int64)


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(STEPS - 1, np.floor(-4 * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def _estimate(s: Sequence, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of each token's context of k - 1 words, and its maximum-likelihood estimate after it."""
    context = counts[s.context(k)]
    return context, np.where(context > 0, counts[s.grams[k - 1]] / np.maximum(context, 1), 0.0)


def _below(s: Sequence, counts: np.ndarray, weights: list[np.ndarray], total: int, types: int) -> np.ndarray:
    """The interpolated probability under the weights of the orders learned so far (two at least)."""
    context, two = _estimate(s, counts, 2)
    w = weights[0][_bucket(context)]
    p = w[:, 0] * two + w[:, 1] * (counts[s.grams[0]] / max(1, total)) + w[:, 2] / (types + 1)
    for k, own in enumerate(weights[1:], 3):
        context, longer = _estimate(s, counts, k)
        w = own[_bucket(context)]
        p = w[:, 0] * longer + w[:, 1] * p
    return p


def _cells(order: int, weights: list[np.ndarray], total: int, types: int):
    """Held-out tokens by context bucket, the estimate of the next order and what stands below it."""

    def fn(chunk, answers):
        s = Sequence(chunk, order)
        counts = np.concatenate([exchange.unpack(p)[1] for _, _, p in answers])
        context, high = _estimate(s, counts, len(weights) + 2)
        low = _below(s, counts, weights, total, types) if weights else counts[s.grams[0]] / max(1, total)
        cell = (_bucket(context) * (STEPS + 1) + _step(high)) * (STEPS + 1) + _step(low)
        cells, at = np.unique(cell, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": np.bincount(at).astype(np.int64), "high": np.bincount(at, high), "low": np.bincount(at, low)})

    return fn


def learn(cells: list[tuple], uniform: float | None, rounds: int = 60, floor: float = 1e-4) -> np.ndarray:
    """(BUCKETS + 1, 3 or 2) weights of the higher and lower estimate and, if given, the uniform one. A bucket starts
    from, and is smoothed with ten counts of, the weights of all."""
    parts = 2 if uniform is None else 3
    weights = np.full((BUCKETS + 1, parts), 1 / parts)
    if not cells:
        return weights
    cell, n, high, low = (np.array(x, dtype=float) for x in zip(*cells))
    bucket = cell.astype(np.int64) // (STEPS + 1) ** 2
    p = np.stack([high / n, low / n, *([np.full(len(n), uniform)] if uniform is not None else [])], axis=1)

    def rounds_of(own, group, size, prior):
        for _ in range(rounds):
            share = own[group] * p
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            new = np.stack([np.bincount(group, share[:, k], size) for k in range(parts)], axis=1) + 10 * prior
            own = np.maximum(new / new.sum(axis=1, keepdims=True), floor)
            own /= own.sum(axis=1, keepdims=True)
        return own

    everything = rounds_of(weights[:1], np.zeros(len(n), np.int64), 1, weights[:1])
    return rounds_of(np.tile(everything, (BUCKETS + 1, 1)), bucket, BUCKETS + 1, everything)


def _scores(order: int, weights: list[np.ndarray], total: int, types: int):
    def fn(chunk, answers):
        s = Sequence(chunk, order)
        counts = np.concatenate([exchange.unpack(p)[0] for _, _, p in answers])
        score = np.log10(_below(s, counts, weights, total, types))
        c = counts[s.grams[0]]
        base = np.log10((c + 1) / (total + (types + 1)))
        at = s.bounds[:-1]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(chunk.ids, mask=chunk.ids == exchange.NO_ID),
                "held_out": np.full(len(at), chunk.tag == TEST),
                "n_tokens": np.diff(s.bounds),
                "n_known": np.add.reduceat((c > 0).astype(np.int64), at),
                "train_tokens": np.full(len(at), total, np.int64),
                "base_score": np.add.reduceat(base, at),
                "score": np.add.reduceat(score, at),
            }
        )

    return fn


def score(docs: DataFrame, fold: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `fold`: 0 counts, 1 training documents that
    the weights are learned on, 2 not learned from. `order`: words of the longest n-gram, 2 at least."""
    src = exchange.source(docs, fold, id_col, text_col)
    bits = exchange.bucket_bits(src)
    sent = exchange.ask(src, _send(bits, order))
    answers = shared.stored(shared.grouped(sent, "bucket", ["chunk"], _answer, "chunk long, kind int, bucket int, payload binary, tag int, n long, v long, fit_n long, fit_v long"), "counts")
    total, types, fit_total, fit_types = (x or 0 for x in answers.where("kind = 9").agg(F.sum("n"), F.sum("v"), F.sum("fit_n"), F.sum("fit_v")).first())
    answers = answers.where("kind = 1")
    weights: list[np.ndarray] = []
    for k in range(2, order + 1):
        cells = exchange.gather(src, answers.where(F.col("tag") == HELD), _cells(order, weights, fit_total, fit_types), "cell long, n long, high double, low double", tag=HELD)
        cells = cells.groupBy("cell").agg(F.sum("n"), F.sum("high"), F.sum("low")).collect()
        weights.append(learn([tuple(r) for r in cells], 1 / (fit_types + 1) if k == 2 else None))
    return exchange.gather(src, answers, _scores(order, weights, total, types), OUT)
