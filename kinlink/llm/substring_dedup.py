"""Substring dedup over a log-structured fingerprint index.

A repeat is a window of 13 words that also starts in a document with a smaller id. Windows aren't indexed one by one:
each selects the least hash among its 6-word grams (winnowing), so two equal windows select the same fingerprint, and
fingerprints number about two in nine words. (A run of all window hashes would take more room than the texts.)

The index lives in the shared folder. It's a list of immutable runs, each a folder with one row a hash bucket that holds
the bucket's fingerprints in sorted order, with the chunk of documents that each came from; and the chunks themselves,
stored compressed. A new batch is merge-joined with all runs, bucket by bucket: fingerprints met in two documents or
more, history included, are told to the chunks that hold them. Of history, only chunks that were told of a fingerprint
are read again. There the windows that selected it are compared by their own hashes over all words, in buckets again,
which verifies them and finds each window's least document. The batch's entries become a new run; more than `fanout`
runs are compacted to one, and those that went into it are deleted. `save` writes a manifest, from which `reopen` goes on.

Batches should come in order of doc_id: a decision on an earlier batch isn't taken back.

Words are hashed to 64 bits. Defined cases: a null text has no words; documents under 13 words lose nothing; a null
doc_id is less than any other; rows that repeat a doc_id count as the same document; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import exchange, shared, tokens

WINDOW, GRAM = 13, 6
#: Runs that stand side by side; batches and runs of the query, which compacts after its second and third batch.
FANOUT, QUERY_BATCHES, QUERY_FANOUT = 4, 3, 1
OUT = "doc_id long, n_words long, n_removed long, kept string"


class Windows:
    """Of a chunk: words and, of every window, its first word, document, fingerprint hash and own hash."""

    def __init__(self, chunk: exchange.Chunk, window: int = WINDOW, gram: int = GRAM):
        starts, ends, hashes, counts = [], [], [], []
        for a, b in tokens.slices(chunk.offsets, tokens.PIECE):
            at = chunk.offsets[a : b + 1]
            s, e, h, bounds = tokens.words(chunk.data[at[0] : at[-1]], at - at[0], tokens.SPACE_SEPARATED)
            starts.append(s + at[0])
            ends.append(e + at[0])
            hashes.append(h)
            counts.append(np.diff(bounds))
        self.starts, self.ends, self.hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.counts = np.concatenate(counts)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        n = max(0, len(doc) - window + 1)
        whole = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n else np.zeros(0, np.int64)
        g = tokens.grams(self.hashes, gram)
        least, place = g[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, window - gram + 1):
            lower = g[i : n + i] <= least
            least[lower], place[lower] = g[i : n + i][lower], i
        self.first, self.doc = whole, doc[whole] if n else whole
        self.print, self.print_at = least[whole], (whole + place[whole])

    def own(self, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Hashes of the windows numbered `at`."""
        return tokens.grams(self.hashes, window)[self.first[at]] if len(at) else np.zeros(0, np.uint64)


def _prints(bits: int, window: int, gram: int):
    """A chunk's distinct fingerprints, and whether each is in more than one of its documents."""

    def keys(chunk):
        w = Windows(chunk, window, gram)
        once = np.flatnonzero(np.concatenate([[True], w.print_at[1:] != w.print_at[:-1]])) if len(w.print) else np.zeros(0, np.int64)
        h, ids = w.print[once], chunk.ids[w.doc[once]]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        other = np.zeros(len(h), bool)
        other[1:] = ~new[1:] & (ids[1:] != ids[:-1])
        heads = np.flatnonzero(new)
        several = np.logical_or.reduceat(other, heads) if len(heads) else other
        for bucket, at in exchange.by_bucket(h[heads], bits):
            raw = exchange.six(h[heads][at])
            yield bucket, np.array([len(raw)], np.int64).tobytes() + raw + exchange.pack(several[at].astype(np.uint8))

    return keys


def _entries(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    return exchange.from_six(payload[8 : 8 + n]), exchange.unpack(payload[8 + n :])[0].astype(bool)


def _run(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, number of each one's chunk, and the chunks."""
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    owner, ids = exchange.unpack(payload[8 + n :])
    return exchange.from_six(payload[8 : 8 + n]), owner.astype(np.int64), ids


def _as_run(keys: np.ndarray, chunks: np.ndarray) -> bytes:
    order = np.argsort(keys, kind="stable")
    ids, owner = np.unique(chunks, return_inverse=True)
    raw = exchange.six(keys[order])
    return np.array([len(raw)], np.int64).tobytes() + raw + exchange.pack(owner[order].astype(np.uint32), ids)


RUN, TOLD, TOLD_BEFORE = 0, 1, 2
_MERGED = "kind int, chunk long, bucket int, payload binary"


def _merge(bucket, rows):
    """Merge-join of the runs (kind 0) with the batch (kind 1): the batch as a new run, and for each chunk the
    fingerprints in several documents."""
    runs = [_run(p) for k, p in zip(rows["kind"], rows["payload"]) if k == RUN]
    sent = [(c, *_entries(p)) for k, c, p in zip(rows["kind"], rows["chunk"], rows["payload"]) if k != RUN]
    out = []
    if sent:
        keys = np.concatenate([k for _, k, _ in sent])
        distinct, at = np.unique(keys, return_inverse=True)
        places = np.bincount(at, minlength=len(distinct)) + np.bincount(at, np.concatenate([s for _, _, s in sent]), len(distinct))
        met = np.zeros(len(distinct), bool)
        for old, owner, ids in runs:
            x = np.minimum(np.searchsorted(old, distinct), max(0, len(old) - 1))
            met |= old[x] == distinct if len(old) else False
        several = (places > 1) | met
        cut = 0
        for c, k, _ in sent:
            told = k[several[at[cut : cut + len(k)]]]
            cut += len(k)
            if len(told):
                out.append((TOLD, c, exchange.six(told)))
        seen = distinct
        for old, owner, ids in runs:
            x = np.minimum(np.searchsorted(seen, old), len(seen) - 1)
            hit = seen[x] == old
            by = np.argsort(owner[hit], kind="stable")
            mine, told = owner[hit][by], old[hit][by]
            cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(mine)]):
                out.append((TOLD_BEFORE, int(ids[mine[a]]), exchange.six(told[a:b])))
        out.append((RUN, 0, _as_run(keys, np.concatenate([np.full(len(k), c, np.int64) for c, k, _ in sent]))))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["kind", "chunk", "bucket", "payload"])


def _compact(bucket, rows):
    runs = [_run(p) for p in rows["payload"]]
    payload = _as_run(np.concatenate([k for k, _, _ in runs]), np.concatenate([ids[o] for _, o, ids in runs]))
    yield pa.RecordBatch.from_arrays([pa.array([RUN], pa.int32()), pa.array([0], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=["kind", "chunk", "bucket", "payload"])


def _candidates(w: Windows, told: list, bits: int) -> np.ndarray:
    """Numbers of the windows whose fingerprint was told."""
    if not told:
        return np.zeros(0, np.int64)
    known = np.sort(np.concatenate([exchange.from_six(p) | (np.uint64(b) << np.uint64(48)) for b, p in told]))
    own = exchange.short(w.print, bits)
    x = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return np.flatnonzero(known[x] == own)


def _distinct(chunk: exchange.Chunk, w: Windows, at: np.ndarray, window: int):
    """Distinct window hashes of the candidates, sorted; each candidate's number among them; their least documents."""
    h, inverse = np.unique(w.own(at, window), return_inverse=True)
    least = np.full(len(h), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, chunk.ids[w.doc[at]])
    return h, inverse, least


def _windows(bits: int, window: int, gram: int):
    def fn(chunk, told):
        w = Windows(chunk, window, gram)
        h, _, least = _distinct(chunk, w, _candidates(w, [(b, p) for _, b, p in told], bits), window)
        rows = [(b, h[s], least[s]) for b, s in exchange.by_bucket(h, bits)]
        yield pa.RecordBatch.from_arrays([pa.array([chunk.id] * len(rows), pa.int64()), pa.array([told[0][0]] * len(rows) if told else [], pa.int32()), pa.array([b for b, _, _ in rows], pa.int32()), pa.array([np.array([8 * len(h)], np.int64).tobytes() + h.tobytes() + exchange.pack(x) for _, h, x in rows], pa.binary())], names=["chunk", "kind", "bucket", "payload"])

    return fn


def _earlier(bucket, rows):
    """For each chunk of the batch, a bit a window: does a smaller document than any of the chunk's hold it?"""
    parts = []
    for p in rows["payload"]:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        parts.append((np.frombuffer(p, np.uint64, n // 8, 8), exchange.unpack(p[8 + n :])[0]))
    distinct, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, at, np.concatenate([x for _, x in parts]))
    out, cut = [], 0
    for chunk, kind, (h, x) in zip(rows["chunk"], rows["kind"], parts):
        if kind == TOLD:
            out.append((chunk, exchange.pack((least[at[cut : cut + len(h)]] < x).astype(np.uint8))))
        cut += len(h)
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([3] * len(out), pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["chunk", "kind", "bucket", "payload"])


def _remove(bits: int, window: int, gram: int, digest: bool):
    def fn(chunk, answers):
        w = Windows(chunk, window, gram)
        at = _candidates(w, [(b, p) for k, b, p in answers if k == TOLD], bits)
        gone = np.zeros(len(w.hashes) + 1, np.int64)
        if len(at):
            h, inverse, least = _distinct(chunk, w, at, window)
            before = np.concatenate([exchange.unpack(p)[0] for k, _, p in answers if k == 3]).astype(bool)
            later = before[inverse] | (chunk.ids[w.doc[at]] > least[inverse])
            np.add.at(gone, w.first[at[later]], 1)
            np.add.at(gone, w.first[at[later]] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        kept = []
        raw = chunk.data.tobytes()
        for i in range(len(chunk.ids)):
            a, b = w.bounds[i], w.bounds[i + 1]
            if sums[b] == sums[a]:
                text = b" ".join(raw[chunk.offsets[i] : chunk.offsets[i + 1]].split())
            else:
                own = a + np.flatnonzero(~gone[a:b])
                text = b" ".join([raw[x:y] for x, y in zip(w.starts[own].tolist(), w.ends[own].tolist())])
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=chunk.ids == exchange.NO_ID), pa.array(w.counts, pa.int64()), pa.array(sums[w.bounds[1:]] - sums[w.bounds[:-1]], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return fn


class Index:
    """Historical fingerprints and the documents they came from."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, bits: int | None = None):
        self.window, self.gram, self.fanout, self.bits = window, gram, fanout, bits
        self.runs: list[DataFrame] = []
        self.history: list[DataFrame] = []

    def add(self, docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The batch's documents: doc_id, n_words, n_removed, kept (the words left, joined by one blank, or with
        `digest` their SHA-256)."""
        own = exchange.store(docs, F.lit(0), id_col, text_col, len(self.history))
        self.bits = self.bits or max(exchange.bucket_bits(docs), exchange.bucket_bits(own))
        shape = (self.bits, self.window, self.gram)
        rows = exchange.ask_stored(own, _prints(*shape)).select(F.lit(TOLD).alias("kind"), "chunk", "bucket", "payload")
        for run in self.runs:
            rows = rows.union(run)
        run, told = _written(shared.grouped(rows, "bucket", ["kind", "chunk"], _merge, _MERGED))
        before = told.where(F.col("kind") == TOLD_BEFORE)
        met = own
        if self.history:
            for past in self.history:
                met = met.union(shared.sieve(past, F.col("chunk"), before, "chunk", "told").where("told").drop("told"))
        windows = exchange.gather_stored(met, told, _windows(*shape), "chunk long, kind int, bucket int, payload binary")
        earlier = shared.stored(shared.grouped(windows, "bucket", ["chunk"], _earlier, "chunk long, kind int, bucket int, payload binary"), "earlier")
        answers = told.where(F.col("kind") == TOLD).select("chunk", "kind", "bucket", "payload").union(earlier)
        out = exchange.gather_stored(own, answers, _remove(*shape, digest), OUT)
        self.runs.append(run)
        self.history.append(own)
        if len(self.runs) > self.fanout:
            self.compact()
        return out

    def compact(self) -> None:
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.union(run)
        run, _ = _written(shared.grouped(rows, "bucket", [], _compact, _MERGED))
        for old in self.runs:
            shared.discard(old)
        self.runs = [run]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the manifest. The folders that it names are never changed, only left behind by compaction: save again
        after further batches."""
        folders = lambda frames: [sorted({f.rsplit("/", 1)[0] for f in x.inputFiles()}) for x in frames]
        state = {"window": self.window, "gram": self.gram, "fanout": self.fanout, "bits": self.bits, "runs": folders(self.runs), "history": folders(self.history)}
        spark.createDataFrame([(json.dumps(state),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def reopen(spark: SparkSession, path: str) -> Index:
        state = json.loads(spark.read.parquet(path).first().manifest)
        index = Index(state["window"], state["gram"], state["fanout"], state["bits"])
        index.runs = [_read(spark, x) for x in state["runs"]]
        index.history = [spark.read.schema("chunk long, payload binary").parquet(*x) if x else spark.createDataFrame([], "chunk long, payload binary") for x in state["history"]]
        return index


_BUCKETS = "chunk long, bucket int, payload binary"


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    """A run, or an empty one where there's no folder."""
    rows = spark.read.schema(_BUCKETS).parquet(*folders) if folders else spark.createDataFrame([], _BUCKETS)
    return rows.select(F.lit(RUN).alias("kind"), "chunk", "bucket", "payload")


def _written(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The run, as a folder of its own, and what chunks are told, from one pass."""
    spark = merged.sparkSession
    path = shared.place(spark, "run")
    merged.write.partitionBy("kind").parquet(path)
    every = spark.read.schema(f"{_BUCKETS}, kind int").parquet(path).select("kind", "chunk", "bucket", "payload")
    return _read(spark, sorted({f.rsplit("/", 1)[0] for f in every.inputFiles() if f"/kind={RUN}/" in f})), every.where(F.col("kind") != RUN)


def dedup_in_batches(docs: DataFrame, batches: int = QUERY_BATCHES, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", fanout: int = QUERY_FANOUT) -> DataFrame:
    """All documents through an index, in `batches` even ranges of doc_id (nulls first)."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    index, out = Index(fanout=fanout), None
    if low is None:
        return index.add(docs, digest, id_col, text_col)
    step = (high - low) // batches + 1
    for i in range(batches):
        own = F.coalesce(F.expr(f"({id_col} - {low}L) div {step}L"), F.lit(0)) == i
        part = index.add(docs.where(own), digest, id_col, text_col)
        out = part if out is None else out.union(part)
    return out
