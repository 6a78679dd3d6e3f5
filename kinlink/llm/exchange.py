"""Packed exchange between chunks of documents and hash buckets.

A chunk is a bounded run of documents of one input partition, as one compressed row. Chunks send sorted keys, six bytes
each, to hash buckets; a bucket answers every chunk that wrote to it, in the order of what it sent; chunks and answers
meet again by chunk. So corpus-wide counts and look-ups take a row for each chunk and bucket, not one for each token,
and a hot key is one entry of each chunk. The number of buckets follows the size of the input files, up to 2^20 (some
2 TB of files), so that a bucket holds about as many keys at any size up to there.

Chunks are either stored once and read by each later pass, or made anew in each pass over the documents. In the latter
case their id is a hash of their place and content; a pass that met other rows would leave answers without a chunk,
which is an error, never a silent loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared, tokens

CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 2 << 20
ROWS = "chunk long, bucket int, payload binary"
LOW = np.uint64((1 << 48) - 1)
_CODEC = "zstd"
NO_ID = np.iinfo(np.int64).min


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed, one after another, each with its kind and lengths."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        small = pa.compress(raw, codec=_CODEC, asbytes=True)
        out.append(np.array([x.dtype.num, len(raw), len(small)], dtype=np.int64).tobytes() + small)
    return b"".join(out)


_KINDS = {np.dtype(k).num: np.dtype(k) for k in ("u1", "i1", "u2", "u4", "i8", "u8", "i4", "f8")}


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, size, small = np.frombuffer(raw, np.int64, 3, at).tolist()
        at += 24
        out.append(np.frombuffer(pa.decompress(raw[at : at + small], size, codec=_CODEC, asbytes=True), dtype=_KINDS[kind]))
        at += small
    return out


def six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """Key ids: the bucket (top `bits` bits of the hash) over its low 48 bits."""
    return ((h >> np.uint64(64 - bits)) << np.uint64(48)) | (h & LOW)


def bucket_bits(df: DataFrame) -> int:
    """One bucket for 2 MB of input files."""
    return min(20, max(6, int(np.ceil(np.log2(max(1, shared.input_bytes(df)) / BUCKET_BYTES)))))


class Chunk:
    def __init__(self, number: int, tag: int, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.id, self.tag, self.ids, self.offsets, self.data = number, tag, ids, offsets, data

    def payload(self) -> bytes:
        return pack(np.array([self.tag], np.int64), self.ids, np.diff(self.offsets), self.data)

    @staticmethod
    def read(number: int, raw: bytes) -> Chunk:
        tag, ids, lengths, data = unpack(raw)
        return Chunk(number, int(tag[0]), ids, np.concatenate([[0], np.cumsum(lengths)]), data)


def chunks(batches, salt: int = 0, chunk_bytes: int = CHUNK_BYTES):
    """Chunks of the rows (id long, tag int, text string) of a partition; those of a tag go together."""
    place = TaskContext.get().partitionId()
    held: dict[int, list] = {}
    size: dict[int, int] = {}
    number = 0

    def close(tag):
        nonlocal number
        parts = held.pop(tag)
        size.pop(tag)
        ids = np.concatenate([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        data = np.concatenate([p[2] for p in parts])
        number += 1
        key = xxhash.xxh64_intdigest(np.array([place, number, salt, tag], np.int64).tobytes() + ids.tobytes() + lengths.tobytes())
        return Chunk(int(np.uint64(key).view(np.int64)), tag, ids, np.concatenate([[0], np.cumsum(lengths)]), data)

    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = tokens.text_buffer(batch.column(2))
        for a, b in tokens.slices(offsets, chunk_bytes // 4):
            for tag in np.unique(tags[a:b]).tolist():
                at = a + np.flatnonzero(tags[a:b] == tag)
                lengths = offsets[at + 1] - offsets[at]
                body = data[offsets[a] : offsets[b]] if len(at) == b - a else np.concatenate([data[offsets[i] : offsets[i + 1]] for i in at] or [data[:0]])
                held.setdefault(tag, []).append((ids[at].copy(), lengths, body.copy()))
                size[tag] = size.get(tag, 0) + len(body) + 64 * len(at)
                if size[tag] >= chunk_bytes:
                    yield close(tag)
    for tag in sorted(held):
        yield close(tag)


def source(docs: DataFrame, tag, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, tag, text), stored first unless a second pass is sure to meet the same partitions."""
    return shared.steady(docs.select(F.col(id_col).cast("long").alias("id"), tag.cast("int").alias("tag"), F.col(text_col).cast("string").alias("text")))


def store(docs: DataFrame, tag, id_col: str, text_col: str, salt: int) -> DataFrame:
    """Chunks of docs as a stored table (chunk, payload). `salt` tells equal batches apart."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), tag.cast("int").alias("tag"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for chunk in chunks(batches, salt):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk.id], pa.int64()), "payload": pa.array([chunk.payload()], pa.binary())})

    return shared.stored(src.mapInArrow(run, "chunk long, payload binary"), "chunks")


def _sent(chunk: Chunk, keys) -> pa.RecordBatch:
    rows = list(keys(chunk))
    return pa.RecordBatch.from_arrays([pa.array([chunk.id] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["chunk", "bucket", "payload"])


def ask(src: DataFrame, keys) -> DataFrame:
    """keys(chunk) yields (bucket, payload): the rows that chunks send."""

    def run(batches):
        for chunk in chunks(batches):
            yield _sent(chunk, keys)

    return src.mapInArrow(run, ROWS)


def ask_stored(table: DataFrame, keys) -> DataFrame:
    """The same of stored chunks."""

    def run(batches):
        for batch in batches:
            for number, raw in zip(batch.column(0), batch.column(1)):
                yield _sent(Chunk.read(number.as_py(), raw.as_py()), keys)

    return table.mapInArrow(run, ROWS)


def gather(src: DataFrame, answers: DataFrame, fn, schema: str, tag: int | None = None) -> DataFrame:
    """fn(chunk, [(kind, bucket, payload)]) gives batches. `answers`: (chunk, kind, bucket, payload), kind >= 1."""

    def run(batches):
        for chunk in chunks(batches):
            if tag is None or chunk.tag == tag:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk.id], pa.int64()), "payload": pa.array([chunk.payload()], pa.binary())})

    return gather_stored(src.mapInArrow(run, "chunk long, payload binary"), answers, fn, schema)


def gather_stored(table: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """The same of stored chunks. Every chunk of `table` is met, with or without an answer."""
    rows = table.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "payload")

    def each(key, held):
        if held["kind"][0] != 0 or held["kind"].count(0) != 1:
            raise RuntimeError("answers for a chunk that this pass didn't make: the documents changed between passes")
        yield from fn(Chunk.read(key, held["payload"][0]), list(zip(held["kind"][1:], held["bucket"][1:], held["payload"][1:])))

    return shared.grouped(rows.union(answers.select("chunk", "kind", "bucket", "payload")), "chunk", ["kind", "bucket"], each, schema)


def by_bucket(h: np.ndarray, bits: int):
    """(bucket, slice) of sorted hashes."""
    b = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
        yield int(b[a]), slice(a, z)
