"""Benchmark decontamination on a distributed positional inverted index.

The index is document-partitioned and stored in the shared folder: each shard (a bounded run of documents) is a row that
holds the postings of all its tokens, term by term, as sorted positions. A search brings a block of the benchmark's
windows to every shard, starts from the postings of each window's rarest term there, and intersects the offset-adjusted
lists of the others, rarest first. No posting is shuffled, so no hot document, term or passage can gather in a task. A
benchmark of more than BLOCK_BYTES of text is searched block by block, a pass over the stored index each, so that driver
and workers hold one block at a time; what the passes found in a shard is then put together by shard.

Defined cases: null or empty texts have no words and no hits, but keep their row; an item without words matches
nothing; items of fewer words than a window are one window; repeated rows are judged each by itself; an item id that
repeats counts once; a null item id is listed as `null`; a null doc_id stays null; further columns are ignored by the
index and pass through `decontaminate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared, tokens
from kinlink.llm.exchange import pack, unpack

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of benchmark items that a worker holds at once (as windows, some ten times as much); more is searched block by block.
BLOCK_BYTES = 4 << 20

INDEX_SCHEMA = "shard long, documents binary, postings binary"
NO_ID = np.iinfo(np.int64).min


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index, one row per shard. `documents` packs int64 ids (null: smallest long), int64 hashes of the rows'
    texts and the uint32 position of each document's first word and of the end; `postings` packs the uint64 sorted
    term hashes, the uint32 place of each term's first posting and the end, and the uint32 positions, as differences.
    Between two documents one position is left out, so that no phrase spans them."""


    def run(batches):
        place, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(1))
            ids, rows = (batch.column(i).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False) for i in (0, 2))
            for a, b in tokens.slices(offsets, shard_bytes):
                hashes, counts = [], []
                for x, y in tokens.slices(offsets[a : b + 1], tokens.PIECE):
                    at = offsets[a + x : a + y + 1]
                    _, _, h, bounds = tokens.words(tokens.lower(data[at[0] : at[-1]]), at - at[0], tokens.ALNUM)
                    hashes.append(h)
                    counts.append(np.diff(bounds))
                h, n = np.concatenate(hashes), np.concatenate(counts)
                position = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
                order = np.argsort(h, kind="stable")
                h = h[order]
                heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
                firsts = np.concatenate([[0], np.cumsum(n + 1)])
                steps = np.diff(position[order].astype(np.uint32), prepend=np.uint32(0))
                documents = pack(ids[a:b], rows[a:b], firsts.astype(np.uint32))
                postings = pack(h[heads], np.append(heads, len(h)).astype(np.uint32), steps)
                number += 1
                yield pa.RecordBatch.from_pydict({"shard": pa.array([(place << 32) + number], pa.int64()), "documents": pa.array([documents], pa.binary()), "postings": pa.array([postings], pa.binary())})

    text = F.col(text_col).cast("string")
    return shared.stored(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), row_key(text).alias("row")).mapInArrow(shared.lean(run), INDEX_SCHEMA), "postings")


def row_key(text: Column) -> Column:
    """What stands for a text: equal texts have equal matches."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


class Block:
    """The windows of a block of items: `rows` (n, window) indexes into `terms`, -1 beyond a short item's end."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offsets = tokens.text_buffer(pa.array([t for _, t in items], pa.string()))
        _, _, hashes, bounds = tokens.words(tokens.lower(data), offsets, tokens.ALNUM)
        self.names = sorted({k for k, _ in items})
        place = {k: i for i, k in enumerate(self.names)}
        self.terms, at = np.unique(hashes, return_inverse=True)
        rows, owner, first = [], [], []
        for i, (k, _) in enumerate(items):
            own = at[bounds[i] : bounds[i + 1]]
            if 0 < len(own) < window:
                own = np.concatenate([own, np.full(window - len(own), -1)])
            for s in range(len(own) - window + 1):
                rows.append(own[s : s + window])
                owner.append(place[k])
                first.append(s)
        self.rows = np.array(rows, dtype=np.int32).reshape(len(rows), window)
        self.owner, self.first = np.array(owner, dtype=np.int64), np.array(first, dtype=np.int64)
        self.length = (self.rows >= 0).sum(axis=1)


def blocks(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int | None = None):
    """Broadcasts of Block, each of about block_bytes of item text, one after another: each is destroyed when the next is
    asked for, so what reads it must be stored by then."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k"), F.col(text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // (block_bytes or BLOCK_BYTES)) or 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        held = benchmark.sparkSession.sparkContext.broadcast(Block([(r.k, r.t) for r in part.collect()], window))
        yield held, n
        if n > 1:
            held.destroy()


class Shard:
    def __init__(self, documents: bytes, postings: bytes):
        self.ids, self.keys, bounds = unpack(documents)
        self.terms, heads, steps = unpack(postings)
        self.bounds, self.heads = bounds.astype(np.int64), heads.astype(np.int64)
        self.positions = np.cumsum(steps, dtype=np.uint32)
        rank = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.heads))
        #: Postings in one sorted line: term's rank, then position.
        self.postings = (rank << 32) | self.positions

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (rank << 32) | np.maximum(position, 0)
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (self.postings[at] == key) & (position >= 0)

    def near(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.postings, (rank << 32) | np.maximum(low, 0)), len(self.postings) - 1)
        return (self.postings[at] >= (rank << 32) | np.maximum(low, 0)) & (self.postings[at] <= ((rank << 32) | high))


def search(shard: Shard, block: Block, slop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window numbers, positions and whether the match is exact. With slop, also windows all of whose terms stand in
    the same document within window + slop - 1 words of an occurrence of the rarest (position: that occurrence)."""
    none = np.zeros(0, np.int64)
    if not len(shard.terms) or not len(block.rows):
        return none, none, np.zeros(0, bool)
    rank = np.searchsorted(shard.terms, block.terms)
    rank[rank == len(shard.terms)] = 0
    there = shard.terms[rank] == block.terms
    used = block.rows >= 0
    full = np.flatnonzero((there[block.rows] | ~used).all(axis=1))
    if not len(full):
        return none, none, np.zeros(0, bool)
    ranks, used = rank[block.rows[full]], used[full]
    frequency = np.where(used, np.diff(shard.heads)[ranks], np.iinfo(np.int64).max)
    order = np.argsort(frequency, axis=1, kind="stable")
    rarest = ranks[np.arange(len(full)), order[:, 0]]
    lists = np.diff(shard.heads)[rarest]
    w = np.repeat(np.arange(len(full)), lists)
    within = np.arange(len(w)) - np.repeat(np.cumsum(lists) - lists, lists)
    seed = shard.positions[shard.heads[rarest][w] + within].astype(np.int64)
    start, pair = seed - order[w, 0], w
    for k in range(1, order.shape[1]):
        column = order[pair, k]
        fits = ~used[pair, column] | shard.has(ranks[pair, column], start + column)
        pair, start = pair[fits], start[fits]
    if slop is None:
        return full[pair], start, np.ones(len(pair), bool)
    exact = set(zip(pair.tolist(), start.tolist()))
    loose, at = w, seed
    reach = order.shape[1] + slop - 1
    for k in range(1, order.shape[1]):
        column = order[loose, k]
        doc = shard.document(at)
        low, high = np.maximum(at - reach, shard.bounds[doc]), np.minimum(at + reach, shard.bounds[doc + 1] - 1)
        fits = ~used[loose, column] | shard.near(ranks[loose, column], low, high)
        loose, at = loose[fits], at[fits]
    fresh = np.array([(x, y - order[x, 0]) not in exact for x, y in zip(loose.tolist(), at.tolist())], dtype=bool)
    loose, at = loose[fresh], at[fresh]
    return np.concatenate([full[pair], full[loose]]), np.concatenate([start, at]), np.arange(len(pair) + len(loose)) < len(pair)


def _shards(batches):
    for batch in batches:
        for number, documents, postings in zip(*(batch.column(i) for i in range(3))):
            yield number.as_py(), documents.as_py(), Shard(documents.as_py(), postings.as_py())


_MATCHES = "doc_id long, item_id string, item_start long, doc_start long, kind string"


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = 4, **columns) -> DataFrame:
    """Every exact phrase and proximity match: doc_id, item_id, item_start (the window's first word in the item),
    doc_start (word number in the document of the phrase, or of the rarest term of a proximity match), kind."""
    out = None
    for held, n in blocks(benchmark, window, **columns):

        def run(batches, held=held):
            for _, _, shard in _shards(batches):
                block = held.value
                w, at, exact = search(shard, block, slop)
                doc = shard.document(at)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.ids[doc], mask=shard.ids[doc] == NO_ID),
                        "item_id": pa.array([block.names[i] for i in block.owner[w]], pa.string()),
                        "item_start": pa.array(block.first[w], pa.int64()),
                        "doc_start": pa.array(at - shard.bounds[doc], pa.int64()),
                        "kind": pa.array(np.where(exact, "exact", "proximity").tolist(), pa.string()),
                    }
                )

        found = index.mapInArrow(shared.lean(run), _MATCHES)
        found = found if n == 1 else shared.stored(found, "matches")
        out = found if out is None else out.unionByName(found)
    return out


class Found:
    """What a block's exact matches are in a shard: covered ranges of positions, and pairs of document and item."""

    def __init__(self, shard: Shard, block: Block):
        w, at, _ = search(shard, block)
        self.low, self.high = at, at + block.length[w]
        pairs = np.unique(np.stack([shard.document(at), block.owner[w]], axis=1), axis=0)
        self.doc, self.item = pairs[:, 0], [block.names[i] for i in pairs[:, 1].tolist()]


def _covered(bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of every position of the shard, whether a match covers it."""
    cover = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    return np.cumsum(cover) > 0


def _judged(ids, keys, bounds, low, high, doc, item) -> pa.RecordBatch:
    hit = np.concatenate([[0], np.cumsum(_covered(bounds, low, high))])
    n_hit = hit[bounds[1:]] - hit[bounds[:-1]]
    found = [set() for _ in ids]
    for d, k in zip(doc.tolist(), item):
        found[d].add(k)
    items = [sorted(x) for x in found]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, mask=ids == NO_ID),
            "n_words": np.diff(bounds) - 1,
            "n_hit": n_hit,
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "item_ids": pa.array(items, pa.list_(pa.string())),
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": n_hit > 0,
        }
    )


def _runs(ids, keys, bounds, low, high, doc, item) -> pa.RecordBatch:
    """Of each document with hits, the first word and the one after the last of every run of hit words."""
    covered = _covered(bounds, low, high)[: bounds[-1]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    own = np.searchsorted(bounds, first, side="right") - 1
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    cuts = pa.array(np.append(head, len(own)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x - bounds[own], pa.int64())) for x in (first, last)]
    return pa.RecordBatch.from_arrays([pa.array(keys[own[head]]), *lists], names=["row", "first", "last"])


def _searched(index: DataFrame, benchmark: DataFrame, window: int, each, schema: str, **columns) -> DataFrame:
    """each(documents' ids, keys, bounds, and all that was found in them) for every shard."""
    passes = []
    for held, n in blocks(benchmark, window, **columns):

        def at_once(batches, held=held):
            for _, _, shard in _shards(batches):
                f = Found(shard, held.value)
                yield each(shard.ids, shard.keys, shard.bounds, f.low, f.high, f.doc, f.item)

        if n == 1:
            return index.mapInArrow(shared.lean(at_once), schema)

        def part(batches, held=held):
            for number, documents, shard in _shards(batches):
                f = Found(shard, held.value)
                ranges = pack(f.low.astype(np.int64), f.high.astype(np.int64), f.doc.astype(np.int64))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "documents": pa.array([documents], pa.binary()), "found": pa.array([ranges], pa.binary()), "items": pa.array([f.item], pa.list_(pa.string()))})

        passes.append(shared.stored(index.mapInArrow(shared.lean(part), "shard long, documents binary, found binary, items array<string>"), "found"))

    rows = passes[0]
    for x in passes[1:]:
        rows = rows.union(x)

    def merged(key, rows):
        ids, keys, bounds = unpack(rows["documents"][0])
        low, high, doc = (np.concatenate(x) for x in zip(*map(unpack, rows["found"])))
        yield each(ids, keys, bounds.astype(np.int64), low, high, doc, [k for x in rows["items"] for k in x])

    return shared.grouped(rows, "shard", [], merged, schema)


def contamination(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an exact occurrence of a window), n_items, item_ids (sorted
    as strings), items_sha256, contaminated."""
    return _searched(index, benchmark, window, _judged, "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean", **columns)


def _cut(place: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, out = batch.column(place), []
            data, offsets = tokens.text_buffer(texts)
            for i, (first, last) in enumerate(zip(batch.column(len(names)), batch.column(len(names) + 1))):
                raw = data[offsets[i] : offsets[i + 1]]
                if not first.is_valid or not texts[i].is_valid:
                    out.append(texts[i].as_py())
                    continue
                starts, ends = tokens.spans(tokens.lower(raw), np.array([0, len(raw)]), tokens.ALNUM)
                at, kept = 0, []
                for f, t in zip(first.as_py(), last.as_py()):
                    kept.append(raw[at : starts[f]].tobytes())
                    at = ends[t - 1]
                kept.append(raw[at:].tobytes())
                out.append(b"".join(kept).decode("utf-8", "replace"))
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words inside any exact occurrence of a benchmark window, as the stored index finds them: hit
    words and what stands between them go, all else stays byte for byte, with all columns. Documents without a hit pass
    unchanged and aren't shuffled."""
    found = _searched(build_index(docs, id_col, text_col), benchmark, window, _runs, "row long, first array<long>, last array<long>")
    key, first, last, maybe = shared.fresh(docs.columns, "row", "first", "last", "maybe")
    found = shared.stored(found.groupBy("row").agg(F.first(F.struct("first", "last")).alias("r")).select(F.col("row").alias(key), F.col("r.first").alias(first), F.col("r.last").alias(last)), "runs")
    marked = shared.sieve(docs.withColumn(key, row_key(docs[text_col])), F.col(key), found, key, maybe)
    hit = marked.where(F.col(maybe)).join(found, key, "left").select(*docs.columns, first, last)
    cut = hit.mapInArrow(shared.lean(_cut(docs.columns.index(text_col), docs.columns)), docs.schema)
    return marked.where(~F.col(maybe)).select(*docs.columns).union(cut)
