"""Embedding near-dedup by NN-descent.

Vectors meet only within a block (equal, non-null label and equal length). Equal vectors are one class from the start.
Classes get first neighbours from random-projection buckets: a block of few classes is one bucket, a larger one gets
projection bits by its own number of classes, and so many tables that a pair at the threshold shares no bucket with
a fixed probability, however large the block. NN-descent then refines the lists: each class's
neighbours and reverse neighbours are joined with their vectors and compared with each other, and what betters a list
is merged in, until few lists change. A list whose last entry still reaches the threshold is saturated and doubles its
length. Past the longest length it loses links, but only those whose two classes are both saturated: such classes of
different components are compared exactly, chunk by chunk, save for pairs of chunks whose angles rule a link out. An
audit compares a bounded sample with every class of its block; each class counts alike, as does each size of
neighbourhood. Below the wanted recall, refinement goes on with longer lists and labels are made anew; if the last audit
is still below, all classes of a block are compared exactly (quadratic in the block). Edges at the threshold, computed in
double precision, are closed into components. Links are counted exactly inside components, block by block in memory, so a
large group never makes its pairs as rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label, have no links and are their own component; equal vectors link with each other; rows that repeat a vec_id count
as vectors of their own with that id, also where it is null; the scale of a vector doesn't matter, down to the least and
up to the largest double; further columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import shared, tokens
from kinlink.llm.components import components

#: First list length, most that saturation may reach (links beyond it are found and counted by blocks), probability
#: that a pair at the threshold shares no bucket, classes in a bucket or block, rounds, sampled classes of the audit and
#: its wanted recall.
LIST, LONGEST, APART, BLOCK, ROUNDS, SAMPLE, RECALL = 6, 24, 1e-3, 256, 4, 200, 0.995
#: What single precision may add to a similarity.
SLACK = 1e-6


def _classes(batches):
    for batch in batches:
        labels = batch.column("label").to_pylist()
        keys, blocks, vectors = [], [], []
        for row, label in zip(batch.column("embedding"), labels):
            x = row.as_py()
            good = bool(x) and label is not None and None not in x
            x = np.array(x, dtype=np.float64) if good else None
            most = float(np.abs(x).max()) if good else 0.0
            if not good or not np.isfinite(most) or most == 0 or not np.isfinite(x).all():
                keys.append(0)
                blocks.append(0)
                vectors.append(None)
                continue
            x = x + 0.0  # -0.0 is 0.0
            own = np.frombuffer(f"{label}|{len(x)}".encode(), dtype=np.uint8)
            block = tokens.span_hashes(own, np.array([0]), np.array([len(own)]))
            raw = x.view(np.uint64)
            both = np.concatenate([block, tokens.mix(raw + np.arange(len(raw), dtype=np.uint64))])
            keys.append(int(tokens.grams(both, len(both)).view(np.int64)[0]) or 1)
            blocks.append(int(block.view(np.int64)[0]))
            # A power of two brings the largest component near 1, so that squares neither overflow nor vanish.
            x = np.ldexp(x, -int(np.frexp(most)[1]))
            vectors.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cls": pa.array(keys, pa.int64()), "blk": pa.array(blocks, pa.int64()), "vec": pa.array(vectors, pa.binary())})


def _matrix(column: list, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def projection_bits(n: Column) -> Column:
    """Of a block of n classes: none up to BLOCK, then about 64 classes a bucket."""
    return F.when(n <= BLOCK, 0).otherwise(F.ceil(F.log2(n / 64))).cast("int")


def tables_for(bits: int, threshold: float) -> int:
    """So many that a pair at the threshold shares a bucket in none with probability APART at most."""
    together = (1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi) ** bits
    return 1 if together >= 1 - APART else int(np.ceil(np.log(APART) / np.log1p(-together)))


def _codes(threshold: float):
    """Sign codes of random projections, one bucket a table; the projections depend on table, bits and vector length
    only. A block's number of bits stands in its rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, blk, vectors = batch.column("cls").to_pylist(), batch.column("blk").to_pylist(), batch.column("vec").to_pylist()
            bits = batch.column("bits").to_pylist()
            for size, depth in sorted({(len(v), d) for v, d in zip(vectors, bits)}):
                at = [i for i, v in enumerate(vectors) if len(v) == size and bits[i] == depth]
                x = _matrix([vectors[i] for i in at])
                for t in range(tables_for(depth, threshold)):
                    plane = np.random.Generator(np.random.PCG64([t, x.shape[1]])).standard_normal((x.shape[1], depth))
                    sign = ((x @ plane) > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                    key = np.stack([np.array([blk[i] for i in at], dtype=np.int64).view(np.uint64), sign.astype(np.uint64), np.full(len(at), t, np.uint64)])
                    bucket = tokens.mix(tokens.mix(key[0] + key[1]) + key[2]).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"cls": pa.array([cls[i] for i in at], pa.int64()), "bucket": bucket, "vec": pa.array([x[i].astype(np.float32).tobytes() for i in range(len(at))], pa.binary())})

    return run


_EDGES = "u long, v long, sim double"


def _edges(u, v, s) -> pa.RecordBatch:
    """Similarities are rounded, so that a pair that is met in matrices of different shapes gets the same one."""
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(np.round(s, 9), pa.float64())})


def _first(edges: DataFrame, node: str, other: str, most: int) -> DataFrame:
    """Each node's `most` nearest: ranked and cut before they're shuffled, so that no hub gathers all its edges."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(node).orderBy(F.desc("sim"), F.desc(other)))).where(F.col("place") <= most).drop("place")


def _within(length: int):
    """Of each row of a bucket, the nearest `length` others among up to BLOCK rows."""

    def fn(key, rows):
        ids = np.array(rows["cls"], dtype=np.int64)
        x = _matrix(rows["vec"], np.float32).astype(np.float64)
        for a in range(0, len(ids), BLOCK):
            own, y = ids[a : a + BLOCK], x[a : a + BLOCK]
            if len(own) < 2:
                continue
            g = y @ y.T
            np.fill_diagonal(g, -2)
            k = min(length, len(own) - 1)
            best = np.argpartition(-g, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(own)), k)
            yield _edges(own[i], own[best.ravel()], g[i, best.ravel()])

    return fn


def _join(rows_key, rows):
    """The local join: pairs of a class's neighbours that better either's list."""
    ids = np.array(rows["v"], dtype=np.int64)
    if len(ids) < 2:
        return
    x = _matrix(rows["vec"], np.float32).astype(np.float64)
    g = x @ x.T
    np.fill_diagonal(g, -2)
    better = g > np.array(rows["worst"])[:, None]
    for i, (known, room) in enumerate(zip(rows["known"], rows["size"])):
        better[i] &= ~np.isin(ids, known)
        if better[i].sum() > room:  # no more can enter the list
            floor = np.partition(g[i][better[i]], -room)[-room]
            better[i] &= g[i] >= floor
    i, j = np.nonzero(better)
    if len(i):
        yield _edges(ids[i], ids[j], g[i, j])


def _merged(lists: DataFrame | None, fresh: DataFrame, longer: int, threshold: float) -> DataFrame:
    """(u, size, list of (sim, v), best first, open): the best `size` of old entries and fresh edges. A list is open once
    it was full of entries at the threshold, so that more may have been turned away."""
    once = fresh.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    fresh = _first(once, "u", "v", max(longer, LONGEST)).groupBy("u").agg(F.collect_list(F.struct("sim", "v")).alias("new"))
    if lists is None:
        both = fresh.select("u", F.lit(longer).alias("size"), "new", F.lit(False).alias("open"), F.lit(longer).alias("was"))
    else:
        both = lists.join(fresh, "u", "left").select("u", F.greatest("size", F.lit(longer)).alias("size"), F.concat("list", F.coalesce("new", F.array().cast("array<struct<sim:double,v:bigint>>"))).alias("new"), "open", F.col("size").alias("was"))
    best = F.sort_array(F.array_distinct("new"), asc=False)
    out = both.select("u", "size", best.alias("list"), "open", "was")
    filled = F.col("open") | F.coalesce(F.get("list", F.col("was") - 1)["sim"] >= threshold - SLACK, F.lit(False))
    grown = F.when(F.size("list") < F.col("size"), F.col("size")).otherwise(F.when(F.get("list", F.col("size") - 1)["sim"] >= threshold, F.least(F.col("size") * 2, F.greatest(F.col("size"), F.lit(LONGEST)))).otherwise(F.col("size")))
    return shared.stored(out.select("u", grown.alias("size"), "list", filled.alias("open")).select("u", "size", F.slice("list", F.lit(1), F.col("size")).alias("list"), "open"), "lists")


def refine(nodes: DataFrame, lists: DataFrame, length: int, threshold: float) -> tuple[DataFrame, int]:
    """One NN-descent round; the new lists and how many edges came in."""
    ahead = lists.select("u", F.explode("list").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.sim").alias("sim"))
    # Reverse lists are sampled as NN-descent does: the nearest `length`.
    back = _first(ahead, "v", "u", length).select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = ahead.select("u", "v").union(back).distinct()
    state = nodes.join(lists, nodes["cls"] == lists["u"], "left").select(F.col("cls").alias("v"), F.col("small").alias("vec"), F.coalesce(F.when(F.size("list") >= F.col("size"), F.element_at("list", -1)["sim"]), F.lit(-1.0)).alias("worst"), F.coalesce(F.transform("list", lambda e: e["v"]), F.array().cast("array<bigint>")).alias("known"), F.coalesce("size", F.lit(length)).alias("size"))
    state = shared.stored(state, "state")
    fresh = shared.stored(shared.grouped(around.join(state, "v").select("u", "v", "vec", "worst", "known", "size"), "u", [], _join, _EDGES), "fresh")
    n = fresh.count()
    return (_merged(lists, fresh, length, threshold) if n else lists), n


def _counts(threshold: float):
    def fn(key, rows):
        ids, weight = np.array(rows["cls"], dtype=np.int64), np.array(rows["copies"], dtype=np.int64)
        side = np.array(rows["side"])
        x = _matrix(rows["vec"])
        if side.max() == 0:
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            n = hit @ weight
        else:
            left = side == 0
            hit = x[left] @ x[~left].T >= threshold
            n = np.zeros(len(ids), np.int64)
            n[left], n[~left] = hit @ weight[~left], weight[left] @ hit
        yield pa.RecordBatch.from_pydict({"cls": ids, "n": n})

    return fn


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    vectors = shared.stored(source.mapInArrow(_classes, "vec_id long, cls long, blk long, vec binary"), "vectors")
    nodes = vectors.where("cls <> 0").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("blk").alias("blk"), F.first("vec").alias("vec"))
    narrow = nodes.mapInArrow(_narrow, "cls long, rep long, copies long, blk long, vec binary, small binary")
    nodes = shared.stored(narrow, "nodes")
    depth = nodes.groupBy("blk").agg(projection_bits(F.count(F.lit(1))).alias("bits"))
    coded = nodes.join(shared.stored(depth, "bits"), "blk").select("cls", "blk", "bits", "vec").mapInArrow(_codes(threshold), "cls long, bucket long, vec binary")
    large = shared.stored(coded.groupBy("bucket").count().where(F.col("count") > BLOCK), "buckets")
    dealt = coded.join(large, "bucket", "left").select("cls", "vec", F.xxhash64("bucket", F.pmod(F.xxhash64("cls", F.lit(5)), F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)))).alias("bucket"))
    length = LIST
    lists = _merged(None, shared.grouped(dealt, "bucket", ["cls"], _within(length), _EDGES), length, threshold)
    total = nodes.count()
    for _ in range(ROUNDS):
        lists, n = refine(nodes, lists, length, threshold)
        if n <= 0.01 * total * length:
            break
    out = _links(nodes, _near(nodes, lists, threshold), threshold)
    share = audit(nodes, out, threshold)
    for _ in range(2):
        if share >= recall:
            break
        length *= 2
        lists, _ = refine(nodes, lists, length, threshold)
        lists, _ = refine(nodes, lists, length, threshold)
        out = _links(nodes, _near(nodes, lists, threshold), threshold)
        share = audit(nodes, out, threshold)
    logging.getLogger(__name__).info("audited recall %.4f", share)
    if share < recall:
        logging.getLogger(__name__).warning("recall %.4f is under %.4f after the last refinement: comparing whole blocks", share, recall)
        out = _links(nodes, shared.stored(_all_pairs(nodes, threshold), "links"), threshold)
    slim = vectors.select("vec_id", F.when(F.col("cls") == 0, F.xxhash64(F.lit("none"), "vec_id")).otherwise(F.col("cls")).alias("cls"), (F.col("cls") == 0).alias("alone"))
    joined = slim.join(out, "cls", "left")
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.when(F.col("alone"), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _narrow(batches):
    for batch in batches:
        small = [np.frombuffer(v, dtype=np.float64).astype(np.float32).tobytes() for v in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(small, pa.binary())], names=[*batch.schema.names, "small"])


def _exact(threshold: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                keep.append(float(np.frombuffer(a) @ np.frombuffer(b)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _pivots(key, rows):
    """A chunk's mean direction and the widest angle of a member to it."""
    x = _matrix(rows["vec"])
    mean = x.sum(axis=0)
    norm = np.sqrt(mean @ mean)
    pivot = mean / norm if norm > 1e-9 else x[0]
    wide = float(np.arccos(np.clip(x @ pivot, -1, 1)).max())
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([key], pa.int64()), "blk": pa.array(rows["blk"][:1], pa.int64()), "root": pa.array(rows["root"][:1], pa.int64()), "pivot": pa.array([pivot.tobytes()], pa.binary()), "wide": pa.array([wide], pa.float64())})


def _reach(threshold: float):
    """Pairs of chunks of different components that the angles of pivots and members allow a link at the threshold."""
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def fn(key, rows):
        ids, root, wide, side = (np.array(rows[c]) for c in ("chunk", "root", "wide", "side"))
        x = _matrix(rows["pivot"])
        left = np.flatnonzero(side == 0)
        right = left if side.max() == 0 else np.flatnonzero(side == 1)
        between = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
        # The arc cosine turns rounding of 1e-15 near 1 into angles of 1e-7.
        near = (between <= wide[left][:, None] + wide[right][None, :] + angle + SLACK) & (root[left][:, None] != root[right][None, :])
        i, j = np.nonzero(np.triu(near) if side.max() == 0 else near)
        yield pa.RecordBatch.from_pydict({"c": pa.array(ids[left[i]], pa.int64()), "d": pa.array(ids[right[j]], pa.int64())})

    return fn


def _bridge(threshold: float):
    """One link between the two sides, if there is any: each side is inside one component already."""

    def fn(key, rows):
        ids, side, x = np.array(rows["cls"], dtype=np.int64), np.array(rows["side"]), _matrix(rows["vec"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        g = x[left] @ x[right].T
        i, j = np.unravel_index(g.argmax(), g.shape)
        if g[i, j] >= threshold:
            a, b = int(ids[left[i]]), int(ids[right[j]])
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(a, b)], pa.int64()), "b": pa.array([max(a, b)], pa.int64())})

    return fn


def _bridges(nodes: DataFrame, lists: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a link for each pair of chunks of open classes that links two of the components of `edges`."""
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    left = lists.where("open").select(F.col("u").alias("cls")).join(nodes.select("cls", "blk", "vec"), "cls").join(roots, "cls", "left")
    left = shared.stored(left.select("cls", "blk", "vec", F.coalesce("root", "cls").alias("root")), "open")
    several = left.groupBy("blk").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("blk")
    sizes = left.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
    chunk = F.xxhash64("blk", "root", F.pmod(F.xxhash64("cls", F.lit(11)), F.col("n")))
    left = shared.stored(left.join(several, "blk", "left_semi").join(sizes, "root").select(chunk.alias("chunk"), "cls", "blk", "root", "vec"), "chunks")
    pivots = shared.stored(shared.grouped(left, "chunk", ["cls"], _pivots, "chunk long, blk long, root long, pivot binary, wide double"), "pivots")
    parts = pivots.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = pivots.join(parts, "blk").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select(F.xxhash64("blk", i, j).alias("block"), F.when(F.col("part") == i, 0).otherwise(1).alias("side"), "chunk", "root", "pivot", "wide")
    pairs = shared.stored(shared.grouped(dealt, "block", ["side", "chunk"], _reach(threshold), "c long, d long"), "reach")
    pair = F.xxhash64("c", "d").alias("pair")
    ends = pairs.select(pair, F.lit(0).alias("side"), F.col("c").alias("chunk")).union(pairs.select(pair, F.lit(1).alias("side"), F.col("d").alias("chunk")))
    return shared.grouped(ends.join(left, "chunk").select("pair", "side", "cls", "vec"), "pair", ["side", "cls"], _bridge(threshold), "a long, b long")


def _spans(threshold: float):
    """Of the links between the two sides, or inside the only one, those that span their components."""

    def fn(key, rows):
        ids, side, x = np.array(rows["cls"], dtype=np.int64), np.array(rows["side"]), _matrix(rows["vec"])
        hit = x @ x.T >= threshold
        if side.max() > 0:
            hit &= side[:, None] != side[None, :]
        seen, a, b = np.zeros(len(ids), bool), [], []
        for start in range(len(ids)):
            if seen[start]:
                continue
            seen[start] = True
            todo = [start]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(hit[i] & ~seen)
                seen[new] = True
                todo += new.tolist()
                a += [ids[i]] * len(new)
                b += ids[new].tolist()
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return fn


def _all_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that span all components, from comparing all classes of each block."""
    parts = nodes.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = nodes.join(parts, "blk").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select(F.xxhash64("blk", i, j).alias("block"), F.when(F.col("part") == i, 0).otherwise(1).alias("side"), "cls", "vec")
    return shared.grouped(dealt, "block", ["side", "cls"], _spans(threshold), "a long, b long")


def _near(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links whose components are those of all links that the lists' classes were compared for."""
    edges = lists.select("u", F.explode("list").alias("e")).where(F.col("e.sim") >= threshold - SLACK).select(F.least("u", "e.v").alias("a"), F.greatest("u", "e.v").alias("b")).distinct()
    side = lambda c, v: nodes.select(F.col("cls").alias(c), F.col("vec").alias(v))
    edges = shared.stored(edges.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_exact(threshold), "a long, b long"), "links")
    return shared.stored(edges.union(_bridges(nodes, lists, edges, threshold)), "links")


def _links(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """cls, n_links, component_id from links that span the components."""
    roots = shared.stored(components(edges).select(F.col("node").alias("cls"), "root"), "roots")
    sizes = shared.stored(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "large")
    parts = roots.join(sizes, "root", "left").select("cls", "root", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("parts"))
    full = parts.join(nodes, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    dealt = full.select(F.xxhash64("root", i, j).alias("block"), F.when(F.col("part") == i, 0).otherwise(1).alias("side"), "cls", "copies", "vec")
    counts = shared.grouped(dealt, "block", ["side", "cls"], _counts(threshold), "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    least = shared.stored(roots.join(nodes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("least")), "least")
    out = nodes.select("cls", "rep", "copies").join(counts, "cls", "left").join(roots, "cls", "left").join(least, "root", "left")
    return shared.stored(out.select("cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "labels")


def audit(nodes: DataFrame, found: DataFrame, threshold: float, sample: int = SAMPLE) -> float:
    """Share of their links that about `sample` classes have found, against comparing them with every class: the mean over
    classes that have links, or the least mean of a size of neighbourhood (by powers of 4), if that's lower."""
    total = nodes.count()
    if not total:
        return 1.0
    picked = nodes.where(F.pmod(F.xxhash64("cls", F.lit("audit")), F.lit(max(1, total // sample))) == 0).limit(4 * sample).select("cls", "blk", "vec", "copies").collect()
    if not picked:
        return 1.0
    ids, held = [r.cls for r in picked], nodes.sparkSession.sparkContext.broadcast([(r.blk, bytes(r.vec), r.cls) for r in picked])

    def run(batches):
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            blk, w = batch.column("blk").to_numpy(zero_copy_only=False), batch.column("copies").to_numpy(zero_copy_only=False)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            vectors = batch.column("vec").to_pylist()
            for b in set(blk.tolist()):
                own = [i for i, x in enumerate(held.value) if x[0] == b]
                at = np.flatnonzero(blk == b)
                if own:
                    hit = _matrix([held.value[i][1] for i in own]) @ _matrix([vectors[i] for i in at]).T >= threshold
                    hit &= np.array([held.value[i][2] for i in own])[:, None] != cls[at][None, :]
                    n[own] += hit @ w[at]
        yield pa.RecordBatch.from_pydict({"cls": ids, "n": n})

    true = nodes.select("cls", "blk", "vec", "copies").mapInArrow(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    # Equal copies are linked from the start: only links to other classes count.
    got = true.where("n > 0").join(found, "cls").join(nodes.select("cls", "copies"), "cls").select("n", (F.col("n_links") - F.col("copies") + 1).alias("m")).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((int(r.n).bit_length() + 1) // 2, []).append(r.m / r.n)
    return min([sum(map(sum, sizes.values())) / len(got), *(sum(x) / len(x) for x in sizes.values())]) if got else 1.0
