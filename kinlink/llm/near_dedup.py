"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set of word shingles becomes a class key (documents with equal sets are one class from here on) and a
   signature of 128 MinHashes, kept as 16 bits each.
2. Bands of 8 signature places each put classes into buckets; their number follows from the threshold and the chosen
   miss probability. Most buckets hold one class: a bitmap keeps them out of the shuffle. In a bucket everyone is tied
   to its least class only, and ties are closed into candidate groups, so a bucket of n classes makes n - 1 rows, never
   its pairs. Classes that are read together are tied at once; a bucket then gets their least class alone.
3. Candidate groups are cut into blocks of bounded size and compared in memory: a pair that shares a band is compared
   signature batch by signature batch, and dropped once the posterior probability that its similarity reaches the
   threshold (uniform prior) is under `miss`. Survivors are verified on their full sets. A comparison returns links that
   span what it found, not all of them, and skips pairs that are in one component already.
   A group of several blocks isn't compared block by block at once. First each block is compared within itself and
   with the group's PIVOTS, those of its classes that share the most buckets. Classes that this ties to the first pivot
   (through another pivot, perhaps) are one component already. Only the rest is then compared with all of the group. A
   group of copies of one text leaves little, so the work grows with the size of the group times that of the rest, not
   with its square, unless a group falls apart.
4. Links are closed into components.

Shingles are compared by 64-bit hashes. Defined cases: a null text or one without words has an empty set, which links
with nothing; a text of fewer words than a shingle is one shingle; rows that repeat a doc_id count as the same
document; a null doc_id is a document whose component_id is null unless it has copies; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import exchange, shared, tokens
from kinlink.llm.components import components

PLACES, BAND, BATCH = 128, 8, 16
MISS = 1e-7
#: Classes of a candidate group that meet in one block, and of a large group that all its blocks are compared with.
BLOCK, PIVOTS = 256, 8

_draw = np.random.Generator(np.random.PCG64(20240501))
_XOR = _draw.integers(0, 1 << 32, PLACES, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1)
_ORDER = [_draw.permutation(PLACES) for _ in range(64)]


def miss_rate(threshold: float, n: int) -> float:
    """Bound on the probability that a pair at the threshold shares none of n bands. Bands are drawn from the same
    places, so they're independent only given the number of places that match: a mixture over that number. Bands of
    one permutation are disjoint, which only lowers the rate."""
    total = math.comb(PLACES, BAND)
    return sum(math.comb(PLACES, m) * threshold**m * (1 - threshold) ** (PLACES - m) * (1 - math.comb(m, BAND) / total) ** n for m in range(PLACES + 1))


def band_places(threshold: float, miss: float = MISS) -> np.ndarray:
    """Signature places of each band, as rows: enough bands that a pair at the threshold shares none with probability
    `miss` at most."""
    most = len(_ORDER) * PLACES // BAND
    n = next((n for n in range(1, most + 1) if miss_rate(threshold, n) <= miss), None)
    if n is None:
        raise ValueError(f"a threshold of {threshold} needs more than {most} bands; add permutations")
    return np.concatenate([p.reshape(-1, BAND) for p in _ORDER[: -(-n * BAND // PLACES)]])[:n]


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    data, offsets = tokens.text_buffer(column)
    for a, b in tokens.slices(offsets, tokens.PIECE):
        part = offsets[a : b + 1] - offsets[a]
        _, _, h, bounds = tokens.words(tokens.lower(data[offsets[a] : offsets[b]]), part, tokens.SPACE_SEPARATED)
        g = tokens.grams(h, k)
        for i in range(b - a):
            x, y = bounds[i], bounds[i + 1]
            if y - x >= k:
                yield np.unique(g[x : y - k + 1])
            else:
                yield tokens.grams(h[x:y], int(y - x)) if y > x else np.zeros(0, np.uint64)


def class_key(s: np.ndarray) -> int:
    """A 64-bit key of a set; 0 for the empty one."""
    if not len(s):
        return 0
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(tokens.mix(s)), np.uint64(len(s))], dtype=np.uint64)
    return int(tokens.grams(both, 3).view(np.int64)[0]) or 1


def signature(s: np.ndarray) -> np.ndarray:
    h = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(PLACES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(h), 512):
        least = np.minimum(least, ((h[a : a + 512][None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return (least >> np.uint32(16)).astype(np.uint16) ^ least.astype(np.uint16)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes, keys, signs = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                keys.append(class_key(s))
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "cls", "sign"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(shared.lean(run), "doc_id long, n_shingles long, cls long, sign binary")


def band_hashes(signs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(classes, bands) hashes; the band's number is part of them."""
    out = np.empty((len(signs), len(places)), dtype=np.uint64)
    for i, p in enumerate(places):
        packed = np.ascontiguousarray(signs[:, p]).view(np.uint64)
        out[:, i] = tokens.mix(tokens.mix(packed[:, 0] + np.uint64(i + 1)) ^ packed[:, 1])
    return out


def _signatures(batches, most: int):
    """(classes, signatures) of about `most` rows of (cls, sign) at a time."""
    cls, signs, n = [], [], 0
    for batch in batches:
        cls.append(batch.column(0).to_numpy(zero_copy_only=False))
        signs += batch.column(1).to_pylist()
        n += batch.num_rows
        if n >= most:
            yield np.concatenate(cls), np.frombuffer(b"".join(signs), dtype=np.uint16).reshape(-1, PLACES)
            cls, signs, n = [], [], 0
    if n:
        yield np.concatenate(cls), np.frombuffer(b"".join(signs), dtype=np.uint16).reshape(-1, PLACES)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << shared.SIEVE_BITS) - 1)).astype(np.int64)


def shared_buckets(classes: DataFrame, places: np.ndarray) -> np.ndarray:
    """A bitmap of 8 MB, by the hashes' lowest bits, that has every bucket with two classes or more (and by chance some
    others). Only packed keys of six bytes are shuffled for it, a row for each run of classes and hash bucket."""
    bits = exchange.bucket_bits(classes)

    def send(batches):
        for _, signs in _signatures(batches, max(1, (1 << 20) // len(places))):
            h, n = np.unique(band_hashes(signs, places), return_counts=True)
            rows = [(b, np.array([6 * (s.stop - s.start)], np.int64).tobytes() + exchange.six(h[s]) + exchange.pack((n[s] > 1).astype(np.uint8))) for b, s in exchange.by_bucket(h, bits)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})

    def met(key, rows):
        keys, several = [], []
        for p in rows["payload"]:
            n = int(np.frombuffer(p, np.int64, 1)[0])
            keys.append(exchange.from_six(p[8 : 8 + n]))
            several.append(exchange.unpack(p[8 + n :])[0])
        h, at = np.unique(np.concatenate(keys), return_inverse=True)
        slot = _slot(h[np.bincount(at, 1 + np.concatenate(several)) > 1])
        words, own = np.unique(slot >> 6, return_inverse=True)
        held = np.zeros(len(words), np.int64)
        np.bitwise_or.at(held, own, np.int64(1) << (slot & 63))
        yield pa.RecordBatch.from_pydict({"word": words, "bits": held})

    sent = classes.select("cls", "sign").mapInArrow(shared.lean(send), "part int, payload binary")
    return shared.bitmap(shared.grouped(sent, "part", [], met, "word long, bits long"))


def _bands(places: np.ndarray, bitmap):
    """Of the buckets that the bitmap has: rows (a, null, null, met) say in how many of them class a is. Of every run of classes, those that
    share a bucket are tied to the run's least there (a, b, null, null), and only that one stands for them in the bucket (a, null, bucket, null)."""

    def run(batches):
        for cls, signs in _signatures(batches, 4096):
            order = np.argsort(cls, kind="stable")
            cls, signs = cls[order], signs[order]
            h = band_hashes(signs, places)
            slot = _slot(h)
            i, j = np.nonzero((bitmap.value[slot >> 6] >> (slot & 63)) & 1)
            met = np.bincount(i, minlength=len(cls))
            bucket, first, own = np.unique(h[i, j], return_index=True, return_inverse=True)  # rows go by class: the first is the least
            head = i[first]
            tie = np.unique((i * np.int64(len(cls)) + head[own])[i != head[own]])
            own = np.flatnonzero(met)
            a = np.concatenate([cls[own], cls[tie // len(cls)], cls[head]])
            at = np.cumsum([len(own), len(tie), len(head)])
            column = lambda values, x, y: pa.concat_arrays([pa.nulls(x, pa.int64()), pa.array(values, pa.int64()), pa.nulls(at[2] - y, pa.int64())])
            yield pa.RecordBatch.from_pydict({"a": a, "b": column(cls[tie % len(cls)], at[0], at[1]), "bucket": column(bucket.view(np.int64), at[1], at[2]), "met": column(met[own], 0, at[0])})

    return run


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 16, 32, ... compared places, the matches under which a pair is dropped: with a uniform prior, the posterior
    probability of similarity >= threshold after m matches of n is P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for n in range(BATCH, PLACES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _links(percent: int, places: np.ndarray, tied: bool = False):
    """Links between the sides of a block, or within its only side; classes of one root are linked already. With `tied`
    everything is compared with each other, and rows (class, null, pivots) say which classes of side 1 each class is
    tied to, itself among them if it's one."""
    floors = least_matches(percent / 100)

    def fn(key, rows):
        ids = np.array(rows["cls"], dtype=np.int64)
        sides = np.array(rows["side"])
        signs = np.frombuffer(b"".join(rows["sign"]), dtype=np.uint16).reshape(-1, PLACES)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        bands = band_hashes(signs, places)
        _, group = np.unique(np.array(rows["root"], dtype=np.int64), return_inverse=True)
        _, first = np.unique(group, return_index=True)
        root = first[group].tolist()

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        own = tied or sides.max() == 0
        right = np.arange(len(ids)) if own else np.flatnonzero(sides == 1)
        for i in np.arange(len(ids)) if own else np.flatnonzero(sides == 0):
            to = right[right > i] if own else right
            to = to[group[to] != group[i]]
            lo, hi = np.minimum(sizes[to], sizes[i]), np.maximum(sizes[to], sizes[i])
            to = to[100 * lo >= percent * hi]
            if not len(to):
                continue
            to = to[(bands[to] == bands[i]).any(axis=1)]
            same = np.zeros(len(to), np.int64)
            for b, floor in enumerate(floors):
                if not len(to):
                    break
                at = slice(b * BATCH, (b + 1) * BATCH)
                same += (signs[to, at] == signs[i, at]).sum(axis=1)
                to, same = to[same >= floor], same[same >= floor]
            for j in to.tolist():
                x, y = find(i), find(j)
                if x == y:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    root[x] = y
                    found.append((ids[i], ids[j], None))
        if tied:
            pivots = {}
            for i in np.flatnonzero(sides == 1).tolist():
                pivots.setdefault(find(i), set()).add(int(ids[i]))
            found += [(ids[i], None, sorted(pivots.get(find(i), ()))) for i in range(len(ids))]
        a, b, p = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.list_(pa.int64()))], names=["a", "b", "pivots"])

    return fn


_FOUND = "a long, b long, pivots array<long>"


def _compared(dealt: DataFrame, percent: int, places: np.ndarray, tied: bool = False) -> DataFrame:
    """Stored links of the blocks of dealt (block, side, cls, root, sign, shingles)."""
    return shared.stored(shared.grouped(dealt, "block", ["side", "cls"], _links(percent, places, tied), _FOUND), "links")


def _across(full: DataFrame, bands: DataFrame, percent: int, places: np.ndarray, block: int) -> DataFrame:
    """(a, b): links of the groups of more than one block. full: cls, sign, grp, parts, shingles; stored."""
    row = ["cls", "sign", "shingles"]
    met = full.select("cls", "grp").join(bands.where("met is not null").select(F.col("a").alias("cls"), "met"), "cls")
    order = Window.partitionBy("grp").orderBy(F.desc("met"), "cls")
    pivots = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select("cls", "place")
    pivots = shared.stored(pivots.join(full, "cls").select("grp", "parts", "place", *row), "pivots")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    dealt = full.select(F.xxhash64("grp", part).alias("block"), F.lit(0).alias("side"), F.col("cls").alias("root"), *row)
    every = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.union(every.select(F.xxhash64("grp", "part").alias("block"), F.lit(1).alias("side"), F.col("cls").alias("root"), *row))
    found = _compared(dealt, percent, places, True)
    near = found.where("b is not null").select("a", "b")
    # Pivots tied to the first one in any block; a pivot stands in its own block twice.
    tied = found.where("b is null").select(F.col("a").alias("cls"), "pivots")
    first = pivots.where("place = 1").select("grp", F.col("cls").alias("first"))
    to_first = pivots.select("cls", "grp").join(tied, "cls").join(first, "grp").where(F.array_contains("pivots", F.col("first")))
    to_first = to_first.groupBy("grp", "first").agg(F.collect_set("cls").alias("settled"))
    own = tied.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("pivots"))).alias("pivots"))
    placed = own.join(full.select("cls", "grp"), "cls").join(to_first, "grp", "left").select("cls", "grp", F.coalesce(F.when(F.arrays_overlap("pivots", "settled"), F.col("first")), F.col("cls")).alias("root"), F.coalesce(~F.arrays_overlap("pivots", "settled"), F.lit(True)).alias("rest"))
    placed = shared.stored(placed, "placed")
    parts = lambda n: F.ceil(n / block).cast("int")
    sizes = placed.groupBy("grp").agg(F.count_if("rest").alias("few"), F.count_if(~F.col("rest")).alias("many")).where("few > 0")
    sizes = shared.stored(sizes.select("grp", parts(F.col("few")).alias("few"), F.greatest(F.lit(1), parts(F.col("many"))).alias("many")), "sizes")
    left = full.select("grp", *row).join(placed.select("cls", "root", "rest"), "cls").join(sizes, "grp")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.col(n)).cast("int")
    rest = left.where("rest").withColumn("part", place("few"))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    dealt = rest.withColumn("other", upto("few")).select(F.xxhash64("grp", F.lit("rest"), i, j).alias("block"), F.when(F.col("part") == i, 0).otherwise(1).alias("side"), "root", *row)
    dealt = dealt.union(rest.withColumn("other", upto("many")).select(F.xxhash64("grp", F.lit("most"), "part", "other").alias("block"), F.lit(0).alias("side"), "root", *row))
    large = left.where("not rest").withColumn("part", place("many")).withColumn("other", upto("few"))
    dealt = dealt.union(large.select(F.xxhash64("grp", F.lit("most"), "other", "part").alias("block"), F.lit(1).alias("side"), "root", *row))
    return near.union(_compared(dealt, percent, places).select("a", "b"))


def links(docs: DataFrame, sketch: DataFrame, k: int, percent: int, id_col: str, text_col: str, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes (cls, rep: least doc_id, n, sign) and verified links (a, b) between them, which span the components."""
    block = block or BLOCK
    classes = sketch.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"))
    classes = shared.stored(classes, "classes")
    places = band_places(percent / 100)
    # Smaller sets reach the threshold only when equal.
    large = classes.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n") + 1))
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_buckets(large, places))
    bands = shared.stored(large.select("cls", "sign").mapInArrow(shared.lean(_bands(places, bitmap)), "a long, b long, bucket long, met long"), "bands")
    firsts = bands.where("bucket is not null").select("a", "bucket")
    heads = firsts.groupBy("bucket").agg(F.min("a").alias("head"), F.max("a").alias("last"), F.count(F.lit(1)).alias("n")).where("head <> last")
    heads = shared.stored(heads.select("bucket", "head", "n"), "heads")
    ties = shared.keyed_join(firsts, heads, "bucket").where("a <> head").select("a", F.col("head").alias("b"))
    ties = ties.union(bands.where("b is not null").select("a", "b"))
    groups = shared.stored(components(ties).select(F.col("node").alias("cls"), F.col("root").alias("grp")), "groups")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block)
    sizes = shared.stored(sizes, "large")
    members = shared.stored(groups.join(sizes, "grp", "left").join(classes, "cls").select("cls", "rep", "sign", "grp", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int").alias("parts")), "members")

    def sets(batches):
        for batch in batches:
            keep, out = [], []
            cls = batch.column(0).to_pylist()
            for i, s in enumerate(shingle_sets(batch.column(4), k)):
                if class_key(s) == cls[i]:
                    keep.append(i)
                    out.append(s.tobytes())
            rest = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array(out, pa.binary())], names=["cls", "sign", "grp", "parts", "shingles"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("rep"), F.col(text_col).cast("string").alias("text"))
    members = members.withColumn("rep", F.coalesce("rep", F.lit(-1)))
    # Only texts that stand for a class of a group are shuffled.
    texts = shared.sieve(texts, F.col("rep"), members, "rep", "maybe").where("maybe").drop("maybe")

    def with_sets(some):
        # A repeated id may stand for several texts and rows: one that has the class's set is enough.
        found = some.join(texts, "rep").select("cls", "sign", "grp", "parts", "text")
        return found.mapInArrow(shared.lean(sets), "cls long, sign binary, grp long, parts int, shingles binary")

    few = with_sets(members.where("parts = 1")).select(F.col("grp").alias("block"), F.lit(0).alias("side"), F.col("cls").alias("root"), "cls", "sign", "shingles")
    pairs = _compared(few, percent, places).select("a", "b")
    if sizes.limit(1).count():
        many = with_sets(members.where("parts > 1")).groupBy("cls").agg(*(F.first(c).alias(c) for c in ("sign", "grp", "parts", "shingles")))
        pairs = pairs.union(_across(shared.stored(many, "sets"), bands, percent, places, block))
    return classes, shared.stored(pairs, "links")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked, directly or not), kept (doc_id = component_id)."""
    sketch = shared.stored(sketches(docs, k, id_col, text_col), "sketch")
    classes, pairs = links(docs, sketch.select("doc_id", "n_shingles", "cls", "sign"), k, percent, id_col, text_col)
    roots = components(pairs).withColumnRenamed("node", "cls")
    placed = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = shared.stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    labels = shared.stored(placed.join(least, "root").select("cls", "component_id"), "labels")
    # Empty sets look for themselves under keys of their own, so that they don't meet in one task.
    slim = sketch.select("doc_id", "n_shingles", F.when(F.col("cls") == 0, F.xxhash64(F.lit("empty"), "doc_id")).otherwise(F.col("cls")).alias("cls"))
    out = slim.join(labels, "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose near copy with the least doc_id stays. Only documents that may go are shuffled."""
    (maybe,) = shared.fresh(docs.columns, "maybe")
    gone = shared.stored(near_groups(docs, k, percent).where("not kept").select("doc_id"), "gone")
    marked = shared.sieve(docs, F.col("doc_id").cast("long"), gone, "doc_id", maybe)
    left = marked.where(F.col(maybe)).join(gone, "doc_id", "left_anti").select(docs.columns)
    return marked.where(~F.col(maybe)).select(docs.columns).unionByName(left)
