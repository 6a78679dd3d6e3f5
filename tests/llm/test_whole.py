"""Cases in which a bounded list, a sample or a size switch must not cost results."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from common import components as close
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import near_dedup, shared, vector_dedup


def vectors_near(rows, threshold=0.98):
    """{vec_id: (n_links, component_id)} by brute force; rows of (vec_id, embedding, label)."""
    links, n = [], {}
    labels = np.array([k for _, _, k in rows])
    x = np.array([e for _, e, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(len(rows)):
        to = np.flatnonzero((x @ x[i] >= threshold) & (labels == labels[i]))
        n[rows[i][0]] = len(to) - 1
        links += [(rows[i][0], rows[j][0]) for j in to.tolist() if j != i]
    roots = close(set(n), links)
    return {i: (n[i], roots[i]) for i in n}


def near(spark, rows):
    out = vector_dedup.near_vectors(spark.createDataFrame([(i, e.tolist(), k) for i, e, k in rows], "vec_id long, embedding array<double>, label int"))
    return {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}


def test_groups_larger_than_lists(spark):
    r = np.random.default_rng(1)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[:2] = 1, (0.985, np.sqrt(1 - 0.985**2))
    rows = [(i, (a if i < 60 else b) + 0.0005 * r.standard_normal(16), 0) for i in range(120)]
    expected = vectors_near(rows)
    assert set(expected.values()) == {(119, 0)}
    assert near(spark, rows) == expected


def table(spark, rows):
    """Class rows as near_vectors makes them."""
    data = [(i, i, 1, k, (e / np.linalg.norm(e)).tobytes()) for i, e, k in rows]
    return spark.createDataFrame(data, "cls long, rep long, copies long, blk long, vec binary")


def pairs_and_group():
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 24))
    rows = [(2 * i + j, base[i] + 0.001 * j * r.standard_normal(24), 0) for i in range(40) for j in range(2)]
    return rows + [(100 + i, base[0] * 0 + 1 + 0.001 * r.standard_normal(24), 0) for i in range(100)]


def test_audit_weighs_classes_alike(spark):
    nodes = table(spark, pairs_and_group())
    # All links of the group are found and none of the pairs': 9,900 of 9,980.
    found = spark.createDataFrame([(i, 0) for i in range(80)] + [(100 + i, 99) for i in range(100)], "cls long, n_links long")
    assert vector_dedup.audit(nodes, found, 0.98, 1000) < 0.6
    found = spark.createDataFrame([(i, 1) for i in range(80)] + [(100 + i, 99) for i in range(100)], "cls long, n_links long")
    assert vector_dedup.audit(nodes, found, 0.98, 1000) == 1


def test_failing_audit_ends_in_whole_blocks(spark, monkeypatch):
    rows = pairs_and_group()
    monkeypatch.setattr(vector_dedup, "refine", lambda nodes, lists, *_: (lists, 0))
    merged = vector_dedup._merged
    monkeypatch.setattr(vector_dedup, "_merged", lambda lists, fresh, *a: merged(lists, fresh.where("false"), *a))
    assert near(spark, rows) == vectors_near(rows)


def test_bits_follow_each_block(spark):
    sizes = spark.createDataFrame([(1,), (256,), (257,), (1_000_000,)], "n long")
    assert [r[0] for r in sizes.orderBy("n").select(vector_dedup.projection_bits(F.col("n"))).collect()] == [0, 0, 3, 14]
    together = 1 - np.arccos(0.98) / np.pi
    for bits in (3, 8, 14, 18, 20):
        assert (1 - together**bits) ** vector_dedup.tables_for(bits, 0.98) <= 1e-3


def test_small_label_beside_a_large_one(spark, monkeypatch):
    """First neighbours alone, unrefined and unaudited, hold every pair of a small label."""
    r = np.random.default_rng(3)
    rows = [(1000 + i, r.standard_normal(12), 1) for i in range(6000)]
    base = r.standard_normal((60, 12))
    for i, x in enumerate(base):
        x /= np.linalg.norm(x)
        y = r.standard_normal(12)
        y -= (y @ x) * x
        rows += [(2 * i, x, 0), (2 * i + 1, 0.9805 * x + np.sqrt(1 - 0.9805**2) * y / np.linalg.norm(y), 0)]
    monkeypatch.setattr(vector_dedup, "refine", lambda nodes, lists, *_: (lists, 0))
    monkeypatch.setattr(vector_dedup, "audit", lambda *_: 1.0)
    found, expected = near(spark, rows), vectors_near(rows)
    assert {i: found[i] for i in range(120)} == {i: expected[i] for i in range(120)}


@pytest.mark.parametrize(("t", "odd"), [(0.85, 30), (0.8, 36)])
def test_bands_at_the_threshold(t, odd):
    """Simulated with the code's own bands: pairs at the threshold, and those with unusually many mismatches."""
    places, r = near_dedup.band_places(t), np.random.default_rng(4)

    def missed(differ):
        return float(np.all([differ[:, p].any(axis=1) for p in places], axis=0).mean())

    assert missed(r.random((20_000, 128)) >= t) == 0
    assert missed(r.random((20_000, 128)).argsort(axis=1) < odd) < 5e-4
    assert near_dedup.miss_rate(t, len(places)) <= near_dedup.MISS


def test_language_stage_without_a_model(spark):
    docs = spark.createDataFrame([(1, "ein Text", None), (2, "12 34", None), (3, None, None), (4, "слово", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_norms_of_any_size(spark):
    """Squares of these over- or underflow; and a null id."""
    rows = [(1, [1e200] * 8, "a"), (2, [2e200] * 8, "a"), (3, [1e-200] * 8, "a"), (4, [5e-324, 0.0], "b"), (5, [1e308, 0.0], "b"), (6, [0.0, 1.0], "b"), (None, [1.0] * 8, "a"), (8, [1.0, float("nan")], "b")]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: r.n_links for r in out} == {1: 3, 2: 3, 3: 3, None: 3, 4: 1, 5: 1, 6: 0, 8: 0}
    assert {r.vec_id: r.component_id for r in out if r.vec_id} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 8: 8}


def test_fresh_names():
    assert shared.fresh(["Score", "_score", "x"], "score", "lang", "Lang") == ["__score", "lang", "_Lang"]


def test_groups_larger_than_blocks(spark, monkeypatch):
    """Copies of one text that are linked through it alone, a chain, and a loose cloud, in blocks of 16."""
    import random

    from common import near_copies

    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    base = [r.choice(vocab) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for at in r.sample(range(len(w)), 2):
            w[at] = f"new{i}"
        rows.append((i, " ".join(w)))
    w = [r.choice(vocab) for _ in range(120)]
    for i in range(100, 160):  # each is near the one before, the last far from the first
        w[(i * 2) % 120] = f"step{i}"
        rows.append((i, " ".join(w)))
    cloud = [r.choice(vocab) for _ in range(100)]
    for i in range(200, 260):
        w = list(cloud)
        for at in r.sample(range(len(w)), r.randint(2, 6)):
            w[at] = f"odd{i}x{at}"
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    out = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    roots, _ = near_copies(rows, 3, 85)
    assert {x.doc_id: x.component_id for x in out} == roots
    assert len({roots[i] for i in range(90)}) < len({roots[i] for i in range(200, 260)})


def test_a_bucket_gets_one_class_of_a_run():
    places = near_dedup.band_places(0.8)
    sign = np.arange(near_dedup.PLACES, dtype=np.uint16)
    other = sign + np.uint16(1000)
    batch = pa.RecordBatch.from_pydict({"cls": pa.array([9, 5, 7, 2], pa.int64()), "sign": [x.tobytes() for x in (sign, sign, sign, other)]})
    everything = SimpleNamespace(value=np.full(1 << (shared.SIEVE_BITS - 6), -1, np.int64))
    rows = [r for b in near_dedup._bands(places, everything)([batch]) for r in b.to_pylist()]
    n = len(places)
    assert {(r["a"], r["met"]) for r in rows if r["met"]} == {(x, n) for x in (2, 5, 7, 9)}
    assert sorted((r["a"], r["b"]) for r in rows if r["b"]) == [(7, 5), (9, 5)]
    heads = [(r["a"], r["bucket"]) for r in rows if r["bucket"]]
    assert len(heads) == len(set(heads)) == 2 * n and {a for a, _ in heads} == {2, 5}
