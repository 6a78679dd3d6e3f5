"""The pipeline's stages, each on what its predecessor kept, against brute force; and the queries against their SQL."""

import re

import pytest
from common import contamination, frame, line_dedup, make_docs, mixed as plain_mix, near_copies, words
from oracle import connect, same
from pyspark.sql import functions as F

import corpus_pipeline as C
from kinlink.llm import language, registry, shared

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def _stages(spark, docs, folder):
    out = [docs]
    for _, stage in C.STAGES:
        out.append(shared.stored(stage(spark, out[-1], folder)))
    return out


def _mixed(docs):
    """The last stage, plainly."""
    rows, weights = [], {}
    for r in docs.collect():
        digits = re.search("[0-9]+$", r.source or "")
        k = int(digits[0]) if digits else 0
        leaf = (("web", "books", "code")[k % 3], r.lang or "", r.source or "")
        weights[leaf] = ({"web": 5, "books": 3, "code": 2}[leaf[0]], {"en": 6, "de": 2}.get(leaf[1], 1), k % 4 + 1)
        rows.append((r.doc_id, leaf, len(words(r.text))))
    return plain_mix(rows, weights, lambda total: total * 3 // 10, 2, 7)


def test_stages_equal_brute_force(spark):
    docs = shared.stored(frame(spark, make_docs(3)))
    start, lang, lines, near, clean, mixed = _stages(spark, docs, SMALL)
    has_letter = lambda t: any(language.letters(t or ""))
    assert _rows(lang) == sorted([x for x in _rows(start) if has_letter(x[1])], key=str)
    assert lang.where("lang is null").count() == 0
    expected = [(d, t) for d, t, n, gone in line_dedup(_rows(lang)) if not (gone and gone == n)]
    assert _rows(lines) == sorted(expected, key=str)
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    roots, _ = near_copies(_rows(lines), 5, 80)
    assert _rows(near) == [x for x in _rows(lines) if roots[x[0]] == x[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {d: h for d, _, h, _, _ in contamination(_rows(near), items)}
    assert all(h == 0 for _, _, h, _, _ in contamination(_rows(clean), items))
    kept = dict(_rows(clean))
    assert all(kept[d] == t for d, t in _rows(near) if not before[d])
    assert sorted([(r.doc_id, r.n_copies) for r in mixed.collect()], key=str) == _mixed(clean)
    own = [c for c in docs.columns if c not in ("text", "lang", "n_chars")]
    for df in (lang, lines, near, clean):
        assert df.columns == docs.columns
        assert sorted(map(str, df.select(own).exceptAll(docs.select(own)).collect())) == []
    assert set(docs.columns) <= set(mixed.columns)
    assert any(d is None for d, _ in _rows(clean))


def test_run_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    *_, clean, mixed = _stages(spark, docs, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert all(h == 0 for _, _, h, _, _ in contamination(_rows(clean), items))
    assert sorted([(r.doc_id, r.n_copies) for r in mixed.collect()], key=str) == _mixed(clean)
    assert sorted(map(str, C.run(spark, SMALL).collect())) == sorted(map(str, mixed.collect()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, connect(SMALL), SMALL, registry.queries()[name], registry.oracle_sql()[name])
