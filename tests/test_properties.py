"""Properties: sums, idempotence, unique assignment, same rows for any number of partitions, plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import SMALL
from kinlink.functions import similarity, text
from kinlink.operators import blocking, decision, relational
from kinlink.plans import catalog
from kinlink.plans.views import Views

WORD = st.text("abcdé x", max_size=12)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_similarities(a, b):
    for kernel in (similarity.jaro_winkler_of, similarity.ratio_of, similarity.token_sort_of, similarity.token_set_of):
        assert kernel(a, b) == pytest.approx(kernel(b, a))
    assert 0 <= similarity.jaro_winkler_of(a, b) <= 1
    assert similarity.ratio_of(a, a) == 100.0
    assert similarity.partial_of(a, b) >= similarity.ratio_of(a, b) - 1e-9
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common_subsequence(a, b) == table[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_romanisation_is_ascii_and_settled(s):
    once = text.romanised(s)
    assert once.isascii()
    assert text.romanised(once) == once


def test_distributions_sum_to_one(spark):
    rows = spark.range(50).withColumn("ps", F.transform(F.sequence(F.lit(1), F.col("id") % 9 + 1), lambda i: F.rand(3) * 0 + (i * 7 % 10) / 10.0))
    sums = rows.select(F.aggregate(decision.pmf(F.col("ps")), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0


def test_each_query_is_assigned_once(spark):
    v = Views(spark, SMALL)
    for kept in (decision.assign(v.scores(), 0.4), decision.assign_expected(v.scores().where("p >= 0.6")), decision.fill_empty(v.scores(), 0.8, 0.2)):
        assert kept.groupBy("q").count().where("count > 1").count() == 0


def test_candidates_hold_every_exact_name(spark):
    v = Views(spark, SMALL)
    pairs = blocking.top_names(*v.name_docs(), *v.members())
    s, q = v.sides()
    same = s.where("name <> ''").select("country", "name", F.col("entity_id").alias("s1")).join(q.select("country", "name", F.col("entity_id").alias("q")), ["country", "name"])
    missed = same.join(pairs, ["s1", "q"], "left_anti").join(pairs.groupBy("q").count(), "q").where("count < 10")
    assert missed.count() == 0


@pytest.mark.parametrize("name", ["best_match", "assign_expected", "hard_negative_cap", "kth_largest", "peer_share", "greedy_slice", "exact_twins"])
def test_any_number_of_partitions(spark, name):
    out = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, catalog.queries()[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["projected_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan


def test_top_k_is_pruned_before_the_shuffle(spark):
    v = Views(spark, SMALL)
    plan = relational.best_per_query(v.scores())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
