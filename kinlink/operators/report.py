"""Metrics, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.relational import best_per_query, digitize


def f_score(tp: Column, fp: Column, n: Column, fp_weight: float = 1.0) -> Column:
    """F0.5 of one master: 1 if nothing is true or kept, 0 if one of them is empty or nothing agrees."""
    precision, recall = tp / (tp + fp_weight * fp), tp / n
    return F.when((n == 0) & (tp + fp == 0), 1.0).when((n == 0) | (tp == 0), 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def entity_scores(masters: DataFrame, kept: DataFrame, truth: DataFrame, fp_weight: float = 1.0) -> DataFrame:
    """(s1, tp, fp, n, f) for every master."""
    t = truth.select("s1", F.col("other").alias("q"), F.lit(1).alias("t"))
    k = kept.select("s1", "q").distinct().withColumn("k", F.lit(1))
    both = t.join(k, ["s1", "q"], "full").fillna(0, ["t", "k"])
    sums = both.groupBy("s1").agg(F.sum(F.col("t") * F.col("k")).alias("tp"), F.sum(F.col("k") * (1 - F.col("t"))).alias("fp"), F.sum("t").alias("n"))
    out = masters.select("s1").distinct().join(sums, "s1", "left").fillna(0, ["tp", "fp", "n"])
    return out.withColumn("f", f_score(F.col("tp"), F.col("fp"), F.col("n"), fp_weight))


def macro_f(masters: DataFrame, kept: DataFrame, truth: DataFrame, fp_weight: float = 1.0) -> DataFrame:
    return entity_scores(masters, kept, truth, fp_weight).agg(F.avg("f").alias("f05"), F.count(F.lit(1)).alias("masters"))


def threshold_grid(masters: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float], fp_weight: float = 1.0) -> DataFrame:
    """(threshold, f05): all thresholds in one pass over the best pairs; the best is the first by (-f05, threshold)."""
    best = best_per_query(pairs)
    t = truth.select("s1", F.col("other").alias("q"), F.lit(1).alias("t"))
    labelled = best.join(t, ["s1", "q"], "left").fillna(0, ["t"])
    n = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.array(*(F.lit(float(g)) for g in grid))
    sums = labelled.select("s1", "t", F.explode(F.filter(cuts, lambda g: g <= F.col("p"))).alias("threshold")).groupBy("s1", "threshold").agg(F.sum("t").alias("tp"), F.sum(1 - F.col("t")).alias("fp"))
    everyone = masters.select("s1").distinct().select("s1", F.explode(cuts).alias("threshold"))
    rows = everyone.join(sums, ["s1", "threshold"], "left").join(n, "s1", "left").fillna(0, ["tp", "fp", "n"])
    return rows.groupBy("threshold").agg(F.avg(f_score(F.col("tp"), F.col("fp"), F.col("n"), fp_weight)).alias("f05"))


def log_loss(rows: DataFrame) -> DataFrame:
    """log_loss, accuracy and positive rate of p against y."""
    c = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.agg(F.avg(-(F.col("y") * F.log(c) + (1 - F.col("y")) * F.log(1 - c))).alias("log_loss"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.col("y").cast("double")).alias("positive_rate"))


def _wrong(candidates: DataFrame, scored: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, q, cause) of every wrong record of a master, by the first cause that holds."""
    t = truth.select("s1", F.col("other").alias("q")).distinct()
    k = kept.select("s1", "q").distinct()
    owner = kept.select("q", F.lit(1).alias("owned")).distinct()
    flag = lambda df, name: df.select("s1", "q", F.lit(1).alias(name)).distinct()
    lost = t.join(k, ["s1", "q"], "left_anti").join(flag(candidates, "found"), ["s1", "q"], "left").join(flag(scored, "scored"), ["s1", "q"], "left").join(owner, "q", "left")
    cause = F.when(F.col("found").isNull() & F.col("scored").isNull(), "missed").when(F.col("scored").isNull(), "dropped").when(F.col("owned").isNotNull(), "lost_to_other").otherwise("below_threshold")
    real, whole = t.select("q", F.lit(1).alias("real")).distinct(), t.select("s1", F.lit(1).alias("has")).distinct()
    false = k.join(t, ["s1", "q"], "left_anti").join(real, "q", "left").join(whole, "s1", "left")
    kind = F.when(F.col("has").isNull(), "singleton").when(F.col("real").isNull(), "distractor").otherwise("false_other")
    return lost.select("s1", "q", cause.alias("cause")).unionByName(false.select("s1", "q", kind.alias("cause")))


def loss_decomposition(masters: DataFrame, candidates: DataFrame, scored: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(cause, records, loss): every master's loss 1 - f spread evenly over its wrong records, by seven causes: missed (never a candidate),
    dropped (a candidate that the first stage left out), lost_to_other (assigned to another master), below_threshold; distractor (kept,
    belongs to none), false_other (kept, belongs to another master), and singleton (a master without records was given some; it counts
    once)."""
    wrong = _wrong(candidates, scored, kept, truth)
    wrong = wrong.withColumn("q", F.when(F.col("cause") != "singleton", F.col("q"))).distinct()
    n = wrong.groupBy("s1").agg(F.count(F.lit(1)).alias("wrong"))
    rows = wrong.join(n, "s1").join(entity_scores(masters, kept, truth).select("s1", "f"), "s1")
    total = masters.select("s1").distinct().count() or 1
    return rows.groupBy("cause").agg(F.count(F.lit(1)).alias("records"), (F.sum((1 - F.col("f")) / F.col("wrong")) / total).alias("loss"))


def loss_by_kind(masters: DataFrame, candidates: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, masters, loss): every master's loss split evenly over the kinds of error that it shows: distractor, false_other, model (a true
    candidate that isn't kept), missed (a true record that never was one), or singleton."""
    wrong = _wrong(candidates, candidates, kept, truth)
    kinds = wrong.select("s1", F.when(F.col("cause").isin("lost_to_other", "below_threshold", "dropped"), "model").otherwise(F.col("cause")).alias("kind")).distinct()
    n = kinds.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    rows = kinds.join(n, "s1").join(entity_scores(masters, kept, truth).select("s1", "f"), "s1")
    total = masters.select("s1").distinct().count() or 1
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("masters"), (F.sum((1 - F.col("f")) / F.col("n")) / total).alias("loss"))


def cluster_shape(masters: DataFrame, kept: DataFrame, source: Column) -> DataFrame:
    """(country, masters, singletons, large, s2, s3): kept records by source, masters with none and with eight or more."""
    per = kept.groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.sum((source == 2).cast("int")).alias("n2"), F.sum((source == 3).cast("int")).alias("n3"))
    rows = masters.select("s1", "country").join(per, "s1", "left").fillna(0, ["n", "n2", "n3"])
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("masters"), F.sum((F.col("n") == 0).cast("int")).alias("singletons"), F.sum((F.col("n") >= 8).cast("int")).alias("large"), F.sum("n2").alias("s2"), F.sum("n3").alias("s3"), F.avg("n").alias("per_s1"))


def proxy_report(masters: DataFrame, kept: DataFrame, words: DataFrame, names: DataFrame) -> DataFrame:
    """Without labels: matches per master, share of singletons, share of kept records with a modifier word that the master's name lacks. names:
    entity_id, name_core; words: country, token."""
    per = masters.select("s1", "country").join(kept.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "s1", "left").fillna(0, ["n"])
    shape = per.groupBy("country").agg(F.avg("n").alias("matches_per_s1"), F.avg((F.col("n") == 0).cast("double")).alias("singletons"))
    a = names.select(F.col("entity_id").alias("s1"), F.col("name_core").alias("a"))
    b = names.select(F.col("entity_id").alias("q"), F.col("name_core").alias("b"))
    extra = kept.join(masters.select("s1", "country"), "s1").join(a, "s1").join(b, "q").select("s1", "q", "country", F.explode(F.array_except("b", "a")).alias("token"))
    hits = extra.join(words.select("country", "token"), ["country", "token"], "left_semi").select("s1", "q", "country").distinct().groupBy("country").agg(F.count(F.lit(1)).alias("hits"))
    total = kept.join(masters.select("s1", "country"), "s1").groupBy("country").agg(F.count(F.lit(1)).alias("kept"))
    return shape.join(total, "country", "left").join(hits, "country", "left").select("country", "matches_per_s1", "singletons", F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), "kept"), F.lit(0.0)).alias("modifier_share"))


def validate(lists: DataFrame, masters: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, violations) of id lists (s1, ids): duplicate rows, repeated ids in a list, the master in its own list, foreign prefix, unknown id,
    missing and unknown masters, and, with candidate lists, ids that aren't candidates."""
    ids = lists.select("s1", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("q"))
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    rows = [
        count(lists.groupBy("s1").count().where("count > 1"), "duplicate_rows"),
        count(ids.groupBy("s1", "q").count().where("count > 1"), "repeated_ids"),
        count(ids.where("s1 = q"), "self_match"),
        count(ids.where(~(F.col("q").startswith("S2-") | F.col("q").startswith("S3-"))), "wrong_prefix"),
        count(ids.join(known.select(F.col("entity_id").alias("q")), "q", "left_anti"), "unknown_id"),
        count(masters.select("s1").join(lists, "s1", "left_anti"), "missing_master"),
        count(lists.select("s1").distinct().join(masters, "s1", "left_anti"), "unknown_master"),
    ]
    if candidates is not None:
        c = candidates.select("s1", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("q"))
        rows.append(count(ids.join(c, ["s1", "q"], "left_anti"), "not_a_candidate"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def band_density(pairs: DataFrame, masters: DataFrame, edges: list[float]) -> DataFrame:
    """(country, band, per_s1, true_share) of best pairs with y."""
    rows = best_per_query(pairs).withColumn("band", digitize(F.col("p"), edges))
    n = masters.groupBy("country").agg(F.count(F.lit(1)).alias("m"))
    return rows.groupBy("country", "band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("true_share")).join(n, "country").select("country", "band", (F.col("n") / F.col("m")).alias("per_s1"), "true_share")


def cell_density(rows: DataFrame, reference: DataFrame, keys: list[str], masters: int, reference_masters: int) -> DataFrame:
    """Per cell: records per master here and in the reference, and the reference's true records per master over ours as an estimated precision."""
    a = rows.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(masters)).alias("density"))
    b = reference.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(reference_masters)).alias("ref_density"), (F.sum("y") / F.lit(reference_masters)).alias("ref_true"))
    return a.join(b, keys, "left").fillna(0.0, ["ref_density", "ref_true"]).withColumn("precision", F.least(F.lit(1.0), F.col("ref_true") / F.col("density")))


def rule_effect(pairs: DataFrame, flag: Column) -> DataFrame:
    """How a rule flags true and false pairs (y): rates and the precision of dropping what it flags."""
    f = flag.cast("int")
    return pairs.agg(F.sum(f).alias("flagged"), F.avg(F.when(F.col("y") == 1, f)).alias("true_rate"), F.avg(F.when(F.col("y") == 0, f)).alias("false_rate"), F.try_divide(F.sum(f * (1 - F.col("y"))), F.sum(f)).alias("precision"))


def state_shift(truth: DataFrame, states: DataFrame) -> DataFrame:
    """(s_state, q_state, n, kind) of true pairs."""
    t = truth.join(states.select(F.col("entity_id").alias("s1"), F.col("state").alias("s_state")), "s1").join(states.select(F.col("entity_id").alias("other"), F.col("state").alias("q_state")), "other")
    kind = F.when(F.col("s_state") == "", "no_state").when(F.col("q_state") == "", "empty").when(F.col("s_state") == F.col("q_state"), "same").otherwise("other")
    return t.groupBy("s_state", "q_state").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind)


def coverage(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """How many tokens (token) the table (native) knows: n, known, share."""
    rows = tokens.join(table.select(F.col("native").alias("token"), F.lit(1).alias("k")).distinct(), "token", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("known")).withColumn("share", F.col("known") / F.col("n"))


def frequency_ratios(a: DataFrame, b: DataFrame, least: int, per: int = 10_000) -> DataFrame:
    """(token, rate_a, rate_b, ratio) of tokens in at least `least` records of b; a and b have name_core."""
    def rates(df, name):
        n = df.agg(F.count(F.lit(1)).alias("n"))
        t = df.select(F.explode(F.array_distinct("name_core")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        return t.crossJoin(F.broadcast(n)).select("token", F.col("c").alias(f"c_{name}"), (F.col("c") * per / F.col("n")).alias(f"rate_{name}"))

    both = rates(b, "b").where(F.col("c_b") >= least).join(rates(a, "a"), "token", "left").fillna(0.0, ["rate_a"])
    return both.select("token", "rate_a", "rate_b", (F.col("rate_b") / F.greatest(F.col("rate_a"), F.lit(0.1))).alias("ratio"))


def record_budget(records: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, masters, records, assigned, true_records, per_s1)."""
    base = records.groupBy("country").agg(F.sum((F.col("src") == 1).cast("int")).alias("masters"), F.sum((F.col("src") > 1).cast("int")).alias("records"))
    c = records.select(F.col("entity_id").alias("q"), "country")
    a = kept.select("q").distinct().join(c, "q").groupBy("country").agg(F.count(F.lit(1)).alias("assigned"))
    t = truth.select(F.col("other").alias("q")).distinct().join(c, "q").groupBy("country").agg(F.count(F.lit(1)).alias("true_records"))
    return base.join(a, "country", "left").join(t, "country", "left").fillna(0, ["assigned", "true_records"]).withColumn("per_s1", F.try_divide("true_records", "masters"))


def unscored(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(country, unscored, with_namesake): records that no pair has, and those of them with a master of the same name. records have name."""
    free = records.where("src > 1").join(pairs.select(F.col("q").alias("entity_id")).distinct(), "entity_id", "left_anti")
    named = records.where("src = 1 and name <> ''").select("country", "name", F.lit(1).alias("hit")).distinct()
    return free.join(named, ["country", "name"], "left").groupBy("country").agg(F.count(F.lit(1)).alias("unscored"), F.sum(F.coalesce("hit", F.lit(0))).alias("with_namesake"))


def decile_rates(rows: DataFrame, order: str, flag: str) -> DataFrame:
    """(decile, n, rate) of a flag by place in the order, by exact rank over range-partitioned counts."""
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    step = max(1, ((hi or 0) - (lo or 0)) // 10 + 1)
    return rows.withColumn("decile", ((F.col(order) - (lo or 0)) / step).cast("int")).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


def percentiles(df: DataFrame, column: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as columns p0, p1, ..."""
    aggs = [F.percentile(column, s).alias(f"p{i}") for i, s in enumerate(shares)]
    return df.groupBy(*(keys or [])).agg(*aggs)


def relation_shares(pairs: DataFrame, code: Column) -> DataFrame:
    """(y, code, n, share): how codes spread among true and false pairs."""
    n = pairs.withColumn("code", code).groupBy("y", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))
