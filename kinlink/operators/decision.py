"""Assignment, decision rules and calibration. A master's kept candidates are its group; groups come as arrays of p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import constants as K
from kinlink.functions.text import related
from kinlink.operators.relational import best_per_query, cell_table, digitize, kth


def assign(pairs: DataFrame, threshold: float) -> DataFrame:
    """Each query's best master, where it reaches the threshold."""
    return best_per_query(pairs).where(F.col("p") >= threshold)


def assign_by_country(pairs: DataFrame, thresholds: dict[str, float], default: float = 0.75) -> DataFrame:
    t = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)), F.col("country")), F.lit(default)) if thresholds else F.lit(default)
    return best_per_query(pairs).where(F.col("p") >= t)


def pmf(ps: Column) -> Column:
    """Distribution of how many of independent events with probabilities ps happen."""
    zero = F.array(F.lit(0.0))
    step = lambda a, p: F.zip_with(F.concat(F.transform(a, lambda x: x * (1 - p)), zero), F.concat(zero, F.transform(a, lambda x: x * p)), lambda u, v: u + v)
    return F.aggregate(ps, F.array(F.lit(1.0)), step)


def expected_f(ps: Column, m: Column, unfound: Column | float, fp_weight: float = 1.0) -> Column:
    """Expected F0.5 of keeping the first m of ps when `unfound` is the chance of one more true record that has no pair; nothing kept
    scores 1 if nothing is true. `fp_weight` multiplies false pairs."""
    u = F.lit(unfound) if isinstance(unfound, float) else unfound
    kept, rest = pmf(F.slice(ps, F.lit(1), m)), pmf(F.concat(F.slice(ps, m + 1, F.greatest(F.size(ps) - m, F.lit(0))), F.array(u)))
    score = lambda t, f: F.when(t == 0, 0.0).otherwise(1.25 * t / (t + fp_weight * (m - t) + 0.25 * (t + f)))
    both = F.transform(kept, lambda a, t: F.aggregate(F.transform(rest, lambda b, f: a * b * score(t, f)), F.lit(0.0), lambda x, y: x + y))
    total = F.aggregate(both, F.lit(0.0), lambda x, y: x + y)
    none = F.aggregate(F.transform(ps, lambda p: 1 - p), F.lit(1.0), lambda x, y: x * y) * (1 - u)
    return F.when(m == 0, none).otherwise(total)


def _groups(pairs: DataFrame, min_p: float) -> DataFrame:
    """(s1, g: its records by falling p, as structs of q and p) of each query's best master."""
    best = best_per_query(pairs).where(F.col("p") >= min_p)
    groups = best.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("q"), F.col("p")))).alias("g"))
    return groups.select("s1", F.transform("g", lambda x: F.struct(x["q"].alias("q"), x["p"].alias("p"))).alias("g"))


def _best_prefix(groups: DataFrame, unfound: float, min_p: float, odds_div: float, sure: float) -> DataFrame:
    """(s1, q, p): dividing odds keeps the order, so that groups serve every divisor."""
    p = lambda x: x["p"] / (x["p"] + odds_div * (1 - x["p"]))
    shrunk = F.filter(F.transform("g", lambda x: F.struct(x["q"].alias("q"), p(x).alias("p"))), lambda x: x["p"] >= min_p)
    groups = groups.withColumn("g", shrunk).where(F.size("g") > 0).withColumn("ps", F.transform("g", lambda x: x["p"]))
    # Cubic in the group, which holds only the records whose best master this is.
    values = F.transform(F.sequence(F.lit(0), F.size("ps")), lambda m: F.struct(expected_f(F.col("ps"), m, unfound).alias("v"), (-m).alias("m")))
    chosen = F.when(F.element_at("ps", -1) >= sure, F.size("ps")).otherwise(-F.array_max(values)["m"])
    return groups.withColumn("m", chosen).where("m > 0").select("s1", F.explode(F.slice("g", F.lit(1), F.col("m"))).alias("x")).select("s1", F.col("x.q").alias("q"), F.col("x.p").alias("p"))


def assign_expected(pairs: DataFrame, unfound: float = 0.02, min_p: float = 0.05, odds_div: float = 1.0, sure: float = 0.985) -> DataFrame:
    """Of each master's candidates, the prefix by p with the highest expected F0.5 (the shortest of equals); groups that are sure
    throughout stay whole. Odds are divided by `odds_div` first."""
    return _best_prefix(_groups(pairs, min_p), unfound, min_p, odds_div, sure)


def plugin_expected_f(ps: Column, m: Column, miss: float) -> Column:
    """Expected F0.5 with means in place of distributions, and `miss` expected records without a pair."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    tp, every = add(F.slice(ps, F.lit(1), m)), add(ps) + miss
    none = F.aggregate(F.transform(ps, lambda p: 1 - p), F.lit(1.0), lambda x, y: x * y) * F.exp(F.lit(-miss))
    return F.when(m == 0, none).otherwise(1.25 * tp / (m + 0.25 * every))


def calibrate_threshold(pairs: DataFrame, threshold: float, target: float, masters: int, tol: float = 0.02) -> float:
    """The threshold, raised to the k-th largest p where more than k (1 + tol) pairs reach it; k = round(target masters)."""
    k = round(target * masters)
    best = best_per_query(pairs)
    if k < 1 or best.where(F.col("p") >= threshold).count() <= k * (1 + tol):
        return threshold
    return max(threshold, kth(best, "p", k))


def calibrate_odds(pairs: DataFrame, target: float, masters: int, tol: float = 0.02, steps: int = 7, unfound: float = 0.02, min_p: float = 0.05, sure: float = 0.985) -> tuple[DataFrame, float]:
    """assign_expected under the least divisor in [1, 8] that bisection finds feasible: at most target masters (1 + tol) pairs kept. If no
    step is feasible the undivided decision stands, though the divisor is 8. The groups are made once and kept for all steps."""
    limit = target * masters * (1 + tol)
    groups = _groups(pairs, min_p).persist()
    under = lambda divisor: _best_prefix(groups, unfound, min_p, divisor, sure)
    raw = under(1.0)
    if raw.count() <= limit:
        return raw, 1.0
    low, high, kept = 1.0, 8.0, None
    for _ in range(steps):
        middle = (low + high) / 2
        one = under(middle)
        if one.count() <= limit:
            high, kept = middle, one
        else:
            low = middle
    return (kept, high) if kept is not None else (raw, 8.0)


def inflate_bands(pairs: DataFrame, masters: DataFrame, reference: DataFrame, reference_masters: DataFrame, edges: list[float] = K.INFLATION_BANDS) -> DataFrame:
    """pairs with p divided by how much denser their band is, per master, than in the labelled reference of the country (of all countries'
    mean where it has none); the last band and p under the first edge stay."""
    def density(df, m):
        n = df.where(F.col("p") >= edges[0]).withColumn("band", digitize(F.col("p"), edges)).groupBy("country", "band").agg(F.count(F.lit(1)).alias("n"))
        return n.join(m.groupBy("country").agg(F.count(F.lit(1)).alias("m")), "country").select("country", "band", (F.col("n") / F.col("m")).alias("d"))

    ref = density(reference, reference_masters)
    countries = ref.select("country").distinct().count() or 1
    mean = ref.groupBy("band").agg((F.sum("d") / countries).alias("mean"))
    known = ref.select("country").distinct().withColumn("known", F.lit(1))
    x = density(pairs, masters).join(ref.withColumnRenamed("d", "r"), ["country", "band"], "left").join(mean, "band", "left").join(known, "country", "left")
    base = F.when(F.col("known").isNotNull(), F.coalesce("r", F.lit(0.0))).otherwise(F.coalesce("mean", F.lit(0.0)))
    factor = F.when(F.col("band") >= len(edges) - 1, 1.0).otherwise(F.greatest(F.lit(1.0), F.coalesce(F.try_divide("d", base), F.lit(1.0))))
    x = x.select("country", "band", factor.alias("__f"))
    out = pairs.withColumn("band", digitize(F.col("p"), edges)).join(x, ["country", "band"], "left")
    return out.withColumn("p", F.col("p") / F.coalesce("__f", F.lit(1.0))).drop("band", "__f")


def cells(best: DataFrame, edges: list[float] = K.CELL_BANDS) -> DataFrame:
    """best (s_* and q_* name_core, legal, hn) with band, hn_g (missing, same, changed), nm_g (equal names), lg_g (legal forms differ)."""
    missing = (F.col("s_hn") == "") | (F.col("q_hn") == "")
    a, b = F.array_sort("s_name_core"), F.array_sort("q_name_core")
    return best.withColumns(
        {
            "band": digitize(F.col("p"), edges),
            "hn_g": F.when(missing, "missing").when(related(F.col("q_hn"), F.col("s_hn")), "same").otherwise("changed"),
            "nm_g": ((a == b) & (F.size(a) > 0)).cast("int"),
            "lg_g": (F.array_sort("s_legal") != F.array_sort("q_legal")).cast("int"),
        }
    )


CELL_KEYS = ["band", "hn_g", "nm_g", "lg_g"]


def stratified_accept(best: DataFrame, masters: int, reference: DataFrame, reference_masters: int, min_precision: float = 0.75, min_ref: int = 30, top: int = len(K.CELL_BANDS) - 1) -> DataFrame:
    """best with `precision` and `accepted`: true records per master of the reference's cell (of its band, where the cell is thin) over records
    per master here; the top band is trusted."""
    ref = cell_table(reference, CELL_KEYS)
    fine = ref.where("hn_g is not null").select(*CELL_KEYS, F.col("n").alias("rn"), F.col("true").alias("rt"))
    coarse = ref.where("hn_g is null").select("band", F.col("true").alias("bt"))
    here = cell_table(best.withColumn("y", F.lit(0)), CELL_KEYS)
    n = here.where("hn_g is not null").select(*CELL_KEYS, F.col("n").alias("tn"))
    bn = here.where("hn_g is null").select("band", F.col("n").alias("bn"))
    x = n.join(bn, "band").join(fine, CELL_KEYS, "left").join(coarse, "band", "left")
    rate = lambda t, c: F.least(F.lit(1.0), (F.coalesce(t, F.lit(0)) / F.lit(reference_masters)) / (c / F.lit(masters)))
    own = F.when(F.col("band") >= top, 1.0).when(F.coalesce("rn", F.lit(0)) >= min_ref, rate(F.col("rt"), F.col("tn"))).otherwise(rate(F.col("bt"), F.col("bn")))
    x = x.select(*CELL_KEYS, own.alias("precision"))
    return best.join(x, CELL_KEYS).withColumn("accepted", F.col("precision") >= min_precision)


def fill_empty(pairs: DataFrame, threshold: float, fill: float) -> DataFrame:
    """assign(), and for masters left without a record their best candidate of at least `fill`."""
    best = best_per_query(pairs)
    kept = best.where(F.col("p") >= threshold)
    spare = best.where((F.col("p") < threshold) & (F.col("p") >= fill)).join(kept.select("s1").distinct(), "s1", "left_anti")
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "q")
    return kept.unionByName(spare.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))


def rescue_kind(s_core: Column, q_core: Column, q_domain: Column, s_hn: Column, q_hn: Column, s_street: Column, q_street: Column, q_empty: Column, street_types: list[str] = K.RESCUE_STREET_TYPES, with_initials: bool = True) -> Column:
    """Why a pair under the threshold may still be one: empty_exact_name, initials, rename_exact_address, or ''. A shared street word
    of `street_types` is none; without `with_initials` that arm is left out."""
    initials = F.array_join(F.transform(s_core, lambda t: F.substring(t, 1, 1)), "")
    streets = F.filter(F.array_intersect(s_street, q_street), lambda t: ~t.isin(street_types))
    first = F.coalesce(F.get(q_core, F.lit(0)), F.lit(""))
    return (
        F.when((F.size(s_core) == 0) | (F.size(q_core) == 0), "")
        .when(q_empty == 1, F.when(F.array_sort(s_core) == F.array_sort(q_core), "empty_exact_name").otherwise(""))
        .when(F.arrays_overlap(s_core, q_core) | (q_domain == 1), "")
        .when(F.lit(with_initials) & (F.size(q_core) == 1) & (first == initials) & (F.length(first) >= 2), "initials")
        .when((s_hn != "") & (s_hn == q_hn) & (F.size(streets) > 0), "rename_exact_address")
        .otherwise("")
    )


def sibling_signature(s_core: Column, q_core: Column, s_legal: Column, q_legal: Column, s_hn: Column, q_hn: Column) -> Column:
    """Same name, other legal form, unrelated house number: the mark of a sibling business."""
    return (F.size(s_core) > 0) & (F.array_sort(s_core) == F.array_sort(q_core)) & (F.array_sort(s_legal) != F.array_sort(q_legal)) & (s_hn != "") & (q_hn != "") & ~related(s_hn, q_hn)


def one_word_swap(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) >= 2) & (F.size(F.array_except(a, b)) == 1)


def camp_b(rows: DataFrame, sure: float = 0.9) -> DataFrame:
    """rows (s1, q, p, s_core, s_hn, q_core, q_hn; cores are sorted sets) with `kind`, where the record stands with others against the master:
    num_same_core, num_swap_core, num_other_core (a shared, unrelated number) or name_swap (a shared other word); else ''.

    Agreement is counted over (master, number) and (master, core), not over pairs of records: a record's peers are those with a related
    number, so distinct numbers of a master are compared, and records only counted."""
    same, w = F.col("q_core") == F.col("s_core"), Window.partitionBy("s1")
    rel = (F.col("s_hn") != "") & (F.col("q_hn") != "") & related(F.col("q_hn"), F.col("s_hn"))
    away = (F.col("s_hn") != "") & (F.col("q_hn") != "") & ~related(F.col("q_hn"), F.col("s_hn"))
    out = rows.withColumn("a_num", F.max((same & rel & (F.col("p") >= sure)).cast("int")).over(w)).withColumn("a_name", F.max((same & (F.col("p") >= sure)).cast("int")).over(w))
    out = out.withColumn("away", away)
    groups = out.where("away").groupBy("s1", "s_core", "q_hn", "q_core").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("s1", F.col("q_hn").alias("h2"), F.col("q_core").alias("c2"), "n")
    peers = groups.drop("n").join(other, "s1").where(related(F.col("h2"), F.col("q_hn")) & ((F.col("c2") == F.col("q_core")) | (F.col("c2") == F.col("s_core"))))
    peers = peers.groupBy("s1", "q_hn", "q_core").agg(F.sum("n").alias("peers"))
    out = out.join(peers, ["s1", "q_hn", "q_core"], "left")
    counted = (F.col("q_core") == F.col("q_core")).cast("int")
    num = F.col("away") & (F.col("a_num") == 1) & (F.coalesce("peers", F.lit(0)) - counted >= 1)
    alike = F.count(F.lit(1)).over(Window.partitionBy("s1", "q_core"))
    swap = one_word_swap(F.col("q_core"), F.col("s_core"))
    name = ~F.col("away") & ~same & swap & (F.col("a_name") == 1) & (alike > 1)
    kind = F.when(num, F.when(same, "num_same_core").when(swap, "num_swap_core").otherwise("num_other_core")).when(name, "name_swap").otherwise("")
    return out.withColumn("kind", kind).drop("a_num", "a_name", "away", "peers")


def drop_camps(rows: DataFrame, limits: dict[str, float], kinds: list[str], sure: float = 0.9, formed_from: float = 0.5) -> DataFrame:
    """rows (with country) without camp records under their country's limit; unscored pairs (p null) count as 1 and stay."""
    scored = rows.withColumn("p", F.coalesce("p", F.lit(1.0)))
    marked = camp_b(scored.where(F.col("p") >= formed_from), sure)
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("country")), F.lit(0.0))
    gone = marked.where(F.col("kind").isin(kinds) & (F.col("p") < limit)).select("s1", "q")
    return scored.join(gone, ["s1", "q"], "left_anti")


def transitive_rescue(accepted: DataFrame, rejected: DataFrame, least: float = 0.02) -> DataFrame:
    """(s1, q): rejected candidates whose key equals that of accepted records of exactly one master, their own. Both have s1, q, key."""
    owners = accepted.where("key <> ''").groupBy("key").agg(F.min("s1").alias("s1"), F.max("s1").alias("last")).where("s1 = last").select("key", "s1")
    return rejected.where(F.col("p") >= least).join(owners, ["key", "s1"]).select("s1", "q")
