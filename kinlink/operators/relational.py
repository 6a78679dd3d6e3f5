"""Joins, aggregates and ranks of the linkage data model.

Pairs are (s1, q, p): a master record, a query record, a score. Every rank's order is total: score first, then the
least id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Joins and sets

def explode_truth(truth: DataFrame) -> DataFrame:
    """(s1, other) of a truth table with comma-joined ids; masters without a match give none."""
    return truth.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("other")).where("other <> ''")


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 where the truth (s1, other) has the pair."""
    t = truth.select(F.col("other").alias("q"), F.col("s1").alias("__true"))
    return pairs.join(t, "q", "left").withColumn("y", F.coalesce(F.col("__true") == F.col("s1"), F.lit(False)).cast("int")).drop("__true")


def missed_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True (s1, other) pairs that weren't found."""
    return truth.join(found.select("s1", F.col("q").alias("other")), ["s1", "other"], "left_anti")


def union_distinct(*channels: DataFrame) -> DataFrame:
    out = channels[0].select("s1", "q")
    for c in channels[1:]:
        out = out.union(c.select("s1", "q"))
    return out.distinct()


def keep_first(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """Of repeated (s1, q) pairs the first by `order`."""
    w = Window.partitionBy("s1", "q").orderBy(*order)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def override_countries(base: DataFrame, override: DataFrame, countries: list[str]) -> DataFrame:
    """(s1, q, country): listed countries from `override`, the rest from `base`; override records that a master of a base
    country claims already are dropped."""
    kept = base.where(~F.col("country").isin(countries))
    fresh = override.where(F.col("country").isin(countries)).join(kept.select("q"), "q", "left_anti")
    return kept.select("s1", "q", "country").unionByName(fresh.select("s1", "q", "country"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s1, q, side): both, a or b."""
    x, y = a.select("s1", "q").distinct().withColumn("a", F.lit(1)), b.select("s1", "q").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "b").when(F.col("b").isNull(), "a").otherwise("both")
    return x.join(y, ["s1", "q"], "full").select("s1", "q", side.alias("side"))


def key_candidates(s: DataFrame, q: DataFrame, keys: list[str], token: str, most: int = 300) -> DataFrame:
    """Pairs that share a token and all keys; tokens of more than `most` masters are left out."""
    a = s.select(F.col("entity_id").alias("s1"), *keys, F.explode(F.array_distinct(token)).alias("t"))
    common = a.groupBy(*keys, "t").count().where(F.col("count") > most)
    a = a.join(common, [*keys, "t"], "left_anti")
    b = q.select(F.col("entity_id").alias("q"), *keys, F.explode(F.array_distinct(token)).alias("t"))
    return a.join(b, [*keys, "t"]).select("s1", "q").distinct()


#: Pairs of one country and first token that one block of the join makes at most (more masters are dealt over more blocks).
BLOCK = 1 << 21
#: Columns whose values deal a master's pairs to a task: a master's pairs have the same. Windows by them and s1 shuffle no pair.
DEALT = ["country", "t", "b"]


def _blocks(s: DataFrame, q: DataFrame, tokens: str, columns: list[str] | None, block: int, small: int) -> tuple[DataFrame, DataFrame]:
    """dealt before the shuffle, with `parts`: 0 where a token's pairs are `small` at most."""
    side = lambda df, n, x: df.where((F.size(tokens) > 0) & F.col("country").isNotNull()).select(F.col("entity_id").alias(n), "country", F.get(tokens, F.lit(0)).alias("t"), F.col(tokens).alias(f"{n}_t"), *(F.col(c).alias(f"{x}_{c}") for c in columns or []))
    a, b = side(s, "s1", "s"), side(q, "q", "q")
    size = lambda df, n: df.groupBy("country", "t").agg(F.count(F.lit(1)).alias(n))
    pairs = F.col("n_s") * F.col("n_q")
    hot = F.broadcast(size(a, "n_s").join(size(b, "n_q"), ["country", "t"]).where(pairs > small).select("country", "t", F.ceil(pairs / block).cast("int").alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    a = a.join(hot, ["country", "t"], "left").withColumn("b", F.pmod(F.xxhash64("s1"), n).cast("int"))
    b = b.join(hot, ["country", "t"], "left").withColumn("b", F.explode(F.sequence(F.lit(0), n - 1)))
    return a.fillna(0, ["parts"]), b.fillna(0, ["parts"])


def dealt(s: DataFrame, q: DataFrame, tokens: str, columns: list[str] | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Masters (s1, s1_t, s_*) and queries (q, q_t, q_*) by DEALT: each pair of one country and first token meets in one block, of at most
    `block` (BLOCK, if not said) pairs."""
    tasks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x.drop("parts") for x in _blocks(s, q, tokens, columns, block or BLOCK, block or BLOCK))
    return a.repartition(tasks, *DEALT), b.repartition(tasks, *DEALT)


#: Tokens of at most one in so many of a block's most pairs are packed, so that not every token starts a call of its own.
SMALL = 64


def in_blocks(s: DataFrame, q: DataFrame, tokens: str, columns: list[str], block: int, run, schema: str) -> DataFrame:
    """Rows that run(masters, queries) makes of each block of `dealt`, as Arrow tables without DEALT. Small blocks are packed into one
    call; blocks of one side alone make no rows."""
    tasks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack = F.when(F.col("parts") > 0, F.xxhash64(*DEALT)).otherwise(F.pmod(F.xxhash64("country", "t"), F.lit(4 * tasks)))
    a, b = (x.withColumn("pack", pack).drop("parts").repartition(tasks, "pack") for x in _blocks(s, q, tokens, columns, block, block // SMALL))
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(table: pa.Table, x: str) -> dict:
        keys: dict = {}
        for i, key in enumerate(zip(*(table.column(f"{x}{c}").to_pylist() for c in DEALT))):
            keys.setdefault(key, []).append(i)
        return keys

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        ours, theirs = rows(left, ""), rows(right, "by_")
        both = [k for k in ours if k in theirs] or [next(iter(ours), None) or next(iter(theirs))]
        return pa.concat_tables([run(left.take(pa.array(ours.get(k, []), pa.int64())), right.take(pa.array(theirs.get(k, []), pa.int64()))).select(names) for k in both])

    b = b.withColumnsRenamed({c: f"by_{c}" for c in [*DEALT, "pack"]})  # cogroup wants the sides' keys told apart
    return a.groupBy("pack").cogroup(b.groupBy("by_pack")).applyInArrow(each, schema)


def first_token_pairs(s: DataFrame, q: DataFrame, tokens: str, least: float = 0.5, columns: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Pairs (s1, q) of the same country and first token whose tokens' Jaccard similarity is at least `least`, with DEALT, s1_t and
    q_t (tokens) and both sides' `columns` as s_* and q_*.

    Records are shuffled, never pairs: the masters of a frequent token are dealt over blocks, its queries go to each of them."""
    a, b = dealt(s, q, tokens, columns, block)
    both = a.join(b, DEALT)
    # One token is shared, so a union can't be larger than all tokens but one: short names need no sets to pass.
    sure = F.lit(1.0) / (F.size("s1_t") + F.size("q_t") - 1) >= least
    return both.where(sure | (_token_jaccard() >= least))


def _token_jaccard() -> Column:
    return F.size(F.array_intersect("s1_t", "q_t")) / F.size(F.array_union("s1_t", "q_t"))


def similar(s_words: list[set], q_words: list[set], least: float):
    """Of each master of a block, its number, the queries whose words have a Jaccard similarity of at least `least` with its own, and
    the similarities."""
    tokens: dict[str, list] = {}
    for i, x in enumerate(q_words):
        for w in x:
            tokens.setdefault(w, []).append(i)
    tokens = {w: np.array(x, np.int64) for w, x in tokens.items()}
    size = np.array([len(x) for x in q_words], np.int64)
    for k, own in enumerate(s_words):
        shared = np.zeros(len(q_words), np.int64)
        for w in own:
            if w in tokens:
                shared[tokens[w]] += 1
        jaccard = shared / (size + len(own) - shared)
        found = np.flatnonzero(jaccard >= least)
        yield k, found, jaccard[found]


#: Pairs of a block that is made in memory, whose rows a worker holds at once.
HELD = 1 << 19


def first_token_sets(s: DataFrame, q: DataFrame, tokens: str, least: float, made, schema: str) -> DataFrame:
    """(s1, q, schema) of first_token_pairs, where made(masters' set, queries' sets, similarities) makes the columns of `schema` as Arrow
    arrays, once for each two token sets of a block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def of(column) -> tuple[dict, list]:
            rows: dict[frozenset, list] = {}
            for i, x in enumerate(column.to_pylist()):
                rows.setdefault(frozenset(x), []).append(i)
            return rows, [np.array(x, np.int64) for x in rows.values()]

        ours, s_rows = of(left.column("s1_t"))
        theirs, q_rows = of(right.column("q_t"))
        sets, n = list(theirs), np.array([len(x) for x in q_rows], np.int64)
        out = []
        for (k, found, jaccard), own in zip(similar(list(ours), sets, least), ours):
            if not len(found):
                continue
            columns = made(own, [sets[i] for i in found], jaccard)
            times = n[found]
            place, each = np.concatenate([q_rows[i] for i in found]), np.repeat(np.arange(len(found)), times)
            m = len(s_rows[k])
            out.append((np.repeat(s_rows[k], len(place)), np.tile(place, m), [x.take(pa.array(np.tile(each, m))) for x in columns]))
        none = np.zeros(0, np.int64)
        out = out or [(none, none, made(frozenset(), [], np.zeros(0)))]
        i, j = (pa.array(np.concatenate([x[c] for x in out])) for c in (0, 1))
        columns = {name: pa.chunked_array([x[2][c] for x in out]) for c, name in enumerate(names)}
        return pa.table({"s1": left.column("s1").take(i), "q": right.column("q").take(j)} | columns)

    return in_blocks(s, q, tokens, [], HELD, run, f"s1 string, q string, {schema}")


def first_token_jaccard(s: DataFrame, q: DataFrame, tokens: str, least: float = 0.5) -> DataFrame:
    """Pairs of the same country and first token whose tokens' Jaccard similarity is at least `least`."""
    return first_token_sets(s, q, tokens, least, lambda own, others, jaccard: [pa.array(jaccard, pa.float64())], "jaccard double")


def exact_twins(s: DataFrame, q: DataFrame) -> DataFrame:
    """(q, s1): the one master of the country with the same sorted name and number and a shared street word."""
    side = lambda df, n: df.where((F.size("name_core") > 0) & (F.col("hn") != "")).select(F.col("entity_id").alias(n), "country", F.array_join(F.array_sort("name_core"), " ").alias("k"), "hn", F.col("street").alias(f"{n}_street"))
    both = side(s, "s1").join(side(q, "q"), ["country", "k", "hn"]).where(F.arrays_overlap("s1_street", "q_street"))
    return both.groupBy("q").agg(F.min("s1").alias("s1"), F.count(F.lit(1)).alias("n")).where("n = 1").select("q", "s1")


# Aggregates

def majority(df: DataFrame, keys: list[str], value: str, min_count: int, purity: float) -> DataFrame:
    """The most frequent value of each key, where it comes `min_count` times and makes up `purity` of the key's rows;
    of equals the least."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b"), F.sum("n").alias("total"))
    best = best.select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"), "total")
    return best.where((F.col("n") >= min_count) & (F.col("n") >= purity * F.col("total")))


def learn_city_states(s: DataFrame, min_count: int = 3, purity: float = 0.9) -> DataFrame:
    """(country, city, state) from records that have both."""
    return majority(s.where("city <> '' and state <> ''"), ["country", "city"], "state", min_count, purity).select("country", "city", "state")


def backfill_states(q: DataFrame, cities: DataFrame) -> DataFrame:
    """q with empty states filled in by city, and `filled`."""
    m = cities.select("country", "city", F.col("state").alias("__m"))
    out = q.join(m, ["country", "city"], "left").withColumn("filled", ((F.col("state") == "") & F.col("__m").isNotNull()).cast("int"))
    return out.withColumn("state", F.coalesce(F.nullif("state", F.lit("")), "__m", F.lit(""))).drop("__m")


def document_frequency(df: DataFrame, tokens: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return df.select(*keys, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))


def top_tokens(df: DataFrame, tokens: str, most: int = 3000, length: int = 4, drop: list[str] | None = None) -> DataFrame:
    """The most frequent alphabetic tokens of at least `length` letters that aren't in `drop`."""
    t = df.select(F.explode(tokens).alias("token")).where((F.length("token") >= length) & F.col("token").rlike("^[a-z]+$"))
    t = t.where(~F.col("token").isin(drop)) if drop else t
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(most)


def digitize(p: Column, edges: list[float]) -> Column:
    """How many edges are at or below p."""
    out = F.lit(0)
    for e in edges:
        out = out + (p >= e).cast("int")
    return out


def band_shares(pairs: DataFrame, masters: DataFrame, edges: list[float]) -> DataFrame:
    """(country, band, n, per_s1): records of each score band per master of the country."""
    n = pairs.withColumn("band", digitize(F.col("p"), edges)).groupBy("country", "band").agg(F.count(F.lit(1)).alias("n"))
    size = masters.groupBy("country").agg(F.count(F.lit(1)).alias("masters"))
    return n.join(size, "country").select("country", "band", "n", (F.col("n") / F.col("masters")).alias("per_s1"))


def cell_table(df: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Counts and sums by all keys and, where the other keys are null, by the first alone."""
    rolled = df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("true"), F.grouping_id().alias("g"))
    return rolled.where(F.col("g").isin(0, 2 ** (len(keys) - 1) - 1)).drop("g")


def sorted_quantile(df: DataFrame, p: str, share: float) -> float | None:
    """The value at place int(share * n) of the sorted column; ranked by range, not in one task."""
    n = df.count()
    if not n:
        return None
    return kth(df, p, int(share * n) + 1, ascending=True)


def kth(df: DataFrame, p: str, k: int, ascending: bool = False) -> float | None:
    """The k-th value in order, exactly: values are counted in bands between approximate quantiles, and only the band that
    holds the place is put in order."""
    cuts = df.approxQuantile(p, [i / 64 for i in range(1, 64)], 0.001)
    cuts = sorted(set(cuts))
    band = digitize(F.col(p), cuts)
    counts = dict(df.groupBy(band.alias("b")).count().collect())
    for b in sorted(counts, reverse=not ascending):
        if k <= counts[b]:
            row = df.where(band == b).groupBy(p).count().orderBy(F.col(p).asc() if ascending else F.col(p).desc()).toLocalIterator()
            for value, n in row:
                if k <= n:
                    return value
                k -= n
        k -= counts[b]
    return None


# Ranks

def by_score(part: str | list[str], p: str = "p", tie: str = "s1"):
    part = [part] if isinstance(part, str) else part
    return Window.partitionBy(*part).orderBy(F.desc(p), tie)


def best_per_query(pairs: DataFrame) -> DataFrame:
    """Each query's best master."""
    return pairs.withColumn("__n", F.row_number().over(by_score("q"))).where("__n = 1").drop("__n")


def context(pairs: DataFrame, p: str = "p", prefix: str = "", part: list[str] | None = None) -> DataFrame:
    """Competition among a query's and a master's candidates: q_rank, q_gap, q_ncand, s_rank, s_ncand, s_gap_top. With
    `part`, inside each partition of the candidate search."""
    part = part or []
    q, s = Window.partitionBy(*part, "q"), Window.partitionBy(*part, "s1")
    ranked = pairs.withColumn("__r", F.row_number().over(by_score([*part, "q"], p)))
    best, second = F.max(p).over(q), F.coalesce(F.max(F.when(F.col("__r") == 2, F.col(p))).over(q), F.lit(0.0))
    other = F.when(F.col(p) >= best, second).otherwise(best)
    return ranked.withColumns(
        {
            f"{prefix}q_rank": F.col("__r"),
            f"{prefix}q_gap": F.col(p) - other,
            f"{prefix}q_ncand": F.count(F.lit(1)).over(q),
            f"{prefix}s_rank": F.row_number().over(by_score([*part, "s1"], p, "q")),
            f"{prefix}s_ncand": F.count(F.lit(1)).over(s),
            f"{prefix}s_gap_top": F.col(p) - F.max(p).over(s),
        }
    ).drop("__r")


def second_best(pairs: DataFrame) -> DataFrame:
    """(q, best, second): second is 0 where there is one candidate."""
    two = pairs.withColumn("__r", F.row_number().over(by_score("q"))).where("__r <= 2")
    return two.groupBy("q").agg(F.max(F.when(F.col("__r") == 1, F.col("p"))).alias("best"), F.coalesce(F.max(F.when(F.col("__r") == 2, F.col("p"))), F.lit(0.0)).alias("second"))


def anchors(pairs: DataFrame, p: str = "p") -> DataFrame:
    """pairs with anchor_q, anchor_p: the master's best candidate other than the pair's own."""
    own = Window.partitionBy("s1")
    ranked = pairs.withColumn("__r", F.row_number().over(by_score("s1", p, "q")))
    entry = F.struct(F.col("q"), F.col(p).alias("p"))
    first, second = F.max(F.when(F.col("__r") == 1, entry)).over(own), F.max(F.when(F.col("__r") == 2, entry)).over(own)
    anchor = F.when(F.col("__r") == 1, second).otherwise(first)
    return ranked.withColumn("__a", anchor).withColumn("anchor_q", F.col("__a.q")).withColumn("anchor_p", F.col("__a.p")).drop("__a", "__r")


def leave_one_out(pairs: DataFrame, flag: Column, keys: list[str]) -> Column:
    """How many other rows of the keys have the flag."""
    return F.sum(flag.cast("long")).over(Window.partitionBy(*keys)) - flag.cast("long")


def greedy_slice(groups: DataFrame, target: float = 0.3, seed: int = 0) -> DataFrame:
    """(country, state) groups taken in seeded order until they reach `target` of the country's rows; in countries of more than
    three groups, those over half the target are passed over."""
    c = Window.partitionBy("country")
    g = groups.withColumn("goal", F.sum("n").over(c) * target).withColumn("states", F.count(F.lit(1)).over(c))
    g = g.where(~((F.col("states") > 3) & (F.col("n") > 0.5 * F.col("goal"))))
    order = Window.partitionBy("country").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("country"), F.col("state")).cast("binary"))).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < F.col("goal")).select("country", "state", "n")


def hard_negatives(pairs: DataFrame, per_positive: int = 3) -> DataFrame:
    """All true pairs and, of the false, the best scored: at most `per_positive` for each true one."""
    limit = per_positive * pairs.where("y = 1").count()
    false = pairs.where("y = 0")
    if false.count() <= limit:
        return pairs
    floor = kth(false, "p", limit) if limit else None
    if floor is None:
        return pairs.where("y = 1")
    above = false.where(F.col("p") > floor)
    ties = false.where(F.col("p") == floor).orderBy("s1", "q").limit(limit - above.count())
    return pairs.where("y = 1").unionByName(above).unionByName(ties)
