"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

A tree of levels (domain, language, source) carries integer weights. The token budget goes down level by level: among
the children of a node, each gets its weight's share, a child whose whole subtree holds less gets what it holds, and
the shortage goes to its siblings by weight. Only what a whole subtree can't hold reaches the siblings of an ancestor,
since a node's budget never exceeds what its leaves hold. A leaf holds its tokens `max_epochs` times. Its budget is
spent in whole epochs and then in the prefix, by running token count, of one more epoch's seeded order.

No leaf is gathered in one task: tokens are pre-aggregated by leaf and hash prefix, the running count goes over the
prefixes, and only the documents of the one prefix in which the budget ends are put in order.

Defined cases: a null level value is the value ''; a document whose leaf isn't in the tree, or whose weight at any
level is 0 or null, isn't chosen; a null or empty text has 0 tokens and comes with the prefix it falls in; rows that
repeat are chosen each by itself; shares are rounded down, so a leaf never exceeds its budget; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import shared

LEVELS = ["domain", "lang", "source"]
#: Leaves up to which the plan is broadcast to the documents; beyond, it's joined by shuffle.
BROADCAST_LEAVES = 20_000
#: Hexadecimal digits of the order's hash that make a bucket (16^3 buckets a leaf).
PREFIX = 3


def words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, counted as ends of words: what stands before a separator or the end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes (parent columns, key, w, cap, budget of the parent) with `share`: weighted water-filling under caps."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = by.orderBy(F.col("cap") / F.col("w"), key)
    open_ = nodes.where("w > 0").withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_ = open_.withColumn("over", F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing)))
    open_ = open_.withColumn("short", F.col("cap").cast("double") * F.col("over") <= F.col("w").cast("double") * F.col("rest"))
    open_ = open_.withColumn("left", F.col("budget") - F.sum(F.when(F.col("short"), F.col("cap")).otherwise(0)).over(by))
    open_ = open_.withColumn("open_w", F.sum(F.when(F.col("short"), 0).otherwise(F.col("w"))).over(by))
    return open_.withColumn("share", F.when(F.col("short"), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("w * left div greatest(open_w, 1)"))).cast("long")).drop("rest", "over", "short", "left", "open_w")


def budgets(leaves: DataFrame, budget: Column, levels: list[str] = LEVELS) -> DataFrame:
    """leaves (levels, a weight `w_<level>` for each, cap) with `share` tokens. `budget` is a column over their total
    capacity `total`."""
    leaves = leaves.withColumn("usable", F.least(*(F.coalesce(F.col(f"w_{x}"), F.lit(0)) for x in levels)) > 0).where("usable and cap > 0").drop("usable")
    out, given = leaves, None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*parent, level).agg(F.max(f"w_{level}").cast("long").alias("w"), F.sum("cap").cast("long").alias("cap"))
        if given is None:
            total = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("total", F.sum("cap").over(total)).withColumn("budget", F.least(F.col("total"), budget.cast("long"))).drop("total")
        else:
            nodes = nodes.join(given, parent)
        given = fill(nodes, parent, level).select(*parent, level, F.col("share").alias("budget"))
    return out.join(given.withColumnRenamed("budget", "share"), levels)


def mix(docs: DataFrame, tree: DataFrame, budget: Column, max_epochs: int = 2, seed: int = 0, levels: list[str] = LEVELS, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The chosen rows of docs, with n_tokens and n_copies (epochs in which the document stands), in place of columns
    of these names.

    docs has the level columns. tree has the levels and `w_<level>` columns, one row a leaf. `budget` is in tokens and
    may use `total`, what all weighted leaves hold. The text is read to count its words, unless `tokens` is given."""
    level = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels]
    size = words(F.col("text")) if tokens is None else tokens
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "n_copies")]
    rows = docs.select(F.struct(*(docs[c] for c in kept)).alias("doc"), F.col(id_col).cast("string").alias("id"), *level, size.alias("n_tokens"))
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    tree = tree.select(*level, *(f"w_{x}" for x in levels)).dropDuplicates(levels)
    plan = budgets(leaves.join(tree, levels).withColumn("cap", F.col("tokens") * max_epochs), budget, levels)
    plan = shared.stored(plan.select(*levels, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("part")), "plan")
    held = F.broadcast if plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else (lambda x: x)
    order = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("id"), F.lit("null"))).cast("binary"))
    placed = rows.join(held(plan), levels).withColumn("rank", order).withColumn("bucket", F.substring("rank", 1, PREFIX))
    sums = placed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("part").alias("part"))
    sums = shared.stored(sums.withColumn("digit", F.substring("bucket", 1, 1)), "sums")
    # The running count goes over the first digits, then over the buckets of each, so that no leaf's buckets meet.
    lead = Window.partitionBy(*levels).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = sums.groupBy(*levels, "digit").agg(F.sum("n").alias("d")).withColumn("ahead", F.coalesce(F.sum("d").over(lead), F.lit(0))).drop("d")
    run = Window.partitionBy(*levels, "digit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.join(digits, [*levels, "digit"]).withColumn("upto", F.col("ahead") + F.sum("n").over(run)).where("upto > part")
    cut = sums.groupBy(*levels).agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"))
    cut = shared.stored(cut, "cut")
    marked = placed.join(held(cut), levels, "left")
    last = Window.partitionBy(*levels).orderBy("rank", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    clear = marked.where("cut is null or bucket <> cut").select("doc", "n_tokens", "whole", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)).cast("long").alias("more"))
    edge = marked.where("bucket = cut").withColumn("upto", F.col("before") + F.sum("n_tokens").over(last)).select("doc", "n_tokens", "whole", (F.col("upto") <= F.col("part")).cast("long").alias("more"))
    chosen = clear.unionByName(edge).withColumn("n_copies", (F.col("whole") + F.col("more")).cast("long")).where("n_copies > 0")
    return chosen.select("doc.*", "n_tokens", "n_copies")
