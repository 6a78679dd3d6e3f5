"""Transliteration tables learned from true pairs, extended by sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.text import fold, is_native, skeleton
from kinlink.operators.relational import majority


#: Table rows up to which it's broadcast to the names' words; beyond, both are shuffled by word.
BROADCAST_WORDS = 100_000


def apply(records: DataFrame, table: DataFrame, name: str, id_: str, out: str) -> DataFrame:
    """records (with an id) with `out`: the name with the native words of the table (native, latin) in Latin letters. Only records
    with native letters are taken apart; repeated ids share the name that stands first."""
    native = records.where(is_native(F.col(name))).groupBy(id_).agg(F.min(name).alias("__name"))
    words = native.select(id_, F.posexplode(F.split("__name", r"\s+")).alias("__i", "native"))
    held = F.broadcast(table) if table.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else table
    spelt = words.join(held, "native", "left").groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("__i", F.coalesce("latin", "native").alias("w")))).alias("__ws"))
    spelt = spelt.select(id_, F.array_join(F.transform("__ws", lambda x: x["w"]), " ").alias(out))
    return records.join(spelt, id_, "left").withColumn(out, F.coalesce(out, name))


def learn(pairs: DataFrame, min_count: int = 2, purity: float = 0.5) -> DataFrame:
    """(native, latin) from pairs (a, b) of a native and a Latin name with as many words: words align by place."""
    a, b = F.split(F.trim("a"), r"\s+"), F.split(F.trim(F.lower("b")), r"\s+")
    rows = pairs.where(is_native(F.col("a")) & ~is_native(F.col("b")) & (F.size(a) == F.size(b)))
    rows = rows.select(F.explode(F.arrays_zip(a.alias("native"), b.alias("latin"))).alias("x")).select("x.native", F.regexp_replace("x.latin", "[^a-z0-9]", "").alias("latin"))
    return majority(rows.where(is_native(F.col("native")) & (F.col("latin") != "")), ["native"], "latin", min_count, purity).select("native", "latin")


def extend(table: DataFrame, names: DataFrame, min_count: int = 20) -> DataFrame:
    """table with native words of `names` (name) that it lacks: matched by consonant skeleton to the most frequent Latin word, or, for
    skeletons of five or more, to one at edit distance 1 with the same first letter."""
    words = names.select(F.explode(F.split(F.trim("name"), r"\s+")).alias("w")).where("w <> ''")
    unknown = words.where(is_native(F.col("w"))).distinct().join(table.select(F.col("native").alias("w")), "w", "left_anti").withColumn("k", skeleton(fold(F.col("w")))).where(F.length("k") >= 3)
    latin = words.where(~is_native(F.col("w"))).select(F.explode(F.regexp_extract_all(fold(F.col("w")), F.lit("([a-z]+)"))).alias("l"))
    latin = latin.groupBy("l").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= min_count) & (F.length("l") >= 3)).withColumn("k", skeleton(F.col("l"))).where(F.length("k") >= 2)
    sounds = latin.groupBy("k").agg(F.max_by("l", F.struct("c", "l")).alias("latin"), F.max("c").alias("c"))
    exact = unknown.join(sounds, "k").select(F.col("w").alias("native"), "latin")
    rest = unknown.where(F.length("k") >= 5).join(exact.select(F.col("native").alias("w")), "w", "left_anti")
    keyed = rest.select("w", F.col("k").alias("uk"), F.substring("k", 1, 1).alias("f"), F.explode(F.array(*(F.length("k") + d for d in (-1, 0, 1)))).alias("n"))
    near = keyed.join(sounds.select("k", "latin", "c", F.substring("k", 1, 1).alias("f"), F.length("k").alias("n")), ["f", "n"]).where(F.levenshtein("uk", "k") <= 1)
    near = near.groupBy("w").agg(F.max_by("latin", F.struct("c", "latin")).alias("latin")).select(F.col("w").alias("native"), "latin")
    return table.select("native", "latin").unionByName(exact).unionByName(near)
