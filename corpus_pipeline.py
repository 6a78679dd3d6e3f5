"""The corpus pipeline: documents, stage by stage, to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; the last returns the chosen documents
with their number of copies. Further columns of documents pass through, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, language, line_dedup, mixing, near_dedup, shared

#: Mixing: tokens to choose (`total`: what all leaves hold in all epochs), epochs, seed.
BUDGET, MAX_EPOCHS, SEED = "total * 3 div 10", 2, 7


def domain(source: Column) -> Column:
    """The stand-in for a domain: the source's number, modulo 3."""
    return F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), (_number(source) % 3 + 1).cast("int"))


def _number(source: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(source, "[0-9]+$", 0), F.lit("")).cast("int"), F.lit(0))


def tree(docs: DataFrame) -> DataFrame:
    """Leaves of the mixing tree with the target weight at every level."""
    leaves = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(x) for x in mixing.LEVELS)).distinct()
    d, l = F.col("domain"), F.col("lang")
    return leaves.withColumns(
        {
            "w_domain": F.when(d == "web", 5).when(d == "books", 3).otherwise(2).cast("long"),
            "w_lang": F.when(l == "en", 6).when(l == "de", 2).otherwise(1).cast("long"),
            "w_source": (_number(F.col("source")) % 4 + 1).cast("long"),
        }
    )


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: no text, or no letter in it) go; a missing lang is filled in.
    Without a model (no document of the learning fold has a lang) documents that hold a letter stay as they are."""
    shared.whole_texts(spark)
    model = language.fit(docs.where(language.fold(F.col("doc_id"), 4) != 2))
    if model is None:
        has_letter = F.udf(lambda text: bool(language.letters(text or "")), "boolean")
        return docs.where(has_letter(F.col("text").cast("string")))
    pred, score = shared.fresh(docs.columns, "lang_pred", "score")
    said = language.identify(docs, model, keep=docs.columns, names=(pred, score)).where(F.col(pred) != "und")
    return said.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so does a document of which nothing is left."""
    lines, removed = shared.fresh(docs.columns, "n_lines", "n_removed")
    cut = line_dedup.dedup_lines(docs, counts=(lines, removed)).where(~((F.col(removed) > 0) & (F.col(removed) == F.col(lines))))
    return _counted(cut.select(docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return near_dedup.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that held nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontaminate.decontaminate(docs, benchmark)
    return _counted(cut.where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")).select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents with domain, n_tokens and n_copies, which take the place of columns of these names."""
    docs = docs.withColumn("domain", domain(F.col("source")))
    return mixing.mix(docs, tree(docs), F.expr(BUDGET), MAX_EPOCHS, SEED)


STAGES = [
    ("language identification", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Hash functions, learned models and Bayesian pruning aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), "stage")
    return docs
