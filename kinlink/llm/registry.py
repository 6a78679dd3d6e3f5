"""The queries of this subpackage, by name, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, language, line_dedup, lm_score, mixing, near_dedup, oracles, shared, substring_dedup, token_counts, url_filter, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.whole_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = language.fold(F.col("doc_id"), 4)
    model = language.fit(docs.where(remainder != 2))
    return language.identify(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = language.fold(F.col("doc_id"), 7)
    fold = F.when(remainder == 2, lm_score.TEST).when(remainder == 3, lm_score.HELD).otherwise(lm_score.TRAIN)
    return lm_score.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), fold)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "documents"))
    return decontaminate.contamination(index, _table(spark, sf_dir, "benchmark")).drop("item_ids")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("domain", corpus_pipeline.domain(F.col("source")))
    levels = [F.coalesce(F.col(x), F.lit("")).alias(x) for x in mixing.LEVELS]
    sizes = shared.stored(docs.select("doc_id", *levels, mixing.words(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sizes, corpus_pipeline.tree(sizes), F.expr(corpus_pipeline.BUDGET), corpus_pipeline.MAX_EPOCHS, corpus_pipeline.SEED, tokens=F.col("size"))
    return mixed.select("doc_id", *mixing.LEVELS, "n_tokens", "n_copies")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_in_batches(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_language_id, op2_token_counts, op3_near_dedup, op4_lm_score, op5_url_filter, op6_decontamination, op7_mixing, op8_vector_dedup, op9_line_dedup, op10_substring_dedup, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
