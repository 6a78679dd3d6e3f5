"""Command line: python -m kinlink COMMAND ..., see --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinlink.operators import decision, ensemble, relational, report, sampling
from kinlink.plans import linkage
from kinlink.sources import tables

COMMANDS = {
    "train": "data-dir work rounds depth refit dump-features",
    "predict": "data-dir work out calibrate decision selftrain threshold override",
    "ensemble": "runs weights zeros out",
    "decide": "scores data-dir work decision out override odds-div",
    "validate": "matching data-dir",
    "blend": "scores other weight out",
    "export-pairs": "scores data-dir split out",
    "slice": "data-dir split states unlabelled out",
    "proxy-report": "matching data-dir parsed",
    "postprocess": "scores parsed data-dir thresholds siblings camps kinds out",
    "stratify": "scores parsed reference reference-parsed truth precision data-dir out",
    "camp-drop": "scores parsed limits kinds out",
    "merge-countries": "base other countries out",
}


def _pairs_of(text: str | None, kind=float) -> dict:
    """`US=0.8,India=0.7` as a dict."""
    return {k: kind(v) for k, v in (x.split("=", 1) for x in text.split(",") if x)} if text else {}


def _list(text: str | None) -> list[str]:
    return [x for x in (text or "").split(",") if x]


def _masters(spark: SparkSession, a):
    return tables.read_tsv(spark, f"{a.data_dir}/test_source1.tsv").select(F.col("entity_id").alias("s1"), "country")


def _matches(spark: SparkSession, a, kept) -> None:
    tables.write_id_lists(tables.id_lists(_masters(spark, a), kept), a.out, ("source1_entity_id", "matched_entity_ids"))


def train(spark, a):
    truth = relational.explode_truth(tables.read_truth(spark, f"{a.data_dir}/train_ground_truth.tsv"))
    records = tables.read_sources(spark, a.data_dir, "train")
    print(linkage.train(spark, records, truth, a.work, rounds=a.rounds and int(a.rounds), depth=a.depth and int(a.depth), refit=bool(a.refit), dump=a.dump_features))


def predict(spark, a):
    own = tuple(map(float, _list(a.selftrain))) or None
    linkage.predict(spark, tables.read_sources(spark, a.data_dir, "test"), a.work, a.out, a.calibrate, a.decision, own, a.threshold and float(a.threshold), _pairs_of(a.override, str))


def ensemble_(spark, a):
    weights = [float(w) for w in _list(a.weights)] or None
    tables.write_checkpoint(linkage.combine(spark, _list(a.runs), weights, bool(a.zeros)), a.out)


def decide(spark, a):
    scores = tables.read_scores_of(spark, a.scores, _pairs_of(a.override, str))
    kept = linkage.decide(scores, _masters(spark, a), tables.read_artifact(spark, f"{a.work}/meta"), a.decision or "expected", odds_div=float(a.odds_div or 1))
    _matches(spark, a, kept)


def validate(spark, a):
    records = tables.read_sources(spark, a.data_dir, "test")
    lists = tables.read_truth(spark, a.matching).toDF("s1", "ids")
    report.validate(lists, records.where("src = 1").select(F.col("entity_id").alias("s1")), records).show(truncate=False)


def blend(spark, a):
    """--other: Parquet of (s1, q, c)."""
    tables.write_checkpoint(ensemble.blend(tables.read_scores(spark, a.scores), spark.read.parquet(a.other), float(a.weight or 0.3)), a.out)


def export_pairs(spark, a):
    ensemble.text_pairs(tables.read_scores(spark, a.scores), tables.read_sources(spark, a.data_dir, a.split or "test")).write.mode("overwrite").parquet(a.out)


def slice_(spark, a):
    """The states' records as sources of a folder of their own; with truth unless --unlabelled 1."""
    split, states = a.split or "train", _list(a.states)
    records = linkage.parse(tables.read_sources(spark, a.data_dir, split))
    if a.unlabelled:
        tables.write_sources(sampling.slice_by_states(records, states), a.out, "test")
        return
    rows, truth = sampling.evaluation_slice(records, relational.explode_truth(tables.read_truth(spark, f"{a.data_dir}/{split}_ground_truth.tsv")), states)
    tables.write_sources(rows, a.out, "test")
    lists = tables.id_lists(rows.where("src = 1").select(F.col("entity_id").alias("s1")), truth.select("s1", F.col("other").alias("q"), F.lit(1.0).alias("p")))
    tables.write_id_lists(lists, f"{a.out}/gt.tsv", ("source1_entity_id", "matched_entity_ids"))


def proxy_report(spark, a):
    from kinlink.operators import features

    parsed = spark.read.parquet(a.parsed)
    words = features.modifier_words(features.vocabulary(parsed.where("src = 1"), "s1"), features.vocabulary(parsed.where("src > 1"), "q"))
    report.proxy_report(_masters(spark, a), tables.read_matches(tables.read_truth(spark, a.matching)), words, parsed.select("entity_id", "name_core")).show(truncate=False)


def postprocess(spark, a):
    kept = linkage.postprocess(tables.read_scores(spark, a.scores), spark.read.parquet(a.parsed), _pairs_of(a.thresholds), sibling_countries=_list(a.siblings), camps=_pairs_of(a.camps), kinds=_list(a.kinds) or None)
    _matches(spark, a, kept)


def stratify(spark, a):
    parsed, other = spark.read.parquet(a.parsed), spark.read.parquet(a.reference_parsed)
    truth = relational.explode_truth(tables.read_truth(spark, a.truth))
    reference = relational.label_pairs(linkage.celled(tables.read_scores(spark, a.reference), other), truth)
    kept = linkage.stratify(tables.read_scores(spark, a.scores), parsed, parsed.where("src = 1").count(), reference, other.where("src = 1").count(), float(a.precision or 0.75))
    _matches(spark, a, kept)


def camp_drop(spark, a):
    from kinlink.operators import features

    parsed = spark.read.parquet(a.parsed)
    rows = features.with_records(tables.read_scores(spark, a.scores), parsed, parsed, ["name_core", "hn"])
    core = lambda c: F.array_sort(F.array_distinct(c))
    kept = decision.drop_camps(rows.withColumn("s_core", core("s_name_core")).withColumn("q_core", core("q_name_core")), _pairs_of(a.limits), _list(a.kinds) or ["num_same_core", "num_swap_core", "num_other_core", "name_swap"])
    tables.write_checkpoint(kept.select("s1", "q", "p", "country"), a.out)


def merge_countries(spark, a):
    tables.write_checkpoint(tables.read_scores_of(spark, a.base, {c: a.other for c in _list(a.countries)}), a.out)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinlink")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        p = sub.add_parser(name)
        for o in options.split():
            p.add_argument(f"--{o}")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("kinlink").getOrCreate()
    {
        "train": train, "predict": predict, "ensemble": ensemble_, "decide": decide, "validate": validate, "blend": blend, "export-pairs": export_pairs, "slice": slice_,
        "proxy-report": proxy_report, "postprocess": postprocess, "stratify": stratify, "camp-drop": camp_drop, "merge-countries": merge_countries,
    }[a.command](spark, a)


if __name__ == "__main__":
    main()
