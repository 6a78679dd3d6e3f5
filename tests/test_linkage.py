"""The dataflows from records to lists, small."""

from pyspark.sql import functions as F

from oracle import SMALL
from kinlink.functions import address, name
from kinlink.operators import decision
from kinlink.plans import linkage
from kinlink.plans.views import Views
from kinlink.sources import tables


def test_train_and_predict(spark, tmp_path):
    v = Views(spark, SMALL)
    records = v.records().select("entity_id", "business_name", "business_address", "country", "src")
    meta = linkage.train(spark, records, v.record_truth(), f"{tmp_path}/work", {"k_block": 4, "k_keep": 2, "k_nostate": 4}, rounds=2, depth=2, refit=True, dump=f"{tmp_path}/dump")
    assert 1 <= meta["rounds"] <= 2
    assert set(linkage.STAGE2) <= set(spark.read.parquet(f"{tmp_path}/dump/pairs.parquet").columns)
    assert meta["decision"] in ("expected", "threshold")
    assert tables.read_artifact(spark, f"{tmp_path}/work/meta")["features2"] == linkage.STAGE2
    assert len(linkage.STAGE2) == 117
    kept = linkage.predict(spark, records, f"{tmp_path}/work", f"{tmp_path}/out", calibrate=None, decide_by="threshold")
    scores = tables.read_scores(spark, f"{tmp_path}/out/scores")
    assert scores.count() > 0
    assert kept.join(scores, ["s1", "q"], "left_anti").count() == 0
    lists = tables.read_truth(spark, f"{tmp_path}/out/matching_results.tsv")
    assert lists.count() == records.where("src = 1").count()


def test_postprocess(spark):
    records = [("S1-1", "Acme Tools LLC", "12 Main Street, Austin, Texas", "US"), ("S2-1", "Acme Tools", "12 Main St, Austin, TX", "US"), ("S2-2", "Acme Tools Inc", "77 Main St, Austin, TX", "US"), ("S2-3", "AT", "12 Main St, Austin, TX", "US")]
    parsed = address.parse_addresses(name.parse_names(spark.createDataFrame(records, "entity_id string, business_name string, business_address string, country string")))
    scores = spark.createDataFrame([("S1-1", "S2-1", 0.95, "US"), ("S1-1", "S2-2", 0.9, "US"), ("S1-1", "S2-3", 0.6, "US")], "s1 string, q string, p double, country string")
    kept = linkage.postprocess(scores, parsed, {"US": 0.8}, sibling_countries=["US"])
    assert sorted(r.q for r in kept.collect()) == ["S2-1", "S2-3"]
    assert decision.assign(scores, 0.7).where(F.col("q") == "S2-3").count() == 0


def test_command_line(spark, tmp_path):
    """The commands that need no trained model, on written files."""
    from kinlink import __main__ as cli

    v, d = Views(spark, SMALL), str(tmp_path)
    records = v.records().where("business_name is not null")
    tables.write_sources(records, f"{d}/data", "test")
    tables.write_sources(records, f"{d}/data", "train")
    truth = v.record_truth().select("s1", F.col("other").alias("q"), F.lit(1.0).alias("p"))
    masters = records.where("src = 1").select(F.col("entity_id").alias("s1"))
    tables.write_id_lists(tables.id_lists(masters, truth), f"{d}/data/train_ground_truth.tsv", ("source1_entity_id", "matched_entity_ids"))
    country = records.select(F.col("entity_id").alias("s1"), "country").where("country is not null")
    scores = v.record_pairs().join(country, "s1").withColumn("p", F.pmod(F.xxhash64("s1", "q"), F.lit(100)) / 100.0)
    tables.write_checkpoint(scores.select("s1", "q", "p", "country"), f"{d}/one")
    tables.write_checkpoint(scores.select("s1", "q", (1 - F.col("p")).alias("p"), "country"), f"{d}/two")
    linkage.parse(records.select("entity_id", "business_name", "business_address", "country", "src")).write.parquet(f"{d}/parsed")
    scores.select("s1", "q", F.lit(0.5).alias("c")).write.parquet(f"{d}/other")
    run = lambda *args: cli.main(list(args))
    run("ensemble", "--runs", f"{d}/one,{d}/two", "--out", f"{d}/mean")
    assert tables.read_scores(spark, f"{d}/mean").where("abs(p - 0.5) > 1e-9").count() == 0
    run("blend", "--scores", f"{d}/one", "--other", f"{d}/other", "--weight", "1.0", "--out", f"{d}/blend")
    assert tables.read_scores(spark, f"{d}/blend").where("abs(p - 0.5) > 1e-3").count() == 0
    run("merge-countries", "--base", f"{d}/one", "--other", f"{d}/two", "--countries", "en", "--out", f"{d}/merged")
    assert tables.read_scores(spark, f"{d}/merged").exceptAll(tables.read_scores(spark, f"{d}/two").where("country = 'en'").unionByName(tables.read_scores(spark, f"{d}/one").where("country <> 'en'"))).count() == 0
    run("export-pairs", "--scores", f"{d}/one", "--data-dir", f"{d}/data", "--out", f"{d}/texts")
    assert spark.read.parquet(f"{d}/texts").count() == scores.count()
    run("postprocess", "--scores", f"{d}/one", "--parsed", f"{d}/parsed", "--data-dir", f"{d}/data", "--thresholds", "en=0.5", "--siblings", "en", "--camps", "en=0.9", "--out", f"{d}/matches")
    assert tables.read_truth(spark, f"{d}/matches").count() == masters.count()
    run("camp-drop", "--scores", f"{d}/one", "--parsed", f"{d}/parsed", "--limits", "en=0.9", "--out", f"{d}/camps")
    run("stratify", "--scores", f"{d}/one", "--parsed", f"{d}/parsed", "--reference", f"{d}/two", "--reference-parsed", f"{d}/parsed", "--truth", f"{d}/data/train_ground_truth.tsv", "--precision", "0.1", "--data-dir", f"{d}/data", "--out", f"{d}/strata")
    run("slice", "--data-dir", f"{d}/data", "--states", "US-TX", "--out", f"{d}/slice")
    run("slice", "--data-dir", f"{d}/data", "--states", "US-TX", "--unlabelled", "1", "--out", f"{d}/unlabelled")
    assert tables.read_truth(spark, f"{d}/slice/gt.tsv").count() == tables.read_tsv(spark, f"{d}/slice/test_source1.tsv").count()
    run("proxy-report", "--matching", f"{d}/matches", "--data-dir", f"{d}/data", "--parsed", f"{d}/parsed")
    run("validate", "--matching", f"{d}/matches", "--data-dir", f"{d}/data")
