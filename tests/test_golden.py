"""Hand-derived cases of parsing, relations, decisions and metrics."""

import pytest
from pyspark.sql import functions as F

from kinlink.functions import address, name, similarity, text
from kinlink.operators import decision, ensemble, features, report
from kinlink.sources import tables


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("raw", "expected"), [("4-1-10/1/2", ["411012"]), ("e-4/39", ["e439"]), ("plot no-176", ["176"]), ("h.no 332", ["332"]), ("17/34", ["1734"]), ("0014", ["14"]), ("1003a", ["1003a"]), ("1st floor", [])])
def test_identifiers(spark, raw, expected):
    assert _one(spark, address.identifiers(F.array(F.lit(raw))))[0] == expected


@pytest.mark.parametrize(
    ("a", "b", "sa", "sb", "code", "log"),
    [("", "", "", "", 0, -1), ("12", "", "", "", 1, -1), ("", "12", "", "", 2, -1), ("12", "12", "a", "a", 3, 0), ("12", "12", "", "a", 4, 0), ("3195", "319", "", "", 5, 7.964503), ("508", "512", "", "", 6, 1.609438), ("506", "527", "", "", 7, 3.091042), ("360", "64", "", "", 8, 5.693732), ("123456789012", "5", "", "", 8, 20.723266)],
)
def test_house_relation(spark, a, b, sa, sb, code, log):
    c, x = features.house_relation(*(F.lit(v) for v in (a, b, sa, sb)))
    row = _one(spark, c.alias("c"), x.alias("x"))
    assert row.c == code
    assert row.x == pytest.approx(log, abs=1e-5)


@pytest.mark.parametrize(("raw", "expected"), [("6lobal", "global"), ("8lue", "blue"), ("123", "123")])
def test_deleet(spark, raw, expected):
    assert _one(spark, text.deleet(F.lit(raw)))[0] == expected


def test_folds(spark):
    row = _one(spark, text.ocr_fold(F.lit("salerno")).alias("a"), text.ocr_fold(F.lit("lnsurance")).alias("b"), text.skeleton(F.lit("jewellers")).alias("c"), text.city_key(F.lit("St. Louis")).alias("d"), text.zero_strip(F.lit("000")).alias("e"))
    assert tuple(row) == ("salemo", "insurance", "jvlrs", "saint louis", "0")


@pytest.mark.parametrize(
    ("raw", "core", "legal", "alt", "domain"),
    [
        ("Solcirax formerly known as Heartland Ministries", ["heartland", "ministries"], [], ["solcirax"], 0),
        ("www.fudit.com", ["fudit"], [], [], 1),
        ("Acme Provate Limted", ["acme"], ["ltd", "pvt"], [], 0),
        ("Acme L.L.C.", ["acme"], ["llc"], [], 0),
        ("Limited", ["limited"], ["ltd"], [], 0),
        (None, [], [], [], 0),
        ("", [], [], [], 0),
    ],
)
def test_names(spark, raw, core, legal, alt, domain):
    r = name.parse_names(spark.createDataFrame([(raw,)], "business_name string")).first()
    assert (r.name_core, r.legal, r.name_alt, r.domain) == (core, legal, alt, domain)


def test_addresses(spark):
    rows = [("10 1/2 Elm Ct, Dover, Delaware", "US"), ("N/A", "US"), (None, "US"), ("First Flo, Or, 3 Main Street, Reno, NV", "US")]
    a, b, c, d = address.parse_addresses(spark.createDataFrame(rows, "business_address string, country string")).orderBy(F.length("business_address").desc_nulls_last()).select("business_address", "state", "hn", "half", "addr_empty", "city", "street").collect()[:4]
    by = {r.business_address: r for r in (a, b, c, d)}
    assert tuple(by["10 1/2 Elm Ct, Dover, Delaware"])[1:] == ("US-DE", "10", 1, 0, "dover", ["elm", "ct"])
    assert by["N/A"].addr_empty == 1
    assert by[None].addr_empty == 1
    assert (by[rows[3][0]].state, by[rows[3][0]].hn) == ("US-NV", "3")


def test_decision_values(spark):
    value = lambda ps, m, u: _one(spark, decision.expected_f(F.array(*map(F.lit, ps)), F.lit(m), u))[0]
    assert value([0.9], 0, 0.0) == pytest.approx(0.1)
    assert value([0.9], 1, 0.0) == pytest.approx(0.9)
    assert [value([0.9, 0.5], m, 0.0) for m in (0, 1, 2)] == pytest.approx([0.05, 0.825, 0.727778], abs=1e-6)
    assert _one(spark, decision.pmf(F.array(F.lit(0.9), F.lit(0.5))))[0] == pytest.approx([0.05, 0.5, 0.45])


@pytest.mark.parametrize(("n", "tp", "fp", "score"), [(3, 3, 1, 0.789474), (3, 2, 0, 0.909091), (0, 0, 0, 1.0), (0, 0, 1, 0.0)])
def test_metric(spark, n, tp, fp, score):
    assert _one(spark, report.f_score(F.lit(tp), F.lit(fp), F.lit(n)))[0] == pytest.approx(score, abs=1e-6)


def test_id_lists(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-2", 0.8), ("S1-1", "S2-1", 0.7), ("S1-1", "S1-9", 0.6), ("S1-1", "", 0.5)], "s1 string, q string, p double")
    masters = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    tables.write_id_lists(tables.id_lists(masters, pairs), f"{tmp_path}/x", ("a", "b"))
    lines = [line for p in sorted((tmp_path / "x").glob("part-*")) for line in p.read_text().splitlines()[1:]]
    assert lines == ["S1-1\tS2-1,S3-2", "S1-2\t"]


def test_ensembles_differ(spark):
    a = spark.createDataFrame([("x", "y", 0.8, "US")], "s1 string, q string, p double, country string")
    b = a.where("false")
    assert ensemble.mean_of_scored([a, b]).first().p == pytest.approx(0.8)
    assert ensemble.mean_with_zeros([a, b]).first().p == pytest.approx(0.4)


def test_similarity_kernels():
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.ratio_of("abcd", "bcde") == pytest.approx(75.0)
    assert similarity.token_set_of("new york mets", "mets of new york") == 100.0
    assert similarity.partial_of("abc", "xxabcxx") == 100.0
    assert similarity.fuzzy_difference_of(["acme", "traders"], ["acme", "trader", "exports"]) == ([], ["exports"])


def test_peer_both_switches_at_the_group_size(spark):
    """A master with 301 candidates takes the linear way, one with 300 the exact one."""
    rows = [(f"S1-{g}", f"S2-{g}-{i}", 0.5, ["a"], ["a", f"extra{i % 3}"], ["1"], ["1", str(10 + i % 2)]) for g, n in ((1, 300), (2, 301)) for i in range(n)]
    df = spark.createDataFrame(rows, "s1 string, q string, p1 double, s_name_core array<string>, q_name_core array<string>, s_nums array<string>, q_nums array<string>")
    out = {(r.s1, r.q): r.peer_both for r in features.peer_features(df).collect()}
    assert out[("S1-1", "S2-1-0")] == 49
    assert out[("S1-2", "S2-2-0")] == 50
    assert len(out) == 601


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA\t\tUS\n")
        z.writestr("__MACOSX/d/x.tsv", "junk")
    assert [tuple(r) for r in tables.read_zip_member(spark, str(tmp_path / "a.zip"), "x.tsv").collect()] == [("S1-1", "A", "", "US")]
