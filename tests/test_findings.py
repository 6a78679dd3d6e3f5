"""Small inputs on which a review's findings showed."""

import re

import duckdb
from oracle import SMALL, rows
from pyspark.sql import functions as F

from kinlink.operators import blocking
from kinlink.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def documents(spark, folder, texts, lang=lambda i: "en", source=lambda i: "src0"):
    """A folder whose documents are the texts, with ids from 0."""
    spark.createDataFrame([(i, t, lang(i), source(i), len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def check(spark, folder, name):
    """The query's rows equal its SQL's, and there are some."""
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = rows(df.select(*columns).collect())
    assert mine and mine == rows(c.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())


def test_rescue_kinds_street_types_initials_and_empty_states(spark, tmp_path):
    texts = ["acme one two three ch main", "acme four five six ch other", "acme four five six ch other", "acme blue cat dog oak road", "acme bcd x y oak way", "acme bcd"]
    check(spark, documents(spark, tmp_path, texts, source=lambda i: ""), "rescue_kinds")
    words = " ".join(f"w{i}" for i in range(3))
    long = "-".join(f"t{i}" for i in range(120))
    check(spark, documents(spark, tmp_path / "long", [f"acme {words} st x", f"acme-{long} a b st y", f"acme-{'-'.join(f'u{i}' for i in range(119))}-t119 a b st y", f"acme-{long}-z a b st y"]), "rescue_kinds")


def test_large_parts_are_searched_without_the_postings_join(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("every co-occurring pair would be shuffled")

    monkeypatch.setattr(blocking, "products", fail)
    n = 20_001
    masters = spark.range(n).select(F.format_string("m%05d", "id").alias("entity_id"), F.array(F.concat(F.lit("t"), (F.col("id") % 10_000).cast("string")), F.concat(F.lit("u"), (F.col("id") % 7).cast("string"))).alias("terms"))
    queries = masters.where("entity_id in ('m00003', 'm12345')").withColumn("entity_id", F.concat(F.lit("q"), "entity_id"))
    members = lambda df: df.select(F.lit("p").alias("part"), F.col("entity_id").alias("id"))
    out = blocking.top_names(masters, queries, members(masters), members(queries).withColumn("k", F.lit(2)))
    found = {(r.q, r.s1, round(r.score, 6)) for r in out.collect()}
    # The words u0 to u6 are cut by frequency; t3 and t2345 have two masters each.
    assert found == {("qm00003", "m00003", 1.0), ("qm00003", "m10003", 1.0), ("qm12345", "m02345", 1.0), ("qm12345", "m12345", 1.0)}


def _mixed(n=90):
    """Texts of one first word with few other words and numbers, some of many words."""
    words = ["ada", "boa", "cod", "12", "xy", "dew", "elk"]
    few = [f"acme {words[i % 7]} {words[i // 7 % 7]} {words[i * i % 5]} street {i}" for i in range(n)]
    return [*few, *("acme-" + "-".join(f"w{(i * j) % 11}ab" for j in range(2, 11)) + f" a b c {i}" for i in range(12))]


def test_peer_both_makes_no_pairs_of_candidates(spark, tmp_path):
    folder = documents(spark, tmp_path, _mixed())
    check(spark, folder, "peer_both_exact")
    plan = QUERIES["peer_both_exact"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((s1" not in plan and "(q = o)" not in plan and "NOT (q" not in plan


def test_pairs_are_dealt_and_not_shuffled(spark, tmp_path, monkeypatch):
    from kinlink.operators import relational

    folder = documents(spark, tmp_path, _mixed())
    monkeypatch.setattr(relational, "BLOCK", 100, raising=False)
    for name in ("addr_alpha_jacc", "first_token_jaccard", "peer_both_exact"):
        check(spark, folder, name)
    for name in ("addr_alpha_jacc", "rescue_kinds"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner, (s1#" not in plan and "Join Inner, (q#" not in plan


def _count(spark, name, word):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_planned_search_reads_the_records_few_times(spark):
    assert _count(spark, "planned_topk", "Relation [") <= 16


def test_recall_searches_once(spark):
    assert _count(spark, "blocking_recall", "FlatMapGroupsInArrow") == 1


def _plan(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_first_tokens_are_not_shuffled(spark, tmp_path):
    for name in ("id_list_prefixes", "freq_features"):
        plan = _plan(spark, name)
        assert not re.search(r"Window|Aggregate \[s1#\d+, q#\d+\]|Join Inner, \((s1|q)#", plan)
        check(spark, documents(spark, tmp_path / name, _mixed()), name)


def test_features_of_few_values_are_made_once(spark, tmp_path, monkeypatch):
    folder = documents(spark, tmp_path, _mixed())
    assert "Join Cross" in _plan(spark, "ident_features")
    check(spark, folder, "ident_features")
    from kinlink.operators import features

    monkeypatch.setattr(features, "VALUES", 1)
    assert "Join Cross" not in _plan(spark, "ident_features", folder)
    check(spark, folder, "ident_features")


def test_records_put_only_used_words_in_lower_case(spark, tmp_path):
    assert not re.search(r"lower\(text#|split\(lower\(text#", _plan(spark, "legal_relation"))
    texts = ["acme one two", " \n acme one\ttwo three " + " ".join(f"W{i}" for i in range(60)), "ACME One\r\n\r\ntwo", "", "   ", "acme " + "x" * 5000 + " Y " * 40, "Acme ΟΔΟ ÄÉ two 1 2 3 4 5 6 7 8 9 ΟΔ ÖÖ", "acme\x0bone\x0ctwo three"]
    for name in ("char_trigrams", "addr_docs", "legal_relation"):
        check(spark, documents(spark, tmp_path / name, texts), name)


def test_anchors_are_found_in_blocks(spark, tmp_path, monkeypatch):
    plan = _plan(spark, "anchor_features")
    assert not re.search(r"Window|Join \w+, \(+(s1|q)#", plan)
    from kinlink.operators import features

    for name, block in (("one", 1 << 19), ("several", 60)):
        monkeypatch.setattr(features, "ANCHOR_BLOCK", block)
        check(spark, documents(spark, tmp_path / name, _mixed()), "anchor_features")


def test_modifiers_come_along_in_the_join(spark, tmp_path):
    assert not re.search(r"Aggregate \[s1#\d+, q#\d+\]|Join \w+, \(+(s1|q)#", _plan(spark, "modifier_features"))
    check(spark, documents(spark, tmp_path, [*_mixed(), "acme", "acme acme", "boa cod"], lang=lambda i: "de" if i % 9 == 4 else "en"), "modifier_features")


def test_peer_shares_are_counted_in_blocks(spark, tmp_path, monkeypatch):
    assert not re.search(r"Aggregate \[s1#\d+|Join \w+, \(+(s1|q)#", _plan(spark, "peer_share"))
    from kinlink.operators import features

    for name, block in (("one", 1 << 19), ("several", 60)):
        monkeypatch.setattr(features, "ANCHOR_BLOCK", block)
        check(spark, documents(spark, tmp_path / name, [*_mixed(), "acme", "boa cod"]), "peer_share")


def test_equal_names_are_compared_once(spark, tmp_path, monkeypatch):
    from kinlink.operators import relational

    texts = [*_mixed(), *(f"acme boa {i % 2}" for i in range(20)), *["acme"] * 9, "boa cod", "boa acme boa"]
    for block in (relational.HELD, 60):
        monkeypatch.setattr(relational, "HELD", block)
        folder = documents(spark, tmp_path / str(block), [f"{x} z {i}" if x != "acme" else x for i, x in enumerate(texts)])
        assert "array_union" not in _plan(spark, "first_token_jaccard", folder)
        check(spark, folder, "first_token_jaccard")


def test_fuzzy_differences_of_equal_names_are_made_once(spark, tmp_path):
    from kinlink.functions.similarity import jaro_winkler_of, ratio_of
    from kinlink.plans.views import Views

    def plain(s, q):
        missing, extra = sorted(set(s) - set(q)), []
        for x in sorted(set(q) - set(s)):
            near = next((y for y in missing if jaro_winkler_of(x, y) >= 0.88 or (len(x) >= 4 and len(y) >= 4 and ratio_of(x, y) >= 75)), None)
            extra.append(x) if near is None else missing.remove(near)
        return " ".join(missing), " ".join(extra)

    words = ["strasse", "strase", "boat", "boats", "taob", "ab", "abc", "a", "mississippi", "misisipi", "été", "ete", "7", "77"]
    texts = [f"acme {words[i % 14]} {words[i * i % 13]} {words[i // 3 % 14]} tail {i}" for i in range(90)]
    folder = documents(spark, tmp_path / "d", texts)
    assert "ArrowEvalPython" not in _plan(spark, "fuzzy_token_difference", folder)
    v = Views(spark, folder)
    names = {r.entity_id: r.name_core for r in v.records().collect()}
    pairs = {(r.s1, r.q, *plain(names[r.s1], names[r.q])) for r in v.record_pairs().collect()}
    assert pairs and pairs == {(r.s1, r.q, r.missing, r.extra) for r in QUERIES["fuzzy_token_difference"](spark, folder).collect()}


def test_pair_features_come_along_in_the_join(spark, tmp_path):
    from kinlink.operators.blocking import pair_scores
    from kinlink.plans import queries_features as QF
    from kinlink.plans.views import Views

    # Equal texts in two countries are a true pair, but no pair of one country.
    texts = [*_mixed(), "acme boa one", "acme boa one", "acme boa one", "boa cod", "boa", ""]
    v = Views(spark, documents(spark, tmp_path / "d", texts, lang=lambda i: "de" if i % 9 == 4 else "en"))
    out = QF._featured(v, 60).select("s1", "q", "y", "name_cos")
    assert not re.search(r"Join \w+, \(+(s1|q)#", out._jdf.queryExecution().optimizedPlan().toString())
    cos = {(r.s1, r.q): r.score for r in pair_scores(v.record_pairs(), *v.name_docs(), *v.members()).collect()}
    true = {(r.s1, r.other) for r in v.record_truth().collect()}
    want = sorted((r.s1, r.q, int((r.s1, r.q) in true), round(cos.get((r.s1, r.q), 0.0), 8)) for r in v.record_pairs().collect())
    assert any(x[2] for x in want) and want == sorted((r.s1, r.q, r.y, round(r.name_cos, 8)) for r in out.collect())


def test_features_are_made_once_for_all_stages(spark, monkeypatch):
    from kinlink.plans import queries_features as QF

    made, old = [], QF._featured
    monkeypatch.setattr(QF, "_featured", lambda *x: made.append(old(*x)) or made[-1])
    out = QUERIES["model_importance"](spark, SMALL)
    assert len(made) == 1 and "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 6


def test_anchors_are_ranked_by_name_too(spark, tmp_path):
    # Queries 1 and 101 have one p1; 101's name is the master's, 1's isn't.
    texts = ["acme boa cod elk z" if i in (0, 101) else "acme xxx yyy zzz z" if i == 1 else f"other{i} a b c" for i in range(102)]
    folder = documents(spark, tmp_path / "d", texts)
    rows = {r.q: r for r in QUERIES["anchor_features"](spark, folder).where("s1 = 'S1-0'").collect()}
    assert {q: r.q_is_anchor for q, r in rows.items()} == {"S2-1": 0, "S3-101": 1}
    # acme xxx yyy zzz and acme boa cod elk share seven letters and blanks of 16.
    assert {r.anc_name_q for r in rows.values()} == {43.75}
    check(spark, folder, "anchor_features")


def test_many_strings_are_compared_as_one_by_one_are():
    from kinlink.functions import similarity

    for n in (1, 9, 40, 150):
        a, b = ([("abé cab b" * 20)[i * i % 7 : i * i % 7 + i * n // 10] + "xy"[: i % 3] * (i % 4) for i in range(m)] for m in (11, 13))
        assert similarity.ratios_of(a, b).tolist() == [[similarity.ratio_of(x, y) for y in b] for x in a]


def test_best_match_does_not_depend_on_the_masters_number(spark, tmp_path):
    # 2,010 masters, whose name's words are all frequent; the small folder has the same shares and no cut either way.
    def texts(n):
        return [f"acme {'boa cod elk'.split()[i // 3 % 3]} {'red tan'.split()[i // 9 % 2]} dew z{i}" for i in range(n)]

    for n in (90, 6030):
        folder = documents(spark, tmp_path / str(n), texts(n))
        rows = QUERIES["best_match"](spark, folder).collect()
        assert len(rows) == n - n // 3 and all(r.accepted and r.score == 1 for r in rows)
        check(spark, folder, "best_match")


def test_frequent_terms_are_multiplied_as_a_matrix(spark, monkeypatch):
    found = []
    for share in (2.0, 0.0):
        monkeypatch.setattr(blocking, "OFTEN", share)
        found.append(sorted(map(str, QUERIES["best_match"](spark, SMALL).collect())))
    assert found[0] and found[0] == found[1]


def test_blended_scores_are_made_with_the_pairs(spark, tmp_path, monkeypatch):
    from kinlink.operators import ensemble, features, model
    from kinlink.plans.views import Views

    texts = [*(f"{x} {i * i % 7} main-{i % 5} street {x[:9]}" for i, x in enumerate(_mixed())), *["acme Boa | cod"] * 9, "acme", "acme |", "boa cod", "boa É acme " + "x" * 130]
    folder = documents(spark, tmp_path / "d", texts, lang=lambda i: None if i % 10 == 7 else "en")
    v = Views(spark, folder)
    p = v.record_pairs().withColumn("p", ((F.substring("q", 4, 20).cast("bigint") * 37) % 100) / 100.0)
    want = sorted((r.s1, r.q, r.p) for r in ensemble.blend(p, model.SimilarityScorer().score(ensemble.text_pairs(v.record_pairs(), v.records())), 0.3).collect())
    for block in (features.HELD, 60):
        monkeypatch.setattr(features, "HELD", block)
        out = QUERIES["scorer_blend"](spark, folder)
        assert not re.search(r"Join \w+, \(+(s1|q)#|ArrowEvalPython", _plan(spark, "scorer_blend", folder))
        assert want and want == sorted((r.s1, r.q, r.p) for r in out.collect())


def test_similarities_in_blocks_are_those_of_the_join(spark, tmp_path, monkeypatch):
    from kinlink.operators import features
    from kinlink.plans import queries_features as QF
    from kinlink.plans.views import Views

    texts = [*(f"{x} {i * i % 7} main-{i % 5} street {x[:9]}" for i, x in enumerate(_mixed())), *["acme boa cod"] * 9, "acme", "acme acme", "boa cod", "acme " + "x" * 70 + " b", "acme cod", "acme cod"]
    v = Views(spark, documents(spark, tmp_path / "d", texts, lang=lambda i: None if i % 10 == 7 else "de" if i % 9 == 4 else "en"))
    rows = lambda df: sorted((r.s1, r.q, r.y, *(round(r[c], 8) for c in features.SIMILAR)) for r in df.select("s1", "q", "y", *features.SIMILAR).collect())
    want = rows(QF._featured(v))
    assert any(x[2] for x in want)
    for block in (features.HELD, 60):
        monkeypatch.setattr(features, "HELD", block)
        out = QF._featured(v, None, features.SIMILAR)
        assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert rows(out) == want


def test_many_names_are_compared_as_one_by_one_are():
    from kinlink.functions import similarity

    for n in (1, 9, 40, 70):
        a, b = ([("abé cab b" * 20)[i * i % 7 : i * i % 7 + i * n // 60] + "xyz"[i % 3 :] for i in range(m, m + 60)] for m in (0, 3))
        assert similarity.jaro_winkler_each(a, b).tolist() == [similarity.jaro_winkler_of(x, y) for x, y in zip(a, b)]
