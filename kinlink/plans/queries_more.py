"""Further queries: readers and dumps, address variants, and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import address as A
from kinlink.functions import name as N
from kinlink.operators import blocking as B
from kinlink.operators import features as X
from kinlink.operators import model as M
from kinlink.operators import relational as R
from kinlink.operators import report as P
from kinlink.plans import queries_features as QF
from kinlink.plans import queries_linkage as QL
from kinlink.plans.queries_relational import _folder, _round
from kinlink.plans.views import Views, sql
from kinlink.sources import tables as T

QUERIES: dict = {}


def query(text: str | None = None, *names: str):
    def keep(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir: fn(Views(spark, sf_dir)), sql(text, *names) if text else None)
        return fn

    return keep


@query("SELECT entity_id, business_name, business_address, country FROM records WHERE doc_id % 10 <> 0", "records")
def tsv_lines(v: Views):
    """Lines of at least four cells; every tenth has three, and some have more."""
    r, path = v.records(), _folder(v)
    cells = F.when(F.col("doc_id") % 10 == 0, F.array("entity_id", "business_name", "country")).when(F.col("doc_id") % 10 == 1, F.array("entity_id", "business_name", "business_address", "country", F.lit("x"))).otherwise(F.array("entity_id", "business_name", "business_address", "country"))
    r.select(F.array_join(cells, "\t")).write.text(path)
    return T.read_lines(v.spark, path)


@query("SELECT s1, other FROM truth EXCEPT SELECT s1, q FROM scores WHERE p >= 0.9", "truth", "scores")
def missed_dump(v: Views):
    """True pairs that weren't found, as CSV and back."""
    path = _folder(v)
    T.write_missed(R.missed_pairs(v.truth(), v.scores().where("p >= 0.9")), path)
    return v.spark.read.csv(path, header=True, schema="s1 long, other long")


@query("SELECT s1, q, p, y FROM labelled WHERE p >= 0.5", "labelled")
def training_dump(v: Views):
    path = _folder(v)
    s, q = v.sides()
    T.write_training_dump(v.labelled().where("p >= 0.5").select("s1", "q", "p", "y"), s.select("entity_id"), q.select("entity_id"), path)
    return v.spark.read.parquet(f"{path}/pairs.parquet")


@query("SELECT * FROM (VALUES ('threshold', '0.75'), ('decision', 'expected')) t(key, value)")
def artifact_roundtrip(v: Views):
    path = _folder(v)
    T.write_artifact(v.spark, {"threshold": 0.75, "decision": "expected"}, path)
    meta = T.read_artifact(v.spark, path)
    return v.spark.createDataFrame([(k, str(x)) for k, x in meta.items()], "key string, value string")


@query("SELECT doc_id, CASE substr(p, 1, 2) WHEN '44' THEN 'FR-PDL' WHEN '33' THEN 'FR-NAQ' ELSE '' END AS state FROM (SELECT doc_id, lpad(CAST(33000 + doc_id * 17 % 20000 AS VARCHAR), 5, '0') AS p FROM documents)")
def gazetteer_state(v: Views):
    code = F.concat(F.lit("1 rue x, "), (33000 + F.col("doc_id") * 17 % 20000).cast("string"), F.lit(" ville"))
    return v.table("documents").select("doc_id", A.gazetteer_state(code, {"44": "FR-PDL", "33": "FR-NAQ"}).alias("state"))


@query(f"SELECT id, array_to_string(list_filter(list_transform(string_split('\"' || replace(a, ', ', '\", ''') || '''', ','), lambda c: trim(regexp_replace(trim(c), '^[\"'']+|[\"'']+$', '', 'g'))), lambda c: c <> '' AND lower(c) NOT IN ('null', '<null>', 'n/a', 'na', 'none', 'nan', '-')), '|') AS parts FROM {QL._PLACES}", "records")
def unquoted_components(v: Views):
    quoted = F.concat(F.lit('"'), F.replace(F.col("a"), F.lit(", "), F.lit("\", '")), F.lit("'"))
    return QL._places(v).select("id", F.array_join(A.components(quoted, unquote=True), "|").alias("parts"))


@query(QL._PARSED.replace(QL._PARTS, "list_transform(string_split(a, ','), lambda c: trim(c))") + " SELECT f.id, coalesce((SELECT max(state) FROM z WHERE z.id = f.id AND z.i = z.pos), '') AS state FROM f", "records")
def state_scan(v: Views):
    return QL._places(v).select("id", A.state_of(F.col("a"), F.col("c")).alias("state"))


@query("""
SELECT part, country, n FROM (SELECT country, part, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, part) AS k FROM (SELECT country, trim(x) AS part FROM (SELECT country, unnest(string_split(business_address, ',')) AS x FROM records))
  WHERE part <> '' AND lower(part) NOT IN ('null', '<null>', 'n/a', 'na', 'none', 'nan', '-') AND NOT regexp_matches(part, '[0-9]') AND length(part) <= 30 GROUP BY country, part) WHERE k <= 50
""", "records")
def component_frequency(v: Views):
    """The most frequent digit-free address components of each country."""
    parts = v.records().select("country", F.explode(A.components(F.col("business_address"))).alias("part")).where(~F.col("part").rlike("[0-9]") & (F.length("part") <= 30))
    n = parts.groupBy("country", "part").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "part"))).where("k <= 50").drop("k")


_TOP = QL._BEST


@query(f"""{_TOP}, b AS (SELECT t.q, t.s1, t.score, s.hn = q.hn AS same, s.country FROM top t JOIN s_side s ON s.entity_id = t.s1 JOIN q_side q ON q.entity_id = t.q WHERE n = 1),
c AS (SELECT country, CASE WHEN score >= 0.8 AND same THEN 'strong_same' WHEN score >= 0.8 THEN 'strong_other' WHEN score >= 0.5 THEN 'mid' ELSE 'weak' END AS kind, count(*) AS n FROM b GROUP BY ALL)
SELECT country, kind, n, round(n / sum(n) OVER (PARTITION BY country), 6) AS share FROM c
""", "s_side", "q_side")
def cosine_mixture(v: Views):
    """Best name cosines in four bins by strength and house number."""
    s, q = v.sides()
    best = R.best_per_query(B.top_names(*v.name_docs(), *v.members()).withColumnRenamed("score", "p"))
    rows = X.with_records(best, s, q, ["hn", "country"])
    kind = F.when((F.col("p") >= 0.8) & (F.col("s_hn") == F.col("q_hn")), "strong_same").when(F.col("p") >= 0.8, "strong_other").when(F.col("p") >= 0.5, "mid").otherwise("weak")
    from pyspark.sql import Window

    n = rows.groupBy(F.col("s_country").alias("country"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return _round(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("country"))), "share")


@query(f"""{_TOP}, m AS (SELECT t.s1, t.other, s.state AS a, q.state AS b, s.country AS c, q.country AS d FROM record_truth t JOIN records s ON s.entity_id = t.s1 JOIN records q ON q.entity_id = t.other LEFT JOIN (SELECT * FROM top WHERE n <= 1) x ON x.s1 = t.s1 AND x.q = t.other WHERE x.q IS NULL)
SELECT CASE WHEN c <> d THEN 'other_country' WHEN b = '' THEN 'no_state' WHEN a <> b THEN 'other_state' ELSE 'low_rank' END AS cause, count(*) AS n FROM m GROUP BY 1
""", "s_side", "q_side", "record_truth")
def blocking_miss_causes(v: Views):
    """Why true pairs aren't the first candidate."""
    top = B.top_k(B.top_names(*v.name_docs(), *v.members()), 1)
    missed = R.missed_pairs(v.record_truth(), top).withColumnRenamed("other", "q")
    r = v.records()
    rows = X.with_records(missed, r, r, ["state", "country"])
    cause = F.when(F.col("s_country") != F.col("q_country"), "other_country").when(F.col("q_state") == "", "no_state").when(F.col("s_state") != F.col("q_state"), "other_state").otherwise("low_rank")
    return rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_TOP}, e AS (SELECT q, min(s1) AS s1 FROM (SELECT s.entity_id AS s1, q.entity_id AS q FROM s_side s JOIN q_side q ON s.country = q.country AND s.name = q.name AND s.state = q.state WHERE len(s.name_core) > 0 AND len(list_intersect(s.street, q.street)) > 0) GROUP BY q HAVING count(*) = 1)
SELECT count(*) AS easy, count(t.q) AS found FROM e LEFT JOIN top t ON t.q = e.q AND t.s1 = e.s1
""", "s_side", "q_side")
def easy_pair_recall(v: Views):
    """Without labels: how many exact twins the candidate search finds."""
    s, q = (x.withColumn("hn", F.col("state")) for x in v.sides())
    easy = R.exact_twins(s, q)
    top = B.top_names(*v.name_docs(), *v.members()).select("q", "s1", F.lit(1).alias("hit"))
    return easy.join(top, ["q", "s1"], "left").agg(F.count(F.lit(1)).alias("easy"), F.count("hit").alias("found"))


@query("SELECT CASE WHEN s_name_core = q_name_core THEN 'same' ELSE 'diff' END AS name, CASE WHEN s_hn = q_hn THEN 'same' ELSE 'diff' END AS number, CASE WHEN s_state = '' THEN 'nostate' WHEN q_state = '' THEN 'empty' WHEN s_state = q_state THEN 'same' ELSE 'diff' END AS state, count(*) AS n FROM twos GROUP BY ALL", "twos")
def agreement_cells(v: Views):
    p = QF._pairs(v)
    pick = lambda a, b: F.when(F.col(a) == F.col(b), "same").otherwise("diff")
    state = F.when(F.col("s_state") == "", "nostate").when(F.col("q_state") == "", "empty").otherwise(pick("s_state", "q_state"))
    return p.groupBy(pick("s_name_core", "q_name_core").alias("name"), pick("s_hn", "q_hn").alias("number"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT y, CAST(least(len(list_filter(q_name_core, lambda t: NOT list_contains(s_name_core, t))), 3) AS INT) AS code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM (SELECT t.*, CAST(r.s1 IS NOT NULL AS INT) AS y FROM twos t LEFT JOIN record_truth r ON r.s1 = t.s1 AND r.other = t.q) GROUP BY y, code", "twos", "record_truth")
def extra_token_counts(v: Views):
    rows = R.label_pairs(QF._pairs(v), v.record_truth())
    return _round(P.relation_shares(rows, F.least(F.size(F.filter("q_name_core", lambda t: ~F.array_contains(F.col("s_name_core"), t))), F.lit(3)).cast("int")), "share")


@query()
def model_importance(v: Views):
    """Gain importances of a fit over all training rows, and what each feature's absence costs true pairs."""
    rows = QF._stored(v, QF.FEATURES[:6])
    m = M.train(rows, QF.FEATURES[:6], rounds=3, depth=2)
    gain = v.spark.createDataFrame(M.importances(m, QF.FEATURES[:6]), "feature string, gain double")
    return gain.join(M.ablation(m, rows, QF.FEATURES[:6]), "feature")


@query("SELECT part, count(*) AS n FROM (SELECT unnest(string_split(business_name, ' ')) AS part FROM records) WHERE part NOT IN ('co', 'pa', 'sa', 'ei') GROUP BY part HAVING count(*) >= 10", "records")
def stripped_names(v: Views):
    words = v.records().select(F.explode(F.split("business_name", " ")).alias("part"))
    bare = words.where(~F.col("part").isin(["co", "pa", "sa", "ei"]) & (N.strip_legal(F.col("part")) == F.col("part")))
    return bare.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
