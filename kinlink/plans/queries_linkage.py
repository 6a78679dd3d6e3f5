"""Queries of parsing, candidate search and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import address as A
from kinlink.functions import constants as K
from kinlink.functions import name as N
from kinlink.functions import text as X
from kinlink.functions import translit
from kinlink.operators import blocking as B
from kinlink.operators import relational as R
from kinlink.operators import report as P
from kinlink.operators import sampling as S
from kinlink.plans.queries_relational import _round
from kinlink.plans.views import Views, sql

QUERIES: dict = {}


def query(text: str | None = None, *names: str):
    def keep(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir: fn(Views(spark, sf_dir)), sql(text, *names) if text else None)
        return fn

    return keep


# Candidate search

_GRAMS = "flatten(list_transform(list_filter(string_split({}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"


@query(f"SELECT entity_id, array_to_string({_GRAMS.format('business_name')}, '~') AS grams FROM records", "records")
def char_trigrams(v: Views):
    return v.records().select("entity_id", F.array_join(B.trigrams(F.col("business_name")), "~").alias("grams"))


#: The reference's rule for frequent terms: they are dropped in parts of more than 2,000 masters.
_CUT = " WHERE n <= 2000 OR df <= 0.05 * n"


def _weights(side: str, terms: str, by: str = "country", cut: str = _CUT) -> str:
    """Unit-length TF-IDF rows (part, id, term, w) of a side, fitted on the masters."""
    return f"""
st AS (SELECT {by} AS part, entity_id AS id, unnest({terms}) AS term FROM s_side), sp AS (SELECT part, id, term, 1 + ln(count(*)) AS tf FROM st GROUP BY ALL),
sz AS (SELECT {by} AS part, count(*) AS n FROM s_side GROUP BY 1), dfs AS (SELECT part, term, count(*) AS df FROM sp GROUP BY ALL),
idf AS (SELECT part, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs JOIN sz USING (part){cut}),
sr AS (SELECT part, id, term, tf * idf AS w FROM sp JOIN idf USING (part, term)), sw AS (SELECT part, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS w FROM sr),
qt AS (SELECT {by} AS part, entity_id AS id, unnest({terms}) AS term FROM q_side), qp AS (SELECT part, id, term, 1 + ln(count(*)) AS tf FROM qt GROUP BY ALL),
qr AS (SELECT part, id, term, tf * idf AS w FROM qp JOIN idf USING (part, term)), qw AS (SELECT part, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS w FROM qr),
pairs AS (SELECT part, q.id AS q, s.id AS s1, round(sum(s.w * q.w), 9) AS score FROM sw s JOIN qw q USING (part, term) GROUP BY ALL)"""


_NAME = _GRAMS.format("array_to_string(name_core, ' ')")


@query(f"WITH {_weights('s', _NAME)} SELECT part, id, term, round(w, 6) AS w FROM sw", "s_side", "q_side")
def tfidf_weights(v: Views):
    (s, _), (m, _) = v.name_docs(), v.members()
    p = B.postings(s, m)
    return _round(B.weights(p, B.inverse_frequency(p, m)), "w")


_TOP = "SELECT part, q, s1, score FROM (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, s1) AS n FROM pairs WHERE score > 1e-6) WHERE n <= 10"


@query(f"WITH {_weights('s', _NAME)} {_TOP}", "s_side", "q_side")
def topk_name(v: Views):
    return B.top_names(*v.name_docs(), *v.members())


_ADDR = "list_concat(addr_toks, CASE WHEN hn <> '' AND len(street) > 0 THEN ['HS_' || hn || '_' || street[1]] ELSE CAST([] AS VARCHAR[]) END, list_transform(list_filter(idents, lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: 'ID_' || t))"


def _addr(df: DataFrame) -> DataFrame:
    return df.select("entity_id", B.address_terms(F.col("addr_toks"), F.col("hn"), F.col("street"), F.col("idents")).alias("terms"))


@query(f"SELECT entity_id, array_to_string({_ADDR}, '~') AS terms FROM records", "records")
def addr_docs(v: Views):
    return _addr(v.records()).select("entity_id", F.array_join("terms", "~").alias("terms"))


@query(f"WITH {_weights('s', _ADDR)} {_TOP}", "s_side", "q_side")
def topk_addr(v: Views):
    s, q = v.sides()
    return B.top_names(_addr(s), _addr(q), *v.members())


def _both(v: Views) -> DataFrame:
    s, q = v.sides()
    side = lambda df: df.withColumn("name_terms", B.trigrams(F.array_join("name_core", " "))).withColumn("addr_terms", B.address_terms(F.col("addr_toks"), F.col("hn"), F.col("street"), F.col("idents")))
    return B.candidates(side(s), side(q), *v.members())


def _renamed(text: str, tag: str) -> str:
    import re

    return re.sub(r"\b(st|sp|sz|dfs|idf|sr|sw|qt|qp|qr|qw|pairs) AS \(", lambda m: f"{tag}{m[1]} AS (", re.sub(r"(FROM|JOIN) (st|sp|sz|dfs|idf|sr|sw|qt|qp|qr|qw)\b", lambda m: f"{m[1]} {tag}{m[2]}", text))


_CANDIDATES = f"""WITH {_renamed(_weights('s', _NAME), 'n')}, {_renamed(_weights('s', _ADDR), 'a')},
b AS (SELECT coalesce(n.part, a.part) AS part, coalesce(n.q, a.q) AS q, coalesce(n.s1, a.s1) AS s1, coalesce(n.score, 0) AS name_cos, coalesce(a.score, 0) AS addr_cos
  FROM (SELECT * FROM npairs WHERE score > 1e-6) n FULL JOIN (SELECT * FROM apairs WHERE score > 1e-6) a ON n.part = a.part AND n.q = a.q AND n.s1 = a.s1),
r AS (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY name_cos DESC, s1) AS rn, row_number() OVER (PARTITION BY part, q ORDER BY addr_cos DESC, s1) AS ra, row_number() OVER (PARTITION BY part, q ORDER BY name_cos + addr_cos DESC, s1) AS rs FROM b)"""


@query(_CANDIDATES + " SELECT part, q, s1, name_cos, addr_cos FROM r WHERE rn <= 10 AND name_cos > 0 OR ra <= 10 AND addr_cos > 0 OR rs <= 10", "s_side", "q_side")
def blocking_union_rescore(v: Views):
    return _both(v)


@query(_CANDIDATES + " SELECT q, s1, name_cos, addr_cos FROM r WHERE rn <= 3 AND name_cos > 0 OR ra <= 3 AND addr_cos > 0 OR rs <= 3", "s_side", "q_side")
def prune_or(v: Views):
    return B.prune(_both(v), 3).select("q", "s1", "name_cos", "addr_cos")


_PLAN = """
WITH s AS (SELECT entity_id, country, CASE WHEN doc_id % 7 = 0 THEN '' ELSE state END AS state FROM s_side), q AS (SELECT entity_id, country, CASE WHEN doc_id % 5 = 0 THEN '' ELSE state END AS state FROM q_side),
k AS (SELECT DISTINCT country, state FROM s WHERE state <> ''){reach}
SELECT 's' AS side, country || '|' || state AS part, entity_id AS id FROM s WHERE state <> '' UNION ALL SELECT 's', country || '|-', entity_id FROM s UNION ALL SELECT 's', country || '|s1', entity_id FROM s WHERE state = ''
UNION ALL SELECT 'q', country || '|' || state, entity_id FROM {own} WHERE (country, state) IN (SELECT (country, state) FROM k)
UNION ALL SELECT 'q', country || '|-', entity_id FROM q WHERE (country, state) NOT IN (SELECT (country, state) FROM k) UNION ALL SELECT 'q', country || '|s1', entity_id FROM q WHERE (country, state) IN (SELECT (country, state) FROM k)
"""


def _plan(v: Views, neighbours=None) -> DataFrame:
    s, q = v.sides()
    s = s.withColumn("state", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("state")))
    q = q.withColumn("state", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("state")))
    a, b = B.partition_plan(s, q, neighbours)
    return a.select(F.lit("s").alias("side"), "part", "id").unionByName(b.select(F.lit("q").alias("side"), "part", "id"))


@query(_PLAN.format(reach="", own="q"), "s_side", "q_side")
def partition_plan(v: Views):
    return _plan(v)


@query(_PLAN.format(reach=", n AS (SELECT entity_id, country, unnest(CASE state WHEN 'src1' THEN ['src1', 'src2'] WHEN 'src2' THEN ['src2', 'src1'] ELSE [state] END) AS state FROM q)", own="n"), "s_side", "q_side")
def neighbour_states(v: Views):
    return _plan(v, {"src1": ["src2"], "src2": ["src1"]})


_BEST = """WITH {weights}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS n FROM pairs WHERE score > 1e-6) WHERE n <= 10)"""
_WHOLE, _BEST = _BEST.format(weights=_weights("s", _NAME, cut="")), _BEST.format(weights=_weights("s", _NAME))


@query(f"{_WHOLE} SELECT q, s1, score, score >= 0.8 AS accepted FROM top WHERE n = 1", "s_side", "q_side")
def best_match(v: Views):
    """Every query record's best master by all terms of the names, and whether to accept it."""
    top = B.top_names(*v.name_docs(), *v.members(), 1.0)
    best = R.best_per_query(top.withColumnRenamed("score", "p"))
    return best.select("q", "s1", F.col("p").alias("score"), (F.col("p") >= 0.8).alias("accepted"))


@query(f"""{_BEST}
SELECT count(*) AS n_true, count(p.q) AS n_found, round((SELECT count(*) / count(DISTINCT q) FROM top), 6) AS per_query, round(count(p.q) / count(*), 6) AS recall FROM record_truth t LEFT JOIN top p ON p.s1 = t.s1 AND p.q = t.other
""", "s_side", "q_side", "record_truth")
def blocking_recall(v: Views):
    top = B.top_names(*v.name_docs(), *v.members())
    return _round(B.recall(top, v.record_truth()), "per_query", "recall")


@query(f"""{_BEST} SELECT CAST(sum((coalesce(n, 1000) <= 1)::INT) AS BIGINT) AS found_1, CAST(sum((coalesce(n, 1000) <= 3)::INT) AS BIGINT) AS found_3, CAST(sum((coalesce(n, 1000) <= 10)::INT) AS BIGINT) AS found_10, count(*) AS n_true
FROM record_truth t LEFT JOIN top p ON p.s1 = t.s1 AND p.q = t.other
""", "s_side", "q_side", "record_truth")
def recall_by_k(v: Views):
    return B.recall_by_cut(B.top_names(*v.name_docs(), *v.members()), v.record_truth(), [1, 3, 10])


# Normalisation: the records' addresses and names, after a few written ones that meet every rule

ADDRESSES = [
    ("12 Main Street, Springfield, IL", "US"), ("b-7/21, Bandra West, Bombay, Maharashtra", "India"), ("plot no-205, Sector 5, Gurugram, HR", "India"), ("3 bis rue des Lilas, Nantes, Loire-Atlantique", "France"),
    ("First Floor, 0014 North 2nd Avenue, Austin, Texas", "US"), ("N/A", "US"), ("", "India"), ("H.No 418, 9/52, Market Road, Poona, MH", "India"), ("2407c Lake Dr, Unit 7, Portland, OR", "US"),
    ("10 1/2 Elm Ct, Dover, Delaware", "US"), ("Birch Rd, Fresno, CA", "US"), ("<NULL>, 5 Hill Lane, , Reno, nevada.", "US"), ("99999 Ocean Blvd, , CA", "US"), ("12 avenue de l'Orme, Bordeaux, Gironde", "France"),
]
NAMES = [
    "Brightfen formerly known as Oakmoor Chapel", "www.mellowpine.com", "Tarn Provate Limted", "Tarn L.L.C.", "M/S Shri Gopal Traders Pvt. Ltd.", "G1obal 8lue Tech Inc (ref: 12345)", "A.B.C. & Sons Company", "Limited",
    "The O'Mara Group l l c", "Société Générique SA", "Bolt+Co dba Fasteners", "Finch 1234567 Corp", "lncorporated Foods Corparation",
]
_VALUES = ", ".join("('{}', '{}')".format(a.replace("'", "''"), c) for a, c in ADDRESSES)
_PLACES = f"(SELECT -row_number() OVER () AS id, a, c FROM (VALUES {_VALUES}) t(a, c) UNION ALL SELECT doc_id, coalesce(business_address, ''), country FROM records)"


def _fixture(v: Views, rows: list, schema: str) -> DataFrame:
    """The rows with ids -1, -2 and so on."""
    return v.spark.createDataFrame([(-i - 1, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], schema)


def _places(v: Views) -> DataFrame:
    """(id, a, c): written addresses with their country, and all records'."""
    own = v.records().select(F.col("doc_id").alias("id"), F.coalesce("business_address", F.lit("")).alias("a"), F.col("country").alias("c"))
    return _fixture(v, ADDRESSES, "id long, a string, c string").unionByName(own)


def _addresses(v: Views) -> DataFrame:
    return A.parse_addresses(_places(v), "a", "c")


_FOLD = "strip_accents(lower({}))"
for _x, _y in X._SPELT.items():
    _FOLD = f"replace({_FOLD}, '{_x}', '{_y}')"
_PARTS = "list_filter(list_transform(string_split(a, ','), lambda c: trim(c)), lambda c: c <> '' AND lower(c) NOT IN ('null', '<null>', 'n/a', 'na', 'none', 'nan', '-'))"
_STATE_VALUES = ", ".join(f"('{k.split('|')[0]}', '{k.split('|', 1)[1]}', '{s}')" for k, s in K.states().items())
_PARSED = f"""
WITH f AS (SELECT *, {_PARTS} AS parts FROM {_PLACES}), m(country, key, state) AS (VALUES {_STATE_VALUES}),
x AS (SELECT id, c, i, trim({_FOLD.format('p')}, ' .') AS key, {_FOLD.format('p')} AS p FROM (SELECT id, c, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM f)),
y AS (SELECT x.*, coalesce(m.state, CASE WHEN length(x.key) > 3 THEN (SELECT max(state) FROM m WHERE m.key = x.key) END) AS state FROM x LEFT JOIN m ON m.country = x.c AND m.key = x.key),
z AS (SELECT *, max(CASE WHEN state IS NOT NULL THEN i ELSE 0 END) OVER (PARTITION BY id) AS pos FROM y),
rest AS (SELECT id, i, regexp_replace(p, '\\b1\\s*/\\s*2\\b', ' ', 'g') AS p FROM z WHERE i <> pos)"""


@query(_PARSED + " SELECT f.id, coalesce((SELECT max(state) FROM z WHERE z.id = f.id AND z.i = z.pos), '') AS state, CAST(len(parts) = 0 AS INT) AS addr_empty, CAST(coalesce((SELECT bool_or(regexp_matches(p, '\\b1\\s*/\\s*2\\b')) FROM z WHERE z.id = f.id AND i <> pos), false) AS INT) AS half FROM f", "records")
def addr_state(v: Views):
    return _addresses(v).select("id", "state", "addr_empty", "half")


@query(_PARSED + r""", h AS (SELECT id, regexp_extract(p, '^[#\s]*([0-9]+)(?:-?([a-z]))?(?:[^a-z0-9]|$)', ['n', 's']) AS e, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM rest WHERE regexp_matches(p, '^[#\s]*([0-9]+)(?:-?([a-z]))?(?:[^a-z0-9]|$)'))
SELECT f.id, coalesce(CASE WHEN h.e.n = '' OR h.e.n IS NULL THEN '' ELSE coalesce(nullif(ltrim(h.e.n, '0'), ''), '0') END, '') AS hn, coalesce(h.e.s, '') AS hn_suf FROM f LEFT JOIN h ON h.id = f.id AND h.k = 1
""", "records")
def addr_house_number(v: Views):
    return _addresses(v).select("id", "hn", "hn_suf")


@query(_PARSED + """, n AS (SELECT DISTINCT id, coalesce(nullif(ltrim(x, '0'), ''), '0') AS x FROM (SELECT id, unnest(regexp_extract_all(p, '[0-9]+')) AS x FROM rest))
SELECT f.id, coalesce((SELECT string_agg(x, ' ' ORDER BY x) FROM n WHERE n.id = f.id), '') AS nums FROM f
""", "records")
def addr_numbers(v: Views):
    return _addresses(v).select("id", F.array_join("nums", " ").alias("nums"))


_ALIASES = ", ".join(f"('{a}', '{b}')" for a, b in K.CITY_ALIASES.items())
_WORDS = ", ".join(f"('{x}', '{c}')" for c, xs in K.ADDRESS_WORDS.items() for x in xs)
_ORDINALS = ", ".join(f"('{w}', '{i + 1}')" for i, w in enumerate(K.ORDINALS))
_DROP = ", ".join(f"'{w}'" for w in K.ADDRESS_DROP)


def _canonical(name: str, rows: str) -> str:
    """Address words in short form, (id, i, j, t), of rows (id, i, p)."""
    return f"""{name}t AS (SELECT id, i, unnest(toks) AS t, unnest(range(1, len(toks) + 1)) AS j FROM (SELECT id, i, regexp_extract_all(p, '[a-z0-9]+') AS toks FROM {rows})),
{name} AS (SELECT * FROM (SELECT id, i, j, CASE WHEN regexp_full_match(t, '[0-9]+(st|nd|rd|th)') THEN regexp_extract(t, '[0-9]+') WHEN o IS NOT NULL THEN o WHEN regexp_full_match(t, '[0-9]+') THEN coalesce(nullif(ltrim(t, '0'), ''), '0')
  WHEN coalesce(w, a, t) IN ({_DROP}) THEN NULL ELSE coalesce(w, a, t) END AS t FROM {name}t LEFT JOIN al ON al.k = t LEFT JOIN wo ON wo.k = coalesce(a, t) LEFT JOIN od ON od.k = t) WHERE t IS NOT NULL)"""


_TABLES = f"al(k, a) AS (VALUES {_ALIASES}), wo(k, w) AS (VALUES {_WORDS}), od(k, o) AS (VALUES {_ORDINALS})"


@query(_PARSED + f""", {_TABLES}, {_canonical('u', 'rest')}
SELECT f.id, coalesce((SELECT string_agg(t, ' ' ORDER BY i, j) FROM u WHERE u.id = f.id), '') AS toks FROM f
""", "records")
def addr_canon_tokens(v: Views):
    return _addresses(v).select("id", F.array_join("addr_toks", " ").alias("toks"))


@query(_PARSED + f""", al(k, a) AS (VALUES {_ALIASES}), c AS (SELECT id, trim(p, ' .') AS p, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS k FROM rest WHERE NOT regexp_matches(p, '[0-9]'))
SELECT f.id, coalesce(al.a, c.p, '') AS city FROM f LEFT JOIN c ON c.id = f.id AND c.k = 1 LEFT JOIN al ON al.k = c.p
""", "records")
def addr_city(v: Views):
    return _addresses(v).select("id", "city")


_HOUSE = r"^[#\s]*([0-9]+)(?:-?([a-z]))?([^a-z0-9]|$)"


@query(_PARSED + f""", {_TABLES},
r AS (SELECT id, i, k, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS j FROM (SELECT id, i, 0 AS k, regexp_extract_all(replace(p, '#', ' '), '[a-z0-9]+(?:[/-][a-z0-9]+)*') AS ts FROM rest)),
n AS (SELECT id, i, j, coalesce(nullif(ltrim(regexp_replace(regexp_replace(t, '[-/]', '', 'g'), '^(?:{"|".join(K.IDENT_LABELS)})([0-9])', '\\1'), '0'), ''), '0') AS t FROM r
  WHERE (regexp_matches(t, '[-/]') OR regexp_full_match(t, '[0-9]+[a-z]{{0,2}}')) AND regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '[0-9]+(st|nd|rd|th)')),
ids AS (SELECT id, string_agg(t, ' ' ORDER BY i, j) AS idents FROM (SELECT id, t, min(i) AS i, min_by(j, i * 100000 + j) AS j FROM n WHERE regexp_matches(t, '[0-9]') GROUP BY id, t) GROUP BY id),
hs AS (SELECT id, i, p FROM rest WHERE regexp_matches(p, '{_HOUSE}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1),
hn AS (SELECT id, coalesce(nullif(ltrim(regexp_extract(p, '{_HOUSE}', 1), '0'), ''), '0') AS hn FROM hs),
hp AS (SELECT id, i, regexp_replace(p, '{_HOUSE}', '\\3') AS p FROM hs), {_canonical('u', 'rest')}, {_canonical('g', 'hp')},
ul AS (SELECT id, i, list(t ORDER BY j) AS ts FROM u GROUP BY id, i), own AS (SELECT id, list(t ORDER BY j) AS ts FROM g GROUP BY id),
typed AS (SELECT id, min_by(ts, i) AS ts FROM ul WHERE ts[-1] IN ({", ".join(f"'{x}'" for x in K.STREET_TYPES)}) GROUP BY id),
ct AS (SELECT id, trim(p, ' .') AS p FROM rest WHERE NOT regexp_matches(p, '[0-9]') QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
e AS (SELECT f.id, coalesce(ids.idents, '') AS idents, coalesce(own.ts, typed.ts, CAST([] AS VARCHAR[])) AS street, coalesce(hn.hn, '') AS hn, coalesce(al.a, ct.p, '') AS city,
    coalesce((SELECT max(state) FROM z WHERE z.id = f.id AND z.i = z.pos), '') AS state
  FROM f LEFT JOIN ids USING (id) LEFT JOIN own USING (id) LEFT JOIN typed USING (id) LEFT JOIN hn USING (id) LEFT JOIN ct USING (id) LEFT JOIN al ON al.k = ct.p)
SELECT id, idents, array_to_string(street, ' ') AS street, CASE WHEN coalesce(nullif(idents, ''), hn) = '' THEN '' ELSE state || '|' || coalesce(nullif(idents, ''), hn) || '|' || coalesce(street[1], '') || '|' || city END AS addr_key FROM e
""", "records")
def addr_idents(v: Views):
    """Identifiers, street words and the identity key."""
    p = _addresses(v)
    return p.select("id", F.array_join("idents", " ").alias("idents"), F.array_join("street", " ").alias("street"), A.address_key(F.col("state"), F.col("idents"), F.col("hn"), F.col("street"), F.col("city")).alias("addr_key"))


@query(f"SELECT id, array_to_string({_PARTS}, '|') AS parts FROM {_PLACES}", "records")
def addr_components(v: Views):
    return _places(v).select("id", F.array_join(A.components(F.col("a")), "|").alias("parts"))


@query("SELECT page_id, regexp_extract(url, '(?:https?://)?(?:www\\.)?([a-z0-9-]+)\\.(?:com|net|org|in|co\\.in|fr|co|biz|us|info)\\b', 1) AS domain FROM pages")
def domain_unpack(v: Views):
    return v.table("pages").select("page_id", F.regexp_extract("url", N.DOMAIN, 1).alias("domain"))


@query()
def name_parse(v: Views):
    """Written names and the records', taken apart."""
    rows = _fixture(v, NAMES, "id long, business_name string").unionByName(v.records().select(F.col("doc_id").alias("id"), "business_name"))
    p = N.parse_names(rows)
    return p.select("id", F.array_join("name_core", " ").alias("core"), F.array_join("legal", " ").alias("legal"), F.array_join("name_alt", " ").alias("alt"), "native", "domain", "concat")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[^0-9]') THEN translate(t, '0135476892', 'olesatgbgz') ELSE t END AS token FROM (SELECT doc_id, lower(source) AS t FROM documents)")
def deleet(v: Views):
    return v.table("documents").select("doc_id", X.deleet(F.lower("source")).alias("token"))


@query("SELECT entity_id, array_to_string(list_transform(name_core, lambda t: replace(replace(t, 'rn', 'm'), 'ln', 'in')), ' ') AS folded FROM records", "records")
def ocr_fold(v: Views):
    return v.records().select("entity_id", F.array_join(F.transform("name_core", X.ocr_fold), " ").alias("folded"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '[a-z0-9]+'), lambda t: t NOT IN ('the', 'de', 'la', 'le', 'les', 'du', 'des', 'et', 'l', 'd', 'dr', 'mr', 'mrs', 'ms')), ' ') AS words FROM documents")
def honorific_drop(v: Views):
    words = F.regexp_extract_all(X.fold_latin(F.col("text")), F.lit("([a-z0-9]+)"))
    return v.table("documents").select("doc_id", F.array_join(F.filter(words, lambda t: ~t.isin(K.HONORIFICS)), " ").alias("words"))


_FORMS = ", ".join(f"('{x}', '{c}')" for c, xs in K.LEGAL_FORMS.items() for x in xs if " " not in x)


@query(f"WITH m(k, f) AS (VALUES {_FORMS}) SELECT n_nationkey AS id, x AS variant, f AS form FROM nation, (SELECT k AS x, f FROM m)")
def legal_canon(v: Views):
    forms = N.legal_forms()
    rows = v.spark.createDataFrame([(k,) for k in forms if "_" not in k], "variant string")
    return v.table("nation").select(F.col("n_nationkey").alias("id")).crossJoin(F.broadcast(rows)).withColumn("form", X.lookup(forms, F.col("variant")))


FUZZY = ["provate", "limted", "lncorporated", "corparation", "private", "limit", "limits", "privet", "incorporatd", "limitid", "corporatoin", "corporations", "incoporatde", "pravite", "unlimited", "12345678", "prvt"]


@query("""
WITH t(token) AS (VALUES {}), w(i, w, f) AS (VALUES (1, 'private', 'pvt'), (2, 'limited', 'ltd'), (3, 'corporation', 'corp'), (4, 'incorporated', 'inc')),
x AS (SELECT token, f, i, levenshtein(token, w) AS d FROM t, w WHERE abs(length(token) - length(w)) <= 3 AND length(token) >= 6 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({})
  AND (levenshtein(token, w) <= 1 OR levenshtein(token, w) = 2 AND length(token) >= 7 OR levenshtein(token, w) = 3 AND length(token) >= 9 AND jaro_winkler_similarity(token, w) >= 0.8))
SELECT t.token, coalesce((SELECT arg_min(f, i) FROM x WHERE x.token = t.token), '') AS form FROM t
""".format(", ".join(f"('{t}')" for t in FUZZY), ", ".join(f"'{t}'" for t in K.NOT_LEGAL)))
def fuzzy_legal(v: Views):
    rows = v.spark.createDataFrame([(t,) for t in FUZZY], "token string")
    return rows.select("token", F.coalesce(N.fuzzy_legal(F.col("token")), F.lit("")).alias("form"))


_SKELETON = "lower(token)"
for _x, _y in [*K.SOUNDS, ("ce", "se"), ("ci", "si"), ("cy", "sy"), ("c", "k")]:
    _SKELETON = f"replace({_SKELETON}, '{_x}', '{_y}')"
_SKELETON = f"regexp_replace({_SKELETON}, '[^a-z]|[aeiouy]', '', 'g')"
for _x in "bcdfghjklmnpqrstvwxz":
    _SKELETON = f"regexp_replace({_SKELETON}, '{_x}+', '{_x}', 'g')"


@query(f"SELECT DISTINCT token, {_SKELETON} AS skeleton FROM (SELECT unnest(name_core) AS token FROM records)", "records")
def skeleton(v: Views):
    return v.records().select(F.explode("name_core").alias("token")).distinct().withColumn("skeleton", X.skeleton(F.col("token")))


NATIVE = ["राम ज्वेलर्स", "శ్రీ ట్రేడర్స్", "ગુજરાત મિલ", "தமிழ் கடை", "দিল্লি ফুড"]


@query()
def translit_learn(v: Views):
    """Learned from pairs, extended by sound, and what of a held-out list the table covers."""
    pairs = v.spark.createDataFrame([("राम ट्रेडर्स", "Ram Traders"), ("राम फूड", "Ram Foods"), ("श्याम ट्रेडर्स", "Shyam Traders"), ("राम मिल", "Raam Mill")], "a string, b string")
    names = v.spark.createDataFrame([(n,) for n in NATIVE] + [("Ram Jewellers",)] * 25 + [("Gujarat Food Mill",)] * 30, "name string")
    return translit.extend(translit.learn(pairs), names)


@query()
def translit_coverage(v: Views):
    table = translit_learn(v)
    words = v.spark.createDataFrame([(n,) for n in NATIVE], "name string").select(F.explode(F.split("name", " ")).alias("token"))
    return P.coverage(words, table)


@query()
def fold_native(v: Views):
    rows = _fixture(v, [*NATIVE, "Société Œuvre", "Ｆｕｌｌ width"], "id long, name string").unionByName(v.records().select(F.col("doc_id").alias("id"), F.col("business_name").alias("name")))
    return rows.select("id", X.fold(F.col("name")).alias("folded"), X.is_native(F.col("name")).alias("native"))


# Sampling

@query()
def training_slice(v: Views):
    return S.training_slice(v.records().select("entity_id", "src", "country", "state", "addr_empty"), v.record_truth(), 0.3)


@query(f"""
WITH x AS (SELECT * FROM {"(SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS addr_empty) FROM records)"}), g AS (SELECT country, state, count(*) AS n FROM x WHERE src = 1 GROUP BY ALL),
h AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY country) * 0.3 AS goal, count(*) OVER (PARTITION BY country) AS states FROM g) WHERE NOT (states > 3 AND n > 0.5 * goal)),
c AS (SELECT country, state FROM (SELECT *, sum(n) OVER (PARTITION BY country ORDER BY md5(concat_ws(':', 0, country, state)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM h) WHERE before < goal),
m AS (SELECT entity_id FROM x JOIN c USING (country, state) WHERE src = 1),
a AS (SELECT x.entity_id, CASE WHEN x.entity_id IN (SELECT entity_id FROM m) THEN 's1' WHEN x.entity_id IN (SELECT other FROM record_truth WHERE s1 IN (SELECT entity_id FROM m)) THEN 'match'
    WHEN src > 1 AND x.entity_id NOT IN (SELECT other FROM record_truth) AND c.state IS NOT NULL AND addr_empty = 0 THEN 'state' WHEN src > 1 AND x.entity_id NOT IN (SELECT other FROM record_truth) AND addr_empty = 1 THEN 'empty' END AS arm
  FROM x LEFT JOIN c USING (country, state))
SELECT entity_id, arm FROM a WHERE arm IS NOT NULL
""", "records", "record_truth")
def training_slice_arms(v: Views):
    """The slice with all its distractors, so that the rows don't hang on a hash."""
    return S.training_slice(_maybe_empty(v).select("entity_id", "src", "country", "state", "addr_empty"), v.record_truth(), 0.3, 1.0, 1.0).select("entity_id", "arm")


@query("""
WITH m AS (SELECT entity_id FROM records WHERE src = 1 AND state IN ('src1', 'src2')), own AS (SELECT other FROM record_truth WHERE s1 IN (SELECT entity_id FROM m))
SELECT entity_id FROM m UNION ALL SELECT entity_id FROM records WHERE src > 1 AND entity_id IN (SELECT other FROM own)
UNION ALL SELECT entity_id FROM records WHERE src > 1 AND state IN ('src1', 'src2') AND entity_id NOT IN (SELECT other FROM record_truth)
""", "records", "record_truth")
def regional_slice(v: Views):
    return S.regional_slice(v.records(), v.record_truth(), ["src1", "src2"]).select("entity_id")


_MAYBE_EMPTY = "(SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS addr_empty) FROM records)"


def _maybe_empty(v: Views) -> DataFrame:
    return v.records().withColumn("addr_empty", (F.col("doc_id") % 6 == 0).cast("int"))


@query(f"""
WITH x AS (SELECT * FROM {_MAYBE_EMPTY}), m AS (SELECT entity_id FROM x WHERE src = 1 AND state IN ('src1', 'src2')), own AS (SELECT other FROM record_truth WHERE s1 IN (SELECT entity_id FROM m))
SELECT entity_id FROM m UNION ALL SELECT entity_id FROM x WHERE src > 1 AND entity_id IN (SELECT other FROM own)
UNION ALL SELECT entity_id FROM x WHERE src > 1 AND (addr_empty = 1 OR state IN ('src1', 'src2')) AND entity_id NOT IN (SELECT other FROM record_truth)
""", "records", "record_truth")
def evaluation_slice(v: Views):
    """All unmatched records without an address stay, so that the rows don't hang on a hash."""
    return S.evaluation_slice(_maybe_empty(v), v.record_truth(), ["src1", "src2"], 1.0)[0].select("entity_id")


@query(f"SELECT entity_id FROM {_MAYBE_EMPTY} WHERE addr_empty = 0 AND state IN ('src1', 'src2')", "records")
def slice_by_states(v: Views):
    return S.slice_by_states(_maybe_empty(v), ["src1", "src2"]).select("entity_id")


_PLANNED = _PLAN.format(reach="", own="q").strip().removeprefix("WITH ")


@query(f"""
WITH {_PLANNED.partition("SELECT 's' AS side")[0].rstrip()}, mem AS (SELECT 's' AS side{_PLANNED.partition("SELECT 's' AS side")[2]}),
st AS (SELECT part, entity_id AS id, unnest({_NAME}) AS term FROM mem JOIN s_side ON entity_id = id WHERE side = 's'), sp AS (SELECT part, id, term, 1 + ln(count(*)) AS tf FROM st GROUP BY ALL),
sz AS (SELECT part, count(*) AS n FROM mem WHERE side = 's' GROUP BY 1), dfs AS (SELECT part, term, count(*) AS df FROM sp GROUP BY ALL),
idf AS (SELECT part, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs JOIN sz USING (part) WHERE n <= 2000 OR df <= 0.05 * n),
sr AS (SELECT part, id, term, tf * idf AS w FROM sp JOIN idf USING (part, term)), sw AS (SELECT part, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS w FROM sr),
qt AS (SELECT part, entity_id AS id, unnest({_NAME}) AS term FROM mem JOIN q_side ON entity_id = id WHERE side = 'q'), qp AS (SELECT part, id, term, 1 + ln(count(*)) AS tf FROM qt GROUP BY ALL),
qr AS (SELECT part, id, term, tf * idf AS w FROM qp JOIN idf USING (part, term)), qw AS (SELECT part, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS w FROM qr),
pairs AS (SELECT part, q.id AS q, s.id AS s1, round(sum(s.w * q.w), 9) AS score FROM sw s JOIN qw q USING (part, term) GROUP BY ALL)
SELECT part, q, s1, score FROM (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, s1) AS n FROM pairs WHERE score > 1e-6) WHERE n <= CASE WHEN suffix(part, '|-') THEN 4 WHEN suffix(part, '|s1') THEN 3 ELSE 2 END
""", "s_side", "q_side")
def planned_topk(v: Views):
    """The search over the parts of the plan: a state's own masters, all of a country for records without a known state, and masters
    without a state, each with its own k."""
    s, q = v.sides()
    s = s.withColumn("state", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("state")))
    q = q.withColumn("state", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("state")))
    return B.top_names(*v.name_docs(), *B.partition_plan(s, q, None, 2, 4, 3))


@query()
def synthetic_siblings(v: Views):
    r = v.records().withColumn("business_address", F.concat(F.col("hn"), F.lit(" "), F.col("business_address"))).select("entity_id", "business_name", "business_address", "country", "src")
    words = v.records().select("country", F.explode("name_core").alias("w")).where(F.length("w") >= 4).groupBy("country").agg(F.slice(F.array_sort(F.collect_set("w")), 1, 50).alias("words"))
    return S.synthetic_siblings(r, v.record_truth(), words, 0.5, 0.5)


@query()
def pseudo_labels(v: Views):
    ids = v.table("orders").select(F.col("o_orderkey").alias("entity_id"))
    return S.pseudo_labels(v.scores(), ids, 0.5)


# Reports over records

@query("""
SELECT s_state, q_state, count(*) AS n, CASE WHEN s_state = q_state THEN 'same' ELSE 'other' END AS kind FROM (SELECT s.state AS s_state, q.state AS q_state FROM record_truth t JOIN records s ON s.entity_id = t.s1 JOIN records q ON q.entity_id = t.other) GROUP BY ALL
""", "records", "record_truth")
def state_shift_matrix(v: Views):
    return P.state_shift(v.record_truth(), v.records())


@query("""
WITH a AS (SELECT token, count(*) AS c FROM (SELECT unnest(list_distinct(name_core)) AS token FROM s_side) GROUP BY 1), b AS (SELECT token, count(*) AS c FROM (SELECT unnest(list_distinct(name_core)) AS token FROM q_side) GROUP BY 1),
x AS (SELECT token, coalesce(a.c, 0) * 10000.0 / (SELECT count(*) FROM s_side) AS ra, b.c * 10000.0 / (SELECT count(*) FROM q_side) AS rb FROM b LEFT JOIN a USING (token) WHERE b.c >= 5)
SELECT token, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(rb / greatest(ra, 0.1), 6) AS ratio FROM x
""", "s_side", "q_side")
def df_ratio_ranking(v: Views):
    return _round(P.frequency_ratios(*v.sides(), 5), "rate_a", "rate_b", "ratio")


@query("""
WITH b AS (SELECT country, CAST(sum((src = 1)::INT) AS BIGINT) AS masters, CAST(sum((src > 1)::INT) AS BIGINT) AS records FROM records GROUP BY 1), k AS (SELECT DISTINCT q.entity_id AS q, q.country FROM twos t JOIN records q ON q.entity_id = t.q),
t AS (SELECT DISTINCT other, country FROM record_truth JOIN records ON entity_id = other)
SELECT country, masters, records, (SELECT count(*) FROM k WHERE k.country = b.country) AS assigned, (SELECT count(*) FROM t WHERE t.country = b.country) AS true_records, round((SELECT count(*) FROM t WHERE t.country = b.country) / masters, 6) AS per_s1 FROM b
""", "records", "record_truth", "twos")
def record_budget(v: Views):
    return _round(P.record_budget(v.records(), v.record_pairs(), v.record_truth()), "per_s1")


@query("""
WITH f AS (SELECT country, name FROM records WHERE src > 1 AND entity_id NOT IN (SELECT q FROM twos)), n AS (SELECT DISTINCT country, name FROM records WHERE src = 1 AND name <> '')
SELECT f.country, count(*) AS unscored, CAST(sum((n.name IS NOT NULL)::INT) AS BIGINT) AS with_namesake FROM f LEFT JOIN n USING (country, name) GROUP BY 1
""", "records", "twos")
def unscored_by_name(v: Views):
    return P.unscored(v.records(), v.record_pairs())


@query("""
WITH w AS (SELECT country, token FROM (SELECT country, token, count(*) AS c FROM (SELECT country, unnest(list_distinct(name_core)) AS token FROM q_side) GROUP BY ALL) WHERE c >= 3),
k AS (SELECT s1, q, country, s_name_core AS a, q_name_core AS b FROM twos), x AS (SELECT DISTINCT s1, q, country FROM (SELECT s1, q, country, unnest(list_filter(b, lambda t: NOT list_contains(a, t))) AS token FROM k) JOIN w USING (country, token)),
p AS (SELECT s.country, count(k.q) AS n FROM s_side s LEFT JOIN k ON k.s1 = s.entity_id GROUP BY s.country, s.entity_id)
SELECT country, round(avg(n), 6) AS matches_per_s1, round(avg((n = 0)::INT), 6) AS singletons, round(coalesce((SELECT count(*) FROM x WHERE x.country = p.country) / nullif((SELECT count(*) FROM k WHERE k.country = p.country), 0), 0), 6) AS modifier_share FROM p GROUP BY country
""", "s_side", "q_side", "twos")
def proxy_report(v: Views):
    s, q = v.sides()
    words = R.document_frequency(q, "name_core", ["country"]).where("df >= 3").select("country", "token")
    return _round(P.proxy_report(s.select(F.col("entity_id").alias("s1"), "country"), v.record_pairs(), words, v.records().select("entity_id", "name_core")), "matches_per_s1", "singletons", "modifier_share")


@query("""
SELECT vec_id, other, score FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS n
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE n <= 5
""")
def dense_topk(v: Views):
    """Exact top-5 by cosine of the stated queries (ids divisible by 20) against all rows, as matrix products of blocks with a local
    top 5 each."""
    return B.dense_nearest(v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e")), F.col("id") % 20 == 0, 5).select(F.col("q").alias("vec_id"), "other", "score")
