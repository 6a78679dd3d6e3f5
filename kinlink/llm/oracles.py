"""DuckDB SQL for the results that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

OP6 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
hits AS (
  SELECT x.r, x.s, x.k, i.item
  FROM (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)) x JOIN items i ON x.k = i.k AND x.g = i.g),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)
"""

OP9 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, r, i, a[i] AS line, len(regexp_extract_all(a[i], '[^\x20\x09-\x0D]+')) AS k FROM (SELECT doc_id, r, a, unnest(range(1, len(a) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, r, i, line, k, k > 0 AS f, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS p FROM l),
w AS (SELECT doc_id, r, p, line, lead(line) OVER (PARTITION BY r ORDER BY p) AS after FROM n WHERE f),
m AS (SELECT r, p, 2 AS size, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY line, after) AS later FROM w WHERE after IS NOT NULL
  UNION ALL SELECT r, p, 1, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY line) FROM n WHERE k >= 5),
gone AS (SELECT DISTINCT r, unnest(range(p, p + size)) AS p FROM m WHERE later)
SELECT d.doc_id, CAST(coalesce(x.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (
  SELECT n.r, sum(f::INT) AS n_lines, sum((f AND g.p IS NOT NULL)::INT) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (f AND g.p IS NOT NULL)), '') AS kept
  FROM n LEFT JOIN gone g ON n.r = g.r AND n.p = g.p GROUP BY n.r) x USING (r)
"""


def _fill(name: str, nodes: str, parent: str) -> str:
    """Water-filling of one level as three common table expressions; the last is called `name`."""
    by = f"PARTITION BY {parent}" if parent else ""
    key = name.split("_")[1]
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow FROM ({nodes})),
{name}_b AS (SELECT *, cap::DOUBLE * ow <= w::DOUBLE * rest AS short FROM {name}_a),
{name}_c AS (SELECT *, budget - sum(CASE WHEN short THEN cap ELSE 0 END) OVER ({by}) AS rem, sum(CASE WHEN short THEN 0 ELSE w END) OVER ({by}) AS sw FROM {name}_b),
{name} AS (SELECT {parent + ", " if parent else ""}{key}, CASE WHEN short THEN cap ELSE least(cap, (w * rem) // greatest(sw, 1)) END::BIGINT AS share FROM {name}_c)"""


OP7 = (
    r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, CASE CAST(coalesce(nullif(regexp_extract(source, '[0-9]+$'), ''), '0') AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS MATERIALIZED (
  SELECT domain, lang, source, tokens, tokens * 2 AS cap,
    CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END::BIGINT AS wd,
    CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END::BIGINT AS wl,
    (1 + CAST(coalesce(nullif(regexp_extract(source, '[0-9]+$'), ''), '0') AS INT) % 4)::BIGINT AS ws
  FROM (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL) WHERE tokens > 0),"""
    + _fill("f_domain", "SELECT domain, max(wd) AS w, sum(cap) AS cap, least((sum(sum(cap)) OVER ()) , (sum(sum(cap)) OVER ()) * 3 // 10) AS budget FROM leaves GROUP BY domain", "")
    + ","
    + _fill("f_lang", "SELECT domain, lang, max(wl) AS w, sum(cap) AS cap, max(share) AS budget FROM leaves JOIN f_domain USING (domain) GROUP BY domain, lang", "domain")
    + ","
    + _fill("f_source", "SELECT domain, lang, source, max(ws) AS w, sum(cap) AS cap, max(share) AS budget FROM leaves JOIN f_lang USING (domain, lang) GROUP BY domain, lang, source", "domain, lang")
    + r""",
plan AS (SELECT domain, lang, source, share // tokens::BIGINT AS whole, share % tokens::BIGINT AS part FROM leaves JOIN f_source USING (domain, lang, source)),
ranked AS (
  SELECT doc_id, domain, lang, source, n_tokens, whole, part,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN upto <= part THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM ranked WHERE whole + CASE WHEN upto <= part THEN 1 ELSE 0 END > 0
"""
)

OP10 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, r, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
later AS (SELECT r, s FROM (SELECT r, s, doc_id > min(doc_id) OVER (PARTITION BY g) AS late FROM x) WHERE late),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(s, s + 13)) AS i FROM later),
kept AS (
  SELECT u.r, string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE g.i IS NULL) AS k, count(g.i) AS n
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) u LEFT JOIN gone g ON u.r = g.r AND u.i = g.i GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP3 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(len(w), 3) AS k, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM pairs p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * common >= 85 * (a.n + b.n - common)),
two AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, x FROM two UNION SELECT r.doc_id, t.y FROM reach r JOIN two t ON t.x = r.other),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(l.c, d.doc_id) AS BIGINT) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (SELECT x, x FROM links UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(l.c, v.vec_id) AS BIGINT) AS component_id, coalesce(l.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least l USING (vec_id)
"""

SQL = {"op3_near_dedup": OP3, "op8_vector_dedup": OP8, "op10_substring_dedup": OP10, "op6_decontamination": OP6, "op7_mixing": OP7, "op9_line_dedup": OP9}
