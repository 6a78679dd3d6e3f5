"""Stand-in views over the driver's tables, as DataFrames and, for the oracle, as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators.blocking import trigrams

RUNS = {1: (37, 11, None), 2: (53, 29, 3), 3: (71, 17, 4)}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def masters(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("s1"), F.col("c_mktsegment").alias("country"))

    def scores(self, run: int = 1) -> DataFrame:
        """Each order with its customer and with the next one; run 2 and 3 leave pairs out."""
        a, b, skip = RUNS[run]
        n = self.table("customer").count()
        orders = self.table("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("q"))
        pairs = orders.select(F.explode(F.array(F.col("c"), (F.col("c") + 1) % n)).alias("s1"), "q")
        pairs = pairs.where((F.col("s1") + F.col("q")) % skip != 0) if skip else pairs
        p = ((F.col("q") * a + F.col("s1") * b) % 1000).cast("double") / 1000
        return pairs.withColumn("p", p).join(self.masters(), "s1").select("s1", "q", "p", "country")

    def truth(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("other"))

    def labelled(self, run: int = 1) -> DataFrame:
        from kinlink.operators.relational import label_pairs

        return label_pairs(self.scores(run), self.truth())

    def records(self) -> DataFrame:
        """Documents as records: four words of name, ten of address."""
        # Only the 14 words that are used are put in lower case and split: a limited split still scans all of a text, at each use of a column.
        head = F.regexp_extract("text", "^[ \t\r\n]*+(?:[^ \t\r\n]++[ \t\r\n]*+){0,14}+", 0)
        w = F.filter(F.split(F.lower(head), "[ \t\r\n]+"), lambda x: x != "")
        d = self.table("documents").withColumn("w", w)
        k = F.col("doc_id") % 3 + 1
        tokens = lambda c: F.regexp_extract_all(F.col(c), F.lit("([a-z0-9]+)"))
        text = lambda x: x.cast("string")
        out = d.select(
            "doc_id", F.concat(F.lit("S"), text(k), F.lit("-"), text(F.col("doc_id"))).alias("entity_id"), k.cast("int").alias("src"), F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
            F.array_join(F.slice("w", 5, 10), ", ").alias("business_address"), F.col("lang").alias("country"), F.col("source").alias("state"), F.md5(F.col("text").cast("binary")).alias("key"),
        )
        out = out.withColumn("name_core", tokens("business_name")).withColumn("addr_toks", tokens("business_address")).withColumn("hn", text(F.col("doc_id") % 50))
        return out.withColumns(
            {
                "nums": F.array_sort(F.array_distinct(F.array(text(F.col("doc_id") % 50), text(F.col("doc_id") % 7)))),
                "street": F.slice("addr_toks", 1, 2), "city": F.coalesce(F.try_element_at("addr_toks", F.lit(-1)), F.lit("")), "hn_suf": F.when(F.col("doc_id") % 5 == 0, "a").otherwise(""),
                "legal": F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("llc"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("inc"), F.lit("ltd"))).otherwise(F.array().cast("array<string>")),
                "idents": F.array_distinct(F.array(F.concat(F.col("hn"), F.lit("a")), text(F.col("doc_id") % 11))), "name_alt": F.slice("name_core", 2, 1), "domain": F.lit(0), "native": F.lit(0),
                "addr_empty": (F.size("addr_toks") == 0).cast("int"), "concat": F.array_join("name_core", ""), "name": F.array_join(F.array_sort("name_core"), " "),
            }
        )

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Masters (the first of equal texts) and queries."""
        r = self.records()
        first = r.where("src = 1").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        return r.join(first.select("doc_id"), "doc_id", "left_semi"), r.where("src > 1")

    def record_truth(self) -> DataFrame:
        s, q = self.sides()
        return s.select("key", F.col("entity_id").alias("s1")).join(q.select("key", F.col("entity_id").alias("other")), "key").select("s1", "other")

    def record_pairs(self) -> DataFrame:
        """Pairs of the same country and number class that share the first name token."""
        return self.record_twos([]).select("s1", "q")

    def record_twos(self, columns: list[str], made: dict | None = None) -> DataFrame:
        """record_pairs with both sides' columns as s_* and q_*, which come along in the join, and what deals the pairs. `made`
        are further columns, computed once a record."""
        from kinlink.operators.relational import first_token_pairs

        s, q = (x.withColumns(made or {}) for x in self.sides())
        return first_token_pairs(s, q, "name_core", 0.14, [*columns, *(made or {})]).drop("s1_t", "q_t")

    def members(self, by: str = "country") -> tuple[DataFrame, DataFrame]:
        s, q = self.sides()
        return s.select(F.col(by).alias("part"), F.col("entity_id").alias("id")), q.select(F.col(by).alias("part"), F.col("entity_id").alias("id"), F.lit(10).alias("k"))

    def name_docs(self) -> tuple[DataFrame, DataFrame]:
        s, q = self.sides()
        terms = trigrams(F.array_join("name_core", " ")).alias("terms")
        return s.select("entity_id", terms), q.select("entity_id", terms)


def scores_sql(run: int = 1) -> str:
    a, b, skip = RUNS[run]
    where = f"WHERE (s1 + q) % {skip} <> 0" if skip else ""
    return f"""(SELECT s1, q, CAST((q * {a} + s1 * {b}) % 1000 AS DOUBLE) / 1000 AS p, c_mktsegment AS country
  FROM (SELECT o_custkey AS s1, o_orderkey AS q FROM orders UNION ALL SELECT (o_custkey + 1) % (SELECT count(*) FROM customer), o_orderkey FROM orders) JOIN customer ON c_custkey = s1 {where})"""


TRUTH = "(SELECT o_custkey AS s1, o_orderkey AS other FROM orders WHERE o_orderstatus = 'F')"
MASTERS = "(SELECT c_custkey AS s1, c_mktsegment AS country FROM customer)"
RECORDS = r"""(SELECT *, list_sort(list_distinct([CAST(doc_id % 50 AS VARCHAR), CAST(doc_id % 7 AS VARCHAR)])) AS nums, addr_toks[1:2] AS street, coalesce(addr_toks[-1], '') AS city,
  CASE WHEN doc_id % 5 = 0 THEN 'a' ELSE '' END AS hn_suf, CASE doc_id % 4 WHEN 0 THEN ['llc'] WHEN 1 THEN ['inc', 'ltd'] ELSE CAST([] AS VARCHAR[]) END AS legal,
  array_to_string(list_sort(name_core), ' ') AS name, CASE WHEN len(addr_toks) = 0 THEN 1 ELSE 0 END AS addr_empty,
  CASE WHEN CAST(doc_id % 50 AS VARCHAR) || 'a' = CAST(doc_id % 11 AS VARCHAR) THEN [CAST(doc_id % 11 AS VARCHAR)] ELSE [CAST(doc_id % 50 AS VARCHAR) || 'a', CAST(doc_id % 11 AS VARCHAR)] END AS idents
  FROM (SELECT *, regexp_extract_all(business_name, '[a-z0-9]+') AS name_core, regexp_extract_all(business_address, '[a-z0-9]+') AS addr_toks, CAST(doc_id % 50 AS VARCHAR) AS hn
    FROM (SELECT doc_id, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 1 + doc_id % 3 AS src, array_to_string(w[1:4], ' ') AS business_name, array_to_string(w[5:14], ', ') AS business_address,
        lang AS country, source AS state, md5(text) AS key
      FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents))))"""

#: Common table expressions that a query may name.
NAMED = {
    "scores": scores_sql(1), "scores2": scores_sql(2), "scores3": scores_sql(3), "truth": TRUTH, "masters": MASTERS, "records": RECORDS,
    "labelled": "(SELECT s.s1, s.q, s.p, s.country, CAST(t.s1 IS NOT NULL AS INT) AS y FROM scores s LEFT JOIN truth t ON t.s1 = s.s1 AND t.other = s.q)",
    "best": "(SELECT s1, q, p, country FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s1) AS n FROM scores) WHERE n = 1)",
    "s_side": "(SELECT * FROM records WHERE src = 1 AND doc_id IN (SELECT min(doc_id) FROM records WHERE src = 1 GROUP BY key))",
    "q_side": "(SELECT * FROM records WHERE src > 1)",
    "record_truth": "(SELECT s.entity_id AS s1, q.entity_id AS other FROM s_side s JOIN q_side q USING (key))",
    "twos": """(SELECT s.entity_id AS s1, q.entity_id AS q, s.country, s.name_core AS s_name_core, q.name_core AS q_name_core, s.addr_toks AS s_addr_toks, q.addr_toks AS q_addr_toks, s.nums AS s_nums, q.nums AS q_nums,
  s.hn AS s_hn, q.hn AS q_hn, s.hn_suf AS s_hn_suf, q.hn_suf AS q_hn_suf, s.legal AS s_legal, q.legal AS q_legal, s.state AS s_state, q.state AS q_state, s.idents AS s_idents, q.idents AS q_idents, s.street AS s_street, q.street AS q_street, q.addr_empty AS q_addr_empty
  FROM s_side s JOIN q_side q ON s.country = q.country AND s.name_core[1] = q.name_core[1]
  WHERE len(list_intersect(s.name_core, q.name_core)) / len(list_distinct(list_concat(s.name_core, q.name_core))) >= 0.14)""",
}
_NEEDS = {"labelled": ["scores", "truth"], "best": ["scores"], "s_side": ["records"], "q_side": ["records"], "record_truth": ["records", "s_side", "q_side"], "twos": ["records", "s_side", "q_side"]}


def sql(body: str, *names: str) -> str:
    """body after the named views it uses."""
    wanted: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, []), n):
            if x not in wanted:
                wanted.append(x)
    head = ",\n".join(f"{n} AS MATERIALIZED {NAMED[n]}" for n in wanted)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
