"""Queries on what a workbook holds besides cells, on the driver's tables as if they listed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import parts
from tallyloom.plans.cycles import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(*xs) -> Column:
    return F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])


@query("""
WITH s AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS sheet, list_extract(['visible', 'hidden', 'veryHidden'], CAST(p_size % 3 AS INT) + 1) AS before, list_extract(['visible', 'hidden', 'veryHidden'], CAST(floor(p_retailprice) AS BIGINT) % 3 + 1) AS after FROM part)
SELECT * FROM s WHERE before <> after
""")
def sheet_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that were hidden or shown between the cycles."""
    p, states = table(spark, sf_dir, "part"), F.array(*map(F.lit, ("visible", "hidden", "veryHidden")))
    state = lambda x: F.get(states, (x % 3).cast("int")).alias("state")
    sheet = text("P", F.col("p_partkey")).alias("sheet")
    return parts.visibility(p.select(sheet, state(F.col("p_size"))), p.select(sheet, state(F.floor("p_retailprice"))))


@query("""
WITH b AS (SELECT CASE WHEN s_nationkey % 5 > 0 THEN 'S' || CAST(s_nationkey AS VARCHAR) END AS scope, 'N' || CAST(s_suppkey AS VARCHAR) AS name, 1 AS top, 10 + s_suppkey % 7 AS bottom FROM supplier),
c AS (SELECT CASE WHEN s_nationkey % 5 > 0 THEN 'S' || CAST(s_nationkey AS VARCHAR) END AS scope, CASE WHEN s_suppkey % 10 = 3 THEN 'M' ELSE 'N' END || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 9 = 0 THEN 2 ELSE 1 END AS top, 10 + s_suppkey % 7 + s_suppkey % 2 AS bottom FROM supplier),
j AS (SELECT coalesce(b.scope, c.scope) AS scope, coalesce(b.name, c.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'removed' WHEN b.top <> c.top OR b.bottom <> c.bottom THEN 'changed' END AS event, b.top = c.top AND c.bottom > b.bottom AS longer FROM b FULL JOIN c ON b.scope IS NOT DISTINCT FROM c.scope AND b.name = c.name)
SELECT scope, name, 'named_range_' || event AS finding_class, CASE WHEN event = 'changed' AND longer THEN 'range_extension' END AS expected_reason FROM j WHERE event IS NOT NULL
""")
def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined names of workbook and sheets that came, went or point elsewhere; a range that only grew is expected."""
    s = table(spark, sf_dir, "supplier")
    scope, k = F.when(F.col("s_nationkey") % 5 > 0, text("S", F.col("s_nationkey"))).alias("scope"), F.col("s_suppkey")
    ref = lambda top, bottom: text("'Data sheet'!$A$", top, ":$C$", bottom).alias("ref")
    base = s.select(scope, text("N", k).alias("name"), ref(F.lit(1), 10 + k % 7))
    now = s.select(scope, F.concat(F.when(k % 10 == 3, "M").otherwise("N"), k.cast("string")).alias("name"), ref(F.when(k % 9 == 0, 2).otherwise(1), 10 + k % 7 + k % 2))
    return parts.names(base, now)


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 11 <> 0)
SELECT CAST(k AS BIGINT) AS base_id, CAST(k AS BIGINT) AS current_id, finding, CASE WHEN finding = 'table_range_changed' AND k % 6 = 1 THEN 'period_progression' END AS expected_reason
FROM p, LATERAL (SELECT unnest([CASE WHEN k % 5 = 0 THEN 'table_renamed' END, CASE WHEN k % 3 > 0 THEN 'table_range_changed' END, CASE WHEN k % 4 = 1 THEN 'table_columns_reordered' END, CASE WHEN k % 4 = 2 THEN 'table_columns_changed' END, CASE WHEN k % 7 = 0 THEN 'table_settings_changed' END]) AS finding) f WHERE finding IS NOT NULL
UNION ALL SELECT p_partkey, NULL, 'table_removed', NULL FROM part WHERE p_partkey % 11 = 0
UNION ALL SELECT NULL, 10000000 + p_partkey, 'table_added', NULL FROM part WHERE p_partkey % 11 = 0
""")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native tables matched by name, source and place, and how they changed."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    cols = lambda *xs: F.array(*map(F.lit, xs))
    base = p.select(k.alias("id"), text("Table", k).alias("name"), k.alias("source_id"), F.lit("Data").alias("sheet"), text("A1:C", 10 + k).alias("ref"), cols("a", "b", "c").alias("columns"), F.lit("headers").alias("settings"))
    new = k % 11 == 0
    columns = F.when(k % 4 == 1, cols("b", "a", "c")).when(k % 4 == 2, cols("a", "b", "c", "d")).otherwise(cols("a", "b", "c"))
    now = p.select(
        F.when(new, 10_000_000 + k).otherwise(k).alias("id"), F.when(new, text("New", k)).when(k % 5 == 0, text("Renamed", k)).otherwise(text("TABLE", k)).alias("name"), F.when(new, -1 - k).otherwise(k).alias("source_id"), F.lit("Data").alias("sheet"),
        F.when(new, text("Z1:Z", k)).otherwise(text("A1:C", 10 + k + k % 3)).alias("ref"), columns.alias("columns"), F.when(k % 7 == 0, "totals").otherwise("headers").alias("settings"),
    )
    return parts.tables(base, now, p.where(k % 6 == 1).select(k.alias("id"), F.lit("period_progression").alias("reason")))


@query("""
WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS d, l_linenumber > 3 AS grown FROM lineitem), g AS (SELECT id, max(d) FILTER (NOT grown) AS latest, min(d) FILTER (grown) AS first FROM c GROUP BY 1)
SELECT id, 'period_progression' AS reason FROM g WHERE first > latest
""")
def table_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose new rows prove a later period."""
    from tallyloom.functions import periods

    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_orderkey").alias("id"), F.lit(1).alias("col"), periods.date_period(F.col("l_shipdate")).alias("period"), F.lit(None).cast("string").alias("formula"), (F.col("l_linenumber") > 3).alias("grown"))
    return parts.extension_proof(c, li.select(F.col("l_orderkey").alias("id")).distinct())


@query("""
WITH b AS (SELECT 'comment' AS kind, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS content FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT 'query', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier),
c AS (SELECT 'comment' AS kind, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderpriority END AS content FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT 'query', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey % 20 AS VARCHAR) FROM supplier)
SELECT kind, key, CASE WHEN b.content IS NULL THEN 'added' WHEN c.content IS NULL THEN 'removed' ELSE 'changed' END AS event, CASE kind WHEN 'comment' THEN 'cell_comment_changed' ELSE 'power_query_changed' END AS finding_class FROM b FULL JOIN c USING (kind, key) WHERE b.content IS DISTINCT FROM c.content
""")
def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and queries that came, went or changed."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    row = lambda df, kind, key, content: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), content.cast("string").alias("content"))
    b = row(o.where("o_orderkey % 13 <> 0"), "comment", "o_orderkey", F.col("o_orderpriority")).unionByName(row(s, "query", "s_suppkey", F.col("s_nationkey")))
    c = row(o.where("o_orderkey % 17 <> 0"), "comment", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderpriority"))).unionByName(row(s, "query", "s_suppkey", F.col("s_nationkey") % 20))
    return parts.metadata(b, c)


RISK_KINDS = ("external_link", "external_name", "macro", "ole_link", "activex")


@query("""
WITH c AS (SELECT list_extract(['external_link', 'external_name', 'macro', 'ole_link', 'activex'], CAST(c_nationkey % 5 AS INT) + 1) AS kind, c_custkey AS item FROM customer), r AS (SELECT DISTINCT o_custkey AS item FROM orders WHERE o_totalprice > 100000),
n AS (SELECT kind, count(*) AS count, count(r.item) AS live FROM c LEFT JOIN r USING (item) GROUP BY 1)
SELECT kind, CASE WHEN kind IN ('external_link', 'external_name', 'ole_link') THEN 'external_link' ELSE 'active_content' END AS finding_class, count, CASE WHEN kind IN ('external_link', 'macro', 'activex') THEN 'inherited' ELSE 'new' END AS provenance FROM n WHERE kind NOT IN ('external_link', 'external_name') OR live > 0
""")
def workbook_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks by kind, and whether the baseline had them; passive links only where something reaches them."""
    c, kinds = table(spark, sf_dir, "customer"), F.array(*map(F.lit, RISK_KINDS))
    now = c.select(F.get(kinds, (F.col("c_nationkey") % 5).cast("int")).alias("kind"), F.col("c_custkey").alias("item"))
    before = spark.createDataFrame([("external_link", 1), ("macro", 2), ("activex", 3)], "kind string, item long")
    return parts.risks(before, now, table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("item")))


@query("""
WITH r AS (SELECT l_orderkey AS chart, l_linenumber AS series, 'values' AS role, l_suppkey AS sheet, CAST(l_quantity AS BIGINT) % 4 AS cells FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'categories', l_suppkey, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) % 4 FROM lineitem),
s AS (SELECT chart, series, bool_and(sheet IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) AND cells > 0) AS ok, count(DISTINCT cells) AS lengths FROM r GROUP BY 1, 2)
SELECT chart, series, CASE WHEN NOT ok THEN 'invalid' WHEN lengths > 1 THEN 'mismatch' ELSE 'valid' END AS status FROM s
""")
def chart_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether charts' series point at cells, as many for values as for categories."""
    li = table(spark, sf_dir, "lineitem")
    r = lambda role, n: li.select(F.col("l_orderkey").alias("chart"), F.col("l_linenumber").alias("series"), F.lit(role).alias("role"), F.col("l_suppkey").alias("sheet"), (n % 4).alias("cells"))
    refs = r("values", F.col("l_quantity").cast("long")).unionByName(r("categories", F.floor(F.col("l_discount") * 100 + 0.5).cast("long")))
    return parts.chart_references(refs, table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("sheet")))


@query("""
WITH m AS (SELECT o_orderkey AS k, floor(o_totalprice) AS x FROM orders WHERE o_orderkey % 29 <> 0)
SELECT CAST(k AS BIGINT) AS base_id, CAST(k AS BIGINT) AS current_id, f AS finding_class FROM m, LATERAL (SELECT unnest([CASE WHEN k % 3 = 0 THEN 'chart_kind_changed' END, CASE WHEN k % 4 = 0 THEN 'chart_legend_changed' END, CASE WHEN k % 7 * 10000 >= 50000 OR k % 5 * 10 >= 0.02 * 1000 THEN 'chart_geometry_changed' END]) AS f) u WHERE f IS NOT NULL
""")
def chart_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts matched by title, and what changed of kind, legend and geometry."""
    o, k = table(spark, sf_dir, "orders").where("o_orderkey % 29 <> 0"), F.col("o_orderkey")
    row = lambda kind, legend, x, width: o.select(k.alias("id"), F.lit("Charts").alias("sheet"), text("Chart ", k).alias("title"), F.array().cast("array<string>").alias("signature"), F.lit(None).cast("string").alias("anchor"), k.alias("source_index"), kind.alias("kind"), legend.alias("legend"), x.alias("x"), F.lit(0).alias("y"), width.alias("width"), F.lit(500).alias("height"))
    base = row(F.lit("bar"), F.lit("right"), F.lit(0), F.lit(1000))
    now = row(F.when(k % 3 == 0, "line").otherwise("bar"), F.when(k % 4 == 0, "top").otherwise("right"), k % 7 * 10_000, 1000 + k % 5 * 10)
    return parts.chart_findings(base, now, parts.matched_charts(base, now), ["kind", "legend"])


@query("""
WITH b AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 6 <> 5), c AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 6 <> 4)
SELECT coalesce('S' || CAST(b.k AS VARCHAR), 'S' || CAST(c.k AS VARCHAR)) AS sheet, 'Pivot' AS name, CASE WHEN b.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS event, CASE WHEN b.k IS NULL OR c.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.k % 3 = 0 THEN 'source' END, CASE WHEN b.k % 4 = 0 THEN 'location' END) END AS changed
FROM b FULL JOIN c ON b.k = c.k WHERE b.k IS NULL OR c.k IS NULL OR b.k % 3 = 0 OR b.k % 4 = 0
""")
def pivot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots that came, went, or have another source or place."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    row = lambda df, source, place: df.select(text("S", k).alias("sheet"), F.lit("Pivot").alias("name"), source.alias("source"), place.alias("location"))
    d = parts.pivots(row(n.where(k % 6 != 5), F.lit("A1:B9"), F.lit("D1")), row(n.where(k % 6 != 4), F.when(k % 3 == 0, "A1:B10").otherwise("A1:B9"), F.when(k % 4 == 0, "E1").otherwise("D1")))
    return d.withColumn("changed", F.array_join("changed", ","))
