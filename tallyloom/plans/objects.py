"""Queries on sheets, regions, series, formats, excerpts, coverage and what-if."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import formats
from tallyloom.operators import align, coverage, graph, objects, triage
from tallyloom.plans.checks import duplicate_keys, numeric_bounds, tie_out
from tallyloom.plans.cycles import GRID, grid, table
from tallyloom.plans.reviewing import FINDINGS, WAIVERS, findings

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH b AS (SELECT DISTINCT p_type AS base, CASE p_type WHEN 'ECONOMY' THEN 'Brand#1' ELSE p_type END AS k FROM part WHERE p_type <> 'PROMO'), c AS (SELECT DISTINCT p_brand AS current FROM part WHERE p_brand <> 'PROMO')
SELECT base, current, CASE WHEN base IS NULL THEN 'sheet_added' WHEN current IS NULL THEN 'sheet_removed' WHEN base <> current THEN 'sheet_renamed' ELSE 'unchanged' END AS event FROM b FULL JOIN c ON k = current
""")
def sheet_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets by name, with one confirmed rename and one ignored."""
    p = table(spark, sf_dir, "part")
    return objects.sheets(p.select(F.col("p_type").alias("n")), p.select(F.col("p_brand").alias("n")), "n", {"ECONOMY": "Brand#1"}, ["PROMO"])


def customer_regions(spark: SparkSession, sf_dir: str, later: int) -> tuple[DataFrame, DataFrame]:
    """A sheet for each segment and year, a region for each nation: its rows and columns, and its customers as labels; later: years after the sheet's."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sheet = F.concat_ws(" ", "c_mktsegment", F.year("o_orderdate") - later)
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(sheet.alias("sheet"), F.col("c_nationkey").alias("id"), "o_orderkey", "o_custkey")
    r = j.groupBy("sheet", "id").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("cols")).withColumn("orientation", F.when(F.col("rows") > 3, "long").otherwise("block")).withColumn("top", F.col("id"))
    return r, j.select("sheet", "id", F.col("o_custkey").alias("label")).distinct()


SCORES = """
j AS (SELECT year(o_orderdate) AS y, c_mktsegment AS s, c_nationkey AS id, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT y, s, id, count(*) AS rows, count(DISTINCT o_custkey) AS cols, CASE WHEN count(*) > 3 THEN 'long' ELSE 'block' END AS ori FROM j GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT y, s, id, o_custkey AS label FROM j),
c AS (SELECT a.y, a.s, a.id AS a, b.id AS b, count(*) AS common FROM l a JOIN l b ON b.y = a.y + 1 AND a.s = b.s AND a.label = b.label GROUP BY 1, 2, 3, 4),
p AS (SELECT x.s || ' ' || x.y AS sheet, x.id AS a, z.id AS b, 0.65 * 2.0 * coalesce(common, 0) / (x.cols + z.cols) + 0.25 * (least(x.rows, z.rows) / greatest(x.rows, z.rows) + least(x.cols, z.cols) / greatest(x.cols, z.cols)) / 2 + 0.10 / (1 + abs(x.id - z.id)) AS score
  FROM r x JOIN r z ON z.y = x.y + 1 AND x.s = z.s AND x.ori = z.ori LEFT JOIN c ON c.y = x.y AND c.s = x.s AND c.a = x.id AND c.b = z.id),
k AS (SELECT sheet, a, b, round(score, 6) AS score FROM p WHERE score >= 0.20)"""


@query(f"WITH {SCORES} SELECT sheet, a, b, score FROM k")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of all pairs of each year's regions and the next year's by labels, shape and place."""
    (a, la), (b, lb) = customer_regions(spark, sf_dir, 0), customer_regions(spark, sf_dir, 1)
    return objects.region_scores(a, b, la, lb).withColumn("score", F.round("score", 6))


@query(f"""
WITH RECURSIVE {SCORES}, n AS (SELECT sheet, a, b, score, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, a, b) AS place FROM k),
t(sheet, place, a, b, score, taken, used_a, used_b) AS (
  SELECT sheet, place, a, b, score, true, [a], [b] FROM n WHERE place = 1
  UNION ALL
  SELECT n.sheet, n.place, n.a, n.b, n.score, NOT (list_contains(used_a, n.a) OR list_contains(used_b, n.b)),
    CASE WHEN list_contains(used_a, n.a) OR list_contains(used_b, n.b) THEN used_a ELSE list_append(used_a, n.a) END, CASE WHEN list_contains(used_a, n.a) OR list_contains(used_b, n.b) THEN used_b ELSE list_append(used_b, n.b) END
  FROM t JOIN n ON n.sheet = t.sheet AND n.place = t.place + 1
)
SELECT sheet, a, b, score FROM t WHERE taken
""")
def region_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions paired one to one, best first."""
    return align.greedy(region_scores(spark, sf_dir), "sheet", "a", "b", "score", objects.LEAST)


@query("""
WITH m AS (SELECT DISTINCT o_custkey AS customer, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), a AS (SELECT customer, y, list_sort(list(m)) AS c FROM m GROUP BY 1, 2),
p AS (SELECT x.customer, x.y, x.c AS b, z.c AS c FROM a x JOIN a z ON x.customer = z.customer AND z.y = x.y + 1), n AS (SELECT *, len(list_intersect(b, c)) AS k FROM p)
SELECT customer, CAST(y AS INT) AS year, CASE WHEN b = c THEN 'same' WHEN len(c) > len(b) AND c[1:len(b)] = b THEN 'extended' WHEN len(c) < len(b) AND b[1:len(c)] = c THEN 'shortened' WHEN k > 0 AND len(b) = len(c) AND b[len(b) - k + 1:len(b)] = c[1:k] THEN 'rolled' ELSE 'replaced' END AS moved FROM n
""")
def chart_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each customer's active months moved from one year to the next: the categories of a chart."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"))
    a = o.groupBy("customer", "year").agg(F.sort_array(F.collect_set("m")).alias("c"))  # twelve months at most
    b = a.select("customer", (F.col("year") - 1).alias("year"), F.col("c").alias("d"))
    return a.join(b, ["customer", "year"]).select("customer", "year", objects.series_window(F.col("c"), F.col("d")).alias("moved"))


@query("""
WITH f(fmt, d, pct, th) AS (VALUES ('0.00', 2, false, 0), ('#,##0', 0, false, 0), ('0.0%', 1, true, 0), ('$#,##0.0,', 1, false, 1)), v AS (SELECT o_orderkey AS key, o_totalprice AS x, ['0.00', '#,##0', '0.0%', '$#,##0.0,', 'General', 'yyyy-mm-dd'][CAST(o_orderkey % 6 AS INT) + 1] AS fmt FROM orders)
SELECT v.fmt AS format, count(*) AS cells, count(f.fmt) AS shown, max(f.d) AS decimals FROM v LEFT JOIN f ON v.fmt = f.fmt GROUP BY 1
""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats that show a plain number, with their decimals; others show none."""
    kinds = F.array(*map(F.lit, ("0.00", "#,##0", "0.0%", "$#,##0.0,", "General", "yyyy-mm-dd")))
    v = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("format"))
    r = formats.with_rule(v, "format", "rule").withColumn("text", formats.shown(F.col("x"), F.col("rule")))
    return r.groupBy("format").agg(F.count("*").alias("cells"), F.count("text").alias("shown"), F.max("rule.decimals").alias("decimals"))


@query(f"""
WITH g AS ({GRID}), f AS (SELECT o_orderkey AS finding, o_custkey AS r, year(o_orderdate) * 12 + month(o_orderdate) AS c FROM orders WHERE o_totalprice > 495000)
SELECT finding, row, col FROM f JOIN g ON abs(row - r) <= 3 AND abs(col - c) <= 3
""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The populated cells around each finding."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 495000")
    f = o.select(F.col("o_orderkey").alias("finding"), F.lit("Orders").alias("sheet"), F.col("o_custkey").alias("row"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("col"))
    return objects.excerpts(f, grid(spark, sf_dir)).select("finding", "row", "col")


@query("""
WITH d AS (SELECT count(*) AS n FROM (SELECT o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS again FROM orders) WHERE again), b AS (SELECT count(*) AS n FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 495000),
m AS (SELECT l_orderkey AS key, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS total FROM lineitem GROUP BY 1),
t AS (SELECT count(*) FILTER (total IS NOT NULL AND o_totalprice IS NOT NULL AND NOT abs(total - floor(o_totalprice * 100 + 0.5)) <= 0.1 * abs(floor(o_totalprice * 100 + 0.5))) AS n FROM m FULL JOIN orders ON key = o_orderkey)
SELECT 'unique' AS "check", 'checked' AS state, n AS findings FROM d UNION ALL SELECT 'bounds', 'checked', n FROM b UNION ALL SELECT 'tie-out', 'degraded', n FROM t UNION ALL SELECT 'charts', 'unavailable', 0 UNION ALL SELECT 'deck', 'not_included', 0
""")
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ran, what ran in part, what could not run and what was not asked for."""
    ties = tie_out(spark, sf_dir).where("status = 'mismatch'")
    return coverage.rows(spark, {"unique": (duplicate_keys(spark, sf_dir), "checked"), "bounds": (numeric_bounds(spark, sf_dir), "checked"), "tie-out": (ties, "degraded"), "charts": (None, "checked"), "deck": (None, "not_included")})


@query(f"""
WITH g AS ({GRID}), m AS (SELECT 'cells' AS measure, CAST(count(*) AS BIGINT) AS value, 1000 AS w, 1000000000 AS r FROM g UNION ALL SELECT 'sheets', count(DISTINCT sheet), 8, 100 FROM g UNION ALL SELECT 'area', CAST(max(row) * max(col) AS BIGINT), 10, 100 FROM g)
SELECT measure, value, CASE WHEN value > r THEN 'refuse' WHEN value > w THEN 'warn' ELSE 'ok' END AS verdict FROM m
""")
def workload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's size against the limits that warn or refuse."""
    cells = grid(spark, sf_dir).withColumn("formula", F.lit(None).cast("string"))
    return coverage.workload(cells, {"cells": (1000, 1_000_000_000), "sheets": (8, 100), "area": (10, 100)})


@query(f"""
WITH {FINDINGS}, w AS (SELECT severity AS before, CASE WHEN reason = 'waiver' THEN CASE WHEN finding_class = 'column_deleted' THEN 'critical' ELSE severity END ELSE severity END AS after FROM f)
SELECT before, after, count(*) AS findings FROM w GROUP BY 1, 2
""")
def policy_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What severities would become without the waivers."""
    d = triage.waived(findings(spark, sf_dir), WAIVERS, "2026-01-01").withColumn("before", triage.severity())
    d = d.withColumn("expected_reason", F.when(F.col("waiver_reason").isNull(), F.col("expected_reason"))).withColumn("after", triage.severity())
    return d.groupBy("before", "after").agg(F.count("*").alias("findings"))


def decisions(orders: DataFrame) -> DataFrame:
    """An edge from each order to the customer's order before it."""
    return orders.select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b")).where("b is not null")


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), x AS (SELECT a, b FROM e WHERE b IS NOT NULL),
t AS (SELECT a AS start, b AS reached, 1 AS distance FROM x UNION ALL SELECT t.start, x.b, distance + 1 FROM t JOIN x ON t.reached = x.a)
SELECT start, reached, distance FROM t
""")
def decision_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of earlier decisions behind each order of a customer."""
    return graph.closure(decisions(table(spark, sf_dir, "orders")))


@query("""
WITH r AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS base, o_orderkey, o_totalprice FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o_totalprice, o_orderkey) AS current FROM r),
n AS (SELECT DISTINCT x.g, x.base, x.current FROM s x JOIN s y ON x.g = y.g AND ((y.base < x.base AND y.current > x.current) OR (y.base > x.base AND y.current < x.current)))
SELECT g AS customer, base, current FROM n
""")
def order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rules whose order is reversed."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    d = o.select(F.col("o_custkey").alias("customer"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("base"), F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("current"))
    return objects.inversions(d, "customer", "base", "current")
