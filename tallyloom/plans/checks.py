"""Queries on controls, shapes, formulas, dependencies and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import formulas as text
from tallyloom.functions import numbers
from tallyloom.operators import asof, controls, crosscheck, cycles, formulas, graph, regions
from tallyloom.plans.cycles import BILLED, GRID, billed, grid, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT c_custkey AS customer, p.o_orderpriority AS priority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority)
""")
def required_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of some priority: blank cells of a required range."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return controls.required(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), o.select("priority"), ["customer"], ["priority"])


@query("""
WITH f AS (SELECT o_custkey AS customer, o_orderpriority AS priority, o_orderkey AS row, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders)
SELECT * FROM f WHERE row > first
""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose composite key has occurred before, with the row of its first occurrence."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("row"))
    return controls.duplicates(o, ["customer", "priority"], "row")


@query("SELECT o_orderkey AS key, o_totalprice AS value, CASE WHEN o_totalprice < 5000 THEN 'min' ELSE 'max' END AS bound FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 495000")
def numeric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values outside declared bounds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return controls.out_of_bounds(o, "value", 5000.0, 495000.0)


@query("""
WITH m AS (SELECT l_orderkey AS key, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS total FROM lineitem GROUP BY 1)
SELECT coalesce(key, o_orderkey) AS key, CAST(total AS BIGINT) AS total, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS target,
  CASE WHEN total IS NULL OR o_totalprice IS NULL THEN 'invalid' WHEN abs(total - floor(o_totalprice * 100 + 0.5)) <= 0.1 * abs(floor(o_totalprice * 100 + 0.5)) THEN 'ok' ELSE 'mismatch' END AS status
FROM m FULL JOIN orders ON key = o_orderkey
""")
def tie_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each order, returned ones negative, against the order's value, in cents."""
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), cents("l_extendedprice").alias("value"), "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("value"))
    return controls.tie_out(m, o, ["key"], "value", "value", 0.0, 0.1, F.when(F.col("l_returnflag") == "R", -1).otherwise(1))


@query("""
WITH b AS (SELECT s_nationkey AS selector, count(*) AS v FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS selector, count(*) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT coalesce(b.selector, c.selector) AS selector, CASE WHEN b.selector IS NULL THEN 'missing_in_baseline' WHEN c.selector IS NULL THEN 'missing_in_current' ELSE 'different' END AS reason
FROM b FULL JOIN c ON b.selector = c.selector WHERE b.v IS DISTINCT FROM c.v
""")
def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that differ between the cycles and would stop a run."""
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("selector")).agg(F.count("*").alias("v"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("selector")).agg(F.count("*").alias("v"))
    return controls.prerequisites(b, c, "selector", "v")


@query("""
WITH m AS (SELECT o_orderkey AS row, 3 AS col, year(o_orderdate) AS y, month(o_orderdate) AS mo FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'),
r AS (SELECT *, CASE WHEN row BETWEEN 0 AND 999 AND col BETWEEN 1 AND 5 THEN y > 1998 OR (y = 1998 AND mo > 6) END AS a, CASE WHEN row BETWEEN 500 AND 100000000 AND col BETWEEN 3 AND 3 THEN y > 1999 OR (y = 1999 AND mo > 1) END AS b FROM m)
SELECT row, (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a, true) AND coalesce(b, true) AS allowed FROM r
""")
def allowed_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells that every availability rule over them allows, for their period is later than it says."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '4-NOT SPECIFIED'")
    d = o.select(F.col("o_orderkey").alias("row"), F.lit(3).alias("col"), F.struct(F.year("o_orderdate").alias("k1"), F.month("o_orderdate").alias("k2"), F.lit(0).alias("k3")).alias("period"))
    rules = [(0, 999, 1, 5, (1998, 6, 0)), (500, 100_000_000, 3, 3, (1999, 1, 0))]
    return controls.allowed_blanks(d, rules, "row", "col", "period").select("row", "allowed")


@query(f"WITH g AS ({GRID}), r AS (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS i FROM g) SELECT sheet, row, min(col) AS first, max(col) AS last FROM r GROUP BY sheet, row, i")
def cell_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring populated cells of each row."""
    return regions.runs(grid(spark, sf_dir), ["sheet", "row"], "col")


@query(f"""
WITH RECURSIVE g AS ({GRID}), r AS (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS i FROM g), u AS (SELECT row, min(col) AS a, max(col) AS b FROM r GROUP BY row, i),
e AS (SELECT x.row AS r1, x.a AS a1, y.row AS r2, y.a AS a2 FROM u x JOIN u y ON (y.row = x.row + 1 OR y.row = x.row - 1) AND x.a <= y.b AND y.a <= x.b),
t AS (SELECT row AS r0, a AS a0, row, a FROM u UNION SELECT t.r0, t.a0, e.r2, e.a2 FROM t JOIN e ON t.row = e.r1 AND t.a = e.a1),
s AS (SELECT r0, a0, min(row * 1000000 + a) AS part FROM t GROUP BY 1, 2)
SELECT 'Orders' AS sheet, min(u.row) AS min_row, max(u.row) AS max_row, min(u.a) AS min_col, max(u.b) AS max_col, CAST(sum(u.b - u.a + 1) AS BIGINT) AS cells FROM s JOIN u ON s.r0 = u.row AND s.a0 = u.a GROUP BY part
""")
def regions_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of cells that touch, as its SQL states; they can overlap."""
    return regions.components(grid(spark, sf_dir), "sheet", "row", "col")


@query(f"""
WITH RECURSIVE g AS ({GRID}), r AS (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS i FROM g), u AS (SELECT row, min(col) AS a, max(col) AS b FROM r GROUP BY row, i),
e AS (SELECT x.row AS r1, x.a AS a1, y.row AS r2, y.a AS a2 FROM u x JOIN u y ON (y.row = x.row + 1 OR y.row = x.row - 1) AND x.a <= y.b AND y.a <= x.b),
t AS (SELECT row AS r0, a AS a0, row, a FROM u UNION SELECT t.r0, t.a0, e.r2, e.a2 FROM t JOIN e ON t.row = e.r1 AND t.a = e.a1),
s AS (SELECT r0, a0, min(row * 1000000 + a) AS part FROM t GROUP BY 1, 2),
c AS (SELECT min(u.row) AS r1, max(u.row) AS r2, min(u.a) AS c1, max(u.b) AS c2, sum(u.b - u.a + 1) AS cells FROM s JOIN u ON s.r0 = u.row AND s.a0 = u.a GROUP BY part),
m AS (SELECT 0 AS n, r1, r2, c1, c2 FROM c UNION ALL SELECT DISTINCT n + 1, r1, r2, c1, c2 FROM (SELECT x.n, min(y.r1) AS r1, max(y.r2) AS r2, min(y.c1) AS c1, max(y.c2) AS c2
  FROM m x JOIN m y ON x.r1 <= y.r2 AND y.r1 <= x.r2 AND x.c1 <= y.c2 AND y.c1 <= x.c2 WHERE EXISTS (SELECT 1 FROM m v JOIN m w ON v.r1 <= w.r2 AND w.r1 <= v.r2 AND v.c1 <= w.c2 AND w.c1 <= v.c2 AND (v.r1, v.r2, v.c1, v.c2) <> (w.r1, w.r2, w.c1, w.c2)) GROUP BY x.n, x.r1, x.r2, x.c1, x.c2)),
f AS (SELECT * FROM m WHERE n = (SELECT max(n) FROM m))
SELECT 'Orders' AS sheet, f.r1 AS min_row, f.r2 AS max_row, f.c1 AS min_col, f.c2 AS max_col, CAST(sum(c.cells) AS BIGINT) AS cells FROM f JOIN c ON c.r1 >= f.r1 AND c.r2 <= f.r2 AND c.c1 >= f.c1 AND c.c2 <= f.c2 GROUP BY 1, 2, 3, 4, 5
""")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of cells that touch, merged until none overlap."""
    return regions.regions(grid(spark, sf_dir), "sheet", "row", "col")


@query(f"""
WITH g AS ({GRID}), r AS (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS i FROM g), u AS (SELECT sheet, row, min(col) AS min_col, max(col) AS max_col FROM r GROUP BY sheet, row, i),
v AS (SELECT *, row - row_number() OVER (PARTITION BY sheet, min_col, max_col ORDER BY row) AS j FROM u)
SELECT sheet, min(row) AS min_row, max(row) AS max_row, min_col, max_col FROM v GROUP BY sheet, min_col, max_col, j
""")
def rectangle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that cover the populated cells."""
    return regions.cover(grid(spark, sf_dir), "sheet", "row", "col")


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row, event_type = 'error' AS flagged FROM events), t AS (SELECT user_id, count(*) AS cells, count(*) FILTER (flagged) AS flagged FROM e GROUP BY 1),
r AS (SELECT user_id, row - row_number() OVER (PARTITION BY user_id ORDER BY row) AS i FROM e WHERE flagged), l AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id, i), x AS (SELECT user_id, max(n) AS longest, count(*) AS runs FROM l GROUP BY 1)
SELECT user_id, cells, flagged, longest, runs, (flagged >= 20 AND (flagged >= 0.5 * cells OR longest >= 0.8 * flagged)) OR flagged >= 200 AS population FROM t JOIN x USING (user_id)
""")
def error_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in which errors are so many or so dense that they are one population."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("row"), (F.col("event_type") == "error").alias("flagged"))
    return regions.populations(e, ["user_id"], "row")


def formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a formula in column D of each order's row: urgent orders refer to a fixed rate, pending ones to the row above."""
    row = F.col("o_orderkey") + 2
    s = row.cast("string")
    f = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("=B"), s, F.lit("*$F$1"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("=SUM(B"), s, F.lit(":C"), s, F.lit(")+D"), (row - 1).cast("string"))).otherwise(F.concat(F.lit("=B"), s, F.lit("-C"), s))
    return table(spark, sf_dir, "orders").select(F.lit("Orders").alias("sheet"), row.alias("row"), F.lit(4).alias("col"), f.alias("formula"), F.col("o_custkey").alias("line"))


KIND = "CASE WHEN o_orderpriority = '1-URGENT' THEN '=RC[-2]*R1C6' WHEN o_orderstatus = 'P' THEN '=SUM(RC[-2]:RC[-1])+R[-1]C' ELSE '=RC[-2]-RC[-1]' END"


@query(f"SELECT {KIND} AS relative, count(*) AS cells FROM orders GROUP BY 1")
def relative_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by relative form: copies of one formula are one form."""
    return text.with_relative(formula_cells(spark, sf_dir), "formula", "row", "col", "relative").groupBy("relative").agg(F.count("*").alias("cells"))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '<ref>*<ref>' WHEN o_orderstatus = 'P' THEN 'SUM(<range>)+<ref>' ELSE '<ref>-<ref>' END AS pattern, count(*) AS cells, count(DISTINCT o_orderkey) AS formulas FROM orders GROUP BY 1")
def formula_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by pattern key, computed on distinct formulas."""
    return text.with_pattern(formula_cells(spark, sf_dir), "formula", "pattern").groupBy("pattern").agg(F.count("*").alias("cells"), F.countDistinct("formula").alias("formulas"))


@query(f"""
WITH f AS (SELECT o_custkey AS line, o_orderkey + 2 AS row, {KIND} AS relative FROM orders), n AS (SELECT line, relative, count(*) AS n, min(row) AS first FROM f GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY line) AS total, row_number() OVER (PARTITION BY line ORDER BY n DESC, first) AS k FROM n), d AS (SELECT line, relative AS dominant FROM t WHERE k = 1 AND total >= 3 AND n > 0.5 * total)
SELECT line, row, relative, dominant FROM f JOIN d USING (line) WHERE relative <> dominant
""")
def inconsistent_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose formula isn't the one that dominates their line."""
    c = text.with_relative(formula_cells(spark, sf_dir), "formula", "row", "col", "relative")
    return formulas.inconsistent(c, ["line"], "row", "relative").select("line", "row", "relative", "dominant")


@query("""
WITH f AS (SELECT DISTINCT o_custkey AS line, year(o_orderdate) * 12 + month(o_orderdate) AS place FROM orders), s AS (SELECT line, min(place) AS lo, max(place) AS hi, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 4 AND count(*) >= 0.1 * (max(place) - min(place) + 1)),
d AS (SELECT line, unnest(range(lo, hi + 1)) AS place FROM s)
SELECT line, place FROM d ANTI JOIN f USING (line, place)
""")
def formula_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without a formula within lines that are filled enough."""
    c = grid(spark, sf_dir).select(F.col("row").alias("line"), F.col("col").alias("place"), F.lit("=1").alias("formula"))
    return formulas.gaps(c, ["line"], "place", least=4, share=0.1)


@query("""
WITH now AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN '#N/A' WHEN o_totalprice > 400000 THEN '#REF!' END AS error FROM orders),
was AS (SELECT l_orderkey AS key, CASE WHEN max(l_discount) > 0.09 THEN '#N/A' END AS error FROM lineitem GROUP BY 1)
SELECT now.key, now.error, CASE WHEN was.key IS NULL THEN 'new' WHEN was.error = now.error THEN 'inherited' ELSE 'changed' END AS provenance FROM now LEFT JOIN was ON now.key = was.key WHERE now.error IS NOT NULL
""")
def error_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error cells, and whether they were there before."""
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "#N/A").when(F.col("o_totalprice") > 400000, "#REF!").alias("error"))
    was = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.when(F.max("l_discount") > 0.09, "#N/A").alias("error"))
    return formulas.errors(now, was, ["key"], "error")


@query("""
WITH c AS (SELECT o_orderkey + 2 AS row, o_orderpriority = '1-URGENT' AS u, o_orderstatus = 'P' AS p FROM orders),
r AS (SELECT row, row AS a, row AS b, 2 AS x, 2 AS y FROM c WHERE u OR NOT p UNION ALL SELECT row, 1, 1, 6, 6 FROM c WHERE u UNION ALL SELECT row, row, row, 2, 3 FROM c WHERE NOT u AND p UNION ALL SELECT row, row - 1, row - 1, 4, 4 FROM c WHERE NOT u AND p UNION ALL SELECT row, row, row, 3, 3 FROM c WHERE NOT u AND NOT p)
SELECT row, a AS min_row, b AS max_row, CAST(x AS BIGINT) AS min_col, CAST(y AS BIGINT) AS max_col FROM r
""")
def formula_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles that each formula refers to."""
    return text.precedents(formula_cells(spark, sf_dir), "formula", "sheet", "row", "col").select("row", "min_row", "max_row", "min_col", "max_col")


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS start, c_custkey // 2 AS reached, 1 AS distance FROM customer WHERE c_custkey > 0 UNION ALL SELECT start, reached // 2, distance + 1 FROM t WHERE reached > 0)
SELECT start, reached, distance FROM t
""")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependents over a tree of references (each customer's account rolls up into that of half its number)."""
    e = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 2").alias("b"))
    return graph.closure(e)


#: Each order's running total reads the next order's; where a customer ordered again within 20 orders, the later total reads the earlier one too.
CIRCULAR = """
o AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), i AS (SELECT p AS lo, k AS hi FROM o WHERE k - p <= 20),
n AS (SELECT lo, hi, lo > coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM i), g AS (SELECT lo, hi, sum(fresh::INT) OVER (ORDER BY lo, hi) AS part FROM n),
s AS (SELECT min(lo) AS cycle, max(hi) AS last FROM g GROUP BY part), c AS (SELECT k AS id, cycle FROM o JOIN s ON k BETWEEN cycle AND last)"""


def circular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("n"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("p"))
    forward = o.select("a", F.col("n").alias("b")).join(o.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    return cycles.cycles(forward.unionByName(o.where("a - p <= 20").select("a", F.col("p").alias("b"))))


@query(f"WITH {CIRCULAR} SELECT id, cycle FROM c")
def circular_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on cycles of references, by cycle: one chain of all orders with references back."""
    return circular_cells(spark, sf_dir)


@query(f"""
WITH {CIRCULAR}, d AS (SELECT *, 'Orders!B' || id AS shown, row_number() OVER (PARTITION BY cycle ORDER BY id) AS place FROM c)
SELECT cycle, count(*) AS cells, 'Orders!B' || cycle AS location, string_agg(shown, '; ' ORDER BY id) FILTER (place <= 8) || CASE WHEN count(*) > 8 THEN '; +' || (count(*) - 8) || ' more cells' ELSE '' END AS element,
  'excel-cycle:' || substr(sha256('[' || string_agg('"' || shown || '"', ',' ORDER BY id) || ']'), 1, 12) AS event_key
FROM d GROUP BY cycle
""")
def circular_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each cycle, with a key made of all its cells."""
    return cycles.findings(circular_cells(spark, sf_dir), "cycle", ["id"], F.concat(F.lit("Orders!B"), F.col("id").cast("string")))


@query("""
SELECT p_partkey AS part, count(*) AS cells, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM part JOIN lineitem ON l_partkey BETWEEN p_partkey AND p_partkey + p_size AND l_linenumber BETWEEN 1 AND 3 GROUP BY 1
""")
def rectangle_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that lie in the ranges of a list, found through blocks of rows and columns."""
    p = table(spark, sf_dir, "lineitem").select(F.lit("Items").alias("sheet"), F.col("l_partkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), "l_quantity")
    r = table(spark, sf_dir, "part").select(F.lit("Items").alias("sheet"), F.col("p_partkey").alias("part"), F.col("p_partkey").alias("min_row"), (F.col("p_partkey") + F.col("p_size")).alias("max_row"), F.lit(1).alias("min_col"), F.lit(3).alias("max_col"))
    return graph.contained(p, r).groupBy("part").agg(F.count("*").alias("cells"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as a deck shows them: in thousands with two decimals."""
    m = F.floor(F.abs("s_acctbal") / 10 + 0.5) / 100
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("figure_id"), m.alias("mantissa"), F.lit(1000.0).alias("scale"), F.lit(False).alias("percent"), F.lit(2).alias("decimals"), (F.col("s_acctbal") < 0).alias("negative"))
    return d.withColumn("figure_value", F.when(F.col("negative"), -F.col("mantissa")).otherwise(F.col("mantissa")) * 1000)


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit("Accounts").alias("sheet"), F.col("c_custkey").alias("row"), F.lit(4).alias("col"), F.col("c_acctbal").alias("value"))


FIGURES = "f AS (SELECT s_suppkey AS figure_id, floor(abs(s_acctbal) / 10 + 0.5) / 100 AS m, s_acctbal < 0 AS neg, CASE WHEN s_acctbal < 0 THEN -1 ELSE 1 END * (floor(abs(s_acctbal) / 10 + 0.5) / 100) * 1000 AS fv FROM supplier)"


@query(f"""
WITH {FIGURES}, j AS (SELECT figure_id, c_custkey AS row, c_acctbal AS value, abs(c_acctbal / 1000 - CASE WHEN neg THEN -m ELSE m END) <= 0.5 * 0.01 + 1e-9 AS shown, CASE WHEN fv = 0 THEN abs(c_acctbal) ELSE abs(c_acctbal - fv) / abs(fv) END AS difference FROM f, customer),
r AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY shown DESC, difference, 'D' || row) AS rank FROM j WHERE shown OR difference <= 0.05)
SELECT figure_id, rank, row, value, shown FROM r WHERE rank <= 5
""")
def figure_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest source cells of each displayed figure."""
    return crosscheck.candidates(figures(spark, sf_dir), balances(spark, sf_dir)).select("figure_id", F.col("rank").cast("long").alias("rank"), "row", "value", "shown")


@query()
def labelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest source cells of each displayed figure, told apart by the labels around them: segments to the left, a heading above."""
    c = table(spark, sf_dir, "customer")
    cell = lambda d, row, col, value, vtype, num: d.select(F.lit("Accounts").alias("sheet"), row.cast("long").alias("row"), F.lit(col).cast("long").alias("col"), value.alias("text"), F.lit(vtype).alias("vtype"), num.cast("double").alias("num"))
    none = F.lit(None)
    k = F.col("c_custkey") + 2
    cells = cell(c, k, 1, F.col("c_mktsegment"), "text", none).unionByName(cell(c, k, 4, none.cast("string"), "number", F.col("c_acctbal"))).unionByName(cell(spark.range(1), F.lit(1), 4, F.lit("Balance"), "text", none))
    told = asof.labels(cells.withColumnRenamed("text", "value")).where("vtype = 'number'").drop("value").withColumnRenamed("num", "value")
    n = table(spark, sf_dir, "nation")
    f = figures(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("figure_id"), F.col("s_nationkey").alias("n_nationkey")), "figure_id").join(n, "n_nationkey")
    segments = F.array(*map(F.lit, ("automobile", "BUILDING", "furniture", "HOUSEHOLD", "machinery")))
    f = f.withColumn("context", F.concat_ws(" ", F.lit("Balance of"), F.upper(F.get(segments, (F.col("figure_id") % 5).cast("int"))), "n_name")).drop("n_nationkey", "n_name", "n_regionkey")
    return crosscheck.candidates(f, told).select("figure_id", "rank", "row", "label_score", "shown")


@query("""
WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS who, ts, event_type FROM events),
v AS (SELECT who, ts AS seen_at, max(event_id) AS seen FROM e WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.who, v.seen, v.seen_at FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.who = v.who AND p.ts >= v.seen_at
""")
def last_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view until then; a third of the users are one."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("who"), "ts", "event_type")
    views = e.where("event_type = 'view'").select("who", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen"))
    return asof.asof(e.where("event_type = 'purchase'"), views, ["who"], "ts", "seen_at", tie="seen").select("event_id", "who", "seen", "seen_at")


@query("""
WITH g AS (SELECT o_custkey AS row, year(o_orderdate) * 12 + month(o_orderdate) AS col, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), c AS (SELECT row, col, o_orderstatus <> 'F' AS label, o_orderpriority AS text FROM g JOIN orders ON k = o_orderkey)
SELECT row, col, last_value(CASE WHEN label THEN text END IGNORE NULLS) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS row_label, last_value(CASE WHEN label THEN text END IGNORE NULLS) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS column_label FROM c
""")
def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest text left of and above each cell."""
    o = table(spark, sf_dir, "orders").withColumn("col", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long"))
    g = o.groupBy(F.col("o_custkey").alias("row"), "col").agg(F.min("o_orderkey").alias("o_orderkey")).join(o.drop("col"), "o_orderkey")
    cells = g.select(F.lit("Orders").alias("sheet"), "row", "col", F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") != "F", "text").otherwise("number").alias("vtype"))
    return asof.labels(cells).select("row", "col", "row_label", "column_label")


@query(f"""
WITH {FIGURES}, m AS (SELECT l_suppkey AS figure_id, min(l_partkey) AS row FROM lineitem GROUP BY 1)
SELECT m.figure_id, m.row, CASE WHEN fv IS NULL OR c_acctbal IS NULL THEN 'unresolved' WHEN abs(c_acctbal / 1000 - CASE WHEN neg THEN -m ELSE m END) <= 0.5 * 0.01 + 1e-9 THEN 'verified' ELSE 'mismatch' END AS status
FROM m LEFT JOIN f ON f.figure_id = m.figure_id LEFT JOIN customer ON c_custkey = m.row
""")
def verified_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sources of figures: verified, mismatch or unresolved."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("figure_id")).agg(F.min("l_partkey").alias("row")).select("figure_id", F.lit("Accounts").alias("sheet"), "row", F.lit(4).alias("col"))
    return crosscheck.verified(m, figures(spark, sf_dir), balances(spark, sf_dir)).select("figure_id", "row", "status")


@query("""
SELECT o_custkey AS customer, o_orderpriority AS priority, count(DISTINCT o_orderstatus) AS slides, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) >= 2 AND max(o_totalprice) - min(o_totalprice) > 200000
""")
def repeated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same claim on several slides with values further apart than their precision."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), "o_orderstatus", "o_totalprice", F.lit(100000.0).alias("half"))
    return crosscheck.claims(o, ["customer", "priority"], "o_orderstatus", "o_totalprice", "half")


@query("""
SELECT o_custkey AS line, o_orderkey AS place, last_value(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM orders
""")
def nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label to the left of each cell."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("label"))
    return crosscheck.nearest_label(o, ["line"], "place", "label", "heading").drop("label")


@query()
def displayed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in all texts, by unit and sign."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.figures(F.col("text"))).alias("f"))
    return d.groupBy("doc_id").agg(F.count("*").alias("figures"), F.count_if(F.col("f.percent")).alias("percents"), F.count_if(F.col("f.negative")).alias("negatives"), F.max("f.decimals").alias("most_decimals"))


@query(f"WITH b AS ({BILLED}) SELECT o_orderstatus AS status, count(*) AS orders, count(b.key) AS billed FROM orders LEFT JOIN b ON o_orderkey = b.key GROUP BY ROLLUP (o_orderstatus)")
def check_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a check could see, by status and in all: what is missing isn't a pass."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    b = billed(spark, sf_dir).select("key", F.lit(1).alias("b"))
    return o.join(b, "key", "left").rollup("status").agg(F.count("*").alias("orders"), F.count("b").alias("billed"))
