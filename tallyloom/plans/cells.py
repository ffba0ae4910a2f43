"""Queries on sheets of cells: layout, alignment of rows and columns, changed cells, axis events.

Each nation is a sheet of order values by market segment: months across (wide), months down (long), or order priorities down
(block). The current cycle leaves pending orders out, moves on by a month, and renames the segments of some sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import periods
from tallyloom.operators import celldiff, layout, regions
from tallyloom.operators.graph import shared
from tallyloom.plans.cycles import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: The baseline has the orders' months (12 x year + month - 1) but the last; the current cycle has the last too, and begins one later on even sheets.
MONTH = "12 * year(o_orderdate) + month(o_orderdate) - 1"
FIRST, LAST = f"(SELECT min({MONTH}) FROM orders)", f"(SELECT max({MONTH}) - 1 FROM orders)"


def values(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def cells(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """Cells as layout takes them, of all sheets of one cycle."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.where("o_orderstatus <> 'P'") if current else o
    d = d.join(c, d["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("segment"), (12 * F.year("o_orderdate") + F.month("o_orderdate") - 1).alias("m"), F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    kind = F.col("n") % 3
    low, high = o.agg(F.min(F.expr(MONTH)), F.max(F.expr(MONTH)) - 1).first()
    first, last = F.lit(low) + (F.when(F.col("n") % 2 == 0, 1).otherwise(0) if current else F.lit(0)), F.lit(high + (1 if current else 0))
    label = lambda m: F.date_format(F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)), "MMM-yyyy")
    named = F.when((F.col("n") >= 12) & (kind == 0), F.concat(F.lit("X-"), F.col("segment"))).otherwise(F.col("segment")) if current else F.col("segment")
    s = n.select("n", F.posexplode(values(SEGMENTS)).alias("i", "segment"))
    dated = s.where(kind < 2).withColumn("first", first).withColumn("m", F.explode(F.sequence(first, last)))
    dated = dated.join(d.groupBy("n", "segment", "m").agg(F.sum("cents").alias("cents")), ["n", "segment", "m"], "left").withColumn("j", F.col("m") - F.col("first"))
    block = s.where(kind == 2).select("n", "i", "segment", F.posexplode(values(PRIORITIES)).alias("j", "priority"))
    block = block.join(d.groupBy("n", "segment", "priority").agg(F.sum("cents").alias("cents")), ["n", "segment", "priority"], "left")
    none = F.lit(None).cast("double")
    at = lambda row, col, value, num: (row.cast("long").alias("row"), col.cast("long").alias("col"), value.alias("value"), num.alias("num"))
    amount = F.coalesce(F.col("cents"), F.lit(0)) / 100
    wide = kind == 0
    parts = [
        dated.select("n", *at(F.when(wide, F.col("i")).otherwise(F.col("j")) + 2, F.when(wide, F.col("j")).otherwise(F.col("i")) + 2, amount.cast("string"), amount)),
        dated.where("i = 0").select("n", *at(F.when(wide, 1).otherwise(F.col("j") + 2), F.when(wide, F.col("j") + 2).otherwise(1), label(F.col("m")), none)),
        s.select("n", *at(F.when(wide, F.col("i") + 2).otherwise(1), F.when(wide, 1).otherwise(F.col("i") + 2), named, none)),
        block.select("n", *at(F.col("j") + 2, F.col("i") + 2, amount.cast("string"), amount)),
        block.where("i = 0").select("n", *at(F.col("j") + 2, F.lit(1), F.col("priority"), none)),
        n.select("n", *at(F.lit(1), F.lit(1), F.lit("Item"), none)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(F.concat(F.lit("S"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("sheet"), "row", "col", "value", "num", F.when(F.col("num").isNull(), "text").otherwise("number").alias("vtype"), F.lit(None).cast("string").alias("formula"))
    return shared(periods.with_period(out, "value", "period"))


def cells_sql(current: bool) -> str:
    """The same cells: n, row, col, value (labels), num."""
    first = f"({FIRST} + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END)" if current else f"{FIRST}"
    last = f"{LAST} + {1 if current else 0}"
    name = "CASE WHEN n >= 12 AND n % 3 = 0 THEN 'X-' || segment ELSE segment END" if current else "segment"
    side = "c" if current else "b"
    rows = lambda names: ", ".join(f"({i}, '{x}')" for i, x in enumerate(names))
    return f"""
{side}d AS (SELECT c_nationkey AS n, c_mktsegment AS segment, 12 * year(o_orderdate) + month(o_orderdate) - 1 AS m, o_orderpriority AS priority, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey {"WHERE o_orderstatus <> 'P'" if current else ""}),
{side}s AS (SELECT n_nationkey AS n, i, segment FROM nation, (VALUES {rows(SEGMENTS)}) t(i, segment)),
{side}t AS (SELECT s.n, s.i, s.segment, m.m, m.m - {first.replace("n %", "s.n %")} AS j, coalesce(sum(d.cents), 0) / 100.0 AS num FROM {side}s s JOIN (SELECT unnest(range({FIRST}, {last} + 1)) AS m) m ON m.m >= {first.replace("n %", "s.n %")} LEFT JOIN {side}d d ON d.n = s.n AND d.segment = s.segment AND d.m = m.m WHERE s.n % 3 < 2 GROUP BY ALL),
{side}k AS (SELECT s.n, s.i, p.j, p.priority, coalesce(sum(d.cents), 0) / 100.0 AS num FROM {side}s s JOIN (VALUES {rows(PRIORITIES)}) p(j, priority) ON true LEFT JOIN {side}d d ON d.n = s.n AND d.segment = s.segment AND d.priority = p.priority WHERE s.n % 3 = 2 GROUP BY ALL),
{side}cells AS (
  SELECT n, CASE WHEN n % 3 = 0 THEN i ELSE j END + 2 AS row, CASE WHEN n % 3 = 0 THEN j ELSE i END + 2 AS col, NULL AS value, num, NULL AS m FROM {side}t
  UNION ALL SELECT n, CASE WHEN n % 3 = 0 THEN 1 ELSE j + 2 END, CASE WHEN n % 3 = 0 THEN j + 2 ELSE 1 END, strftime(make_date(CAST(m // 12 AS INT), CAST(m % 12 + 1 AS INT), 1), '%b-%Y'), NULL, m FROM {side}t WHERE i = 0
  UNION ALL SELECT n, CASE WHEN n % 3 = 0 THEN i + 2 ELSE 1 END, CASE WHEN n % 3 = 0 THEN 1 ELSE i + 2 END, {name}, NULL, NULL FROM {side}s
  UNION ALL SELECT n, j + 2, i + 2, NULL, num, NULL FROM {side}k
  UNION ALL SELECT n, j + 2, 1, priority, NULL, NULL FROM {side}k WHERE i = 0
  UNION ALL SELECT n_nationkey, 1, 1, 'Item', NULL, NULL FROM nation
)"""


def laid_out(found: DataFrame) -> DataFrame:
    boxes = shared(regions.regions(found.select("sheet", "row", "col"), "sheet", "row", "col"))
    return shared(layout.oriented(found, boxes))


SHEET = "'S' || lpad(CAST(n AS VARCHAR), 2, '0')"
EVIDENCE = """
lines AS (
  SELECT n, 'columns' AS axis, 1 AS anchor, count(*) AS cells, count(m) AS periods FROM bcells WHERE row = 1 AND col > 1 GROUP BY 1
  UNION ALL SELECT n, 'rows', col, count(*), count(m) FROM bcells WHERE col <= 3 AND row > 1 GROUP BY 1, 3
), best AS (SELECT n, axis, anchor FROM lines WHERE periods >= 4 AND periods >= 0.8 * cells QUALIFY row_number() OVER (PARTITION BY n ORDER BY periods DESC) = 1)"""


@query(f"""
WITH {cells_sql(False)}, {EVIDENCE}, box AS (SELECT n, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col FROM bcells GROUP BY 1)
SELECT {SHEET} AS sheet, CAST(min_row AS BIGINT) AS min_row, CAST(max_row AS BIGINT) AS max_row, CAST(min_col AS BIGINT) AS min_col, CAST(max_col AS BIGINT) AS max_col, CASE axis WHEN 'columns' THEN 'wide' WHEN 'rows' THEN 'long' ELSE 'block' END AS orientation,
  CAST(CASE WHEN axis IS NOT NULL THEN min_row END AS BIGINT) AS header_row, CAST(CASE WHEN axis = 'rows' THEN anchor ELSE min_col END AS BIGINT) AS key_col FROM box LEFT JOIN best USING (n)
""")
def region_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet's region with its orientation, header and key, by the evidence of its period labels."""
    return laid_out(cells(spark, sf_dir, False))


def paired(base: DataFrame, current: DataFrame) -> DataFrame:
    """One region a sheet on both sides."""
    side = lambda df, s: df.select("sheet", F.struct(*layout.BOX, "orientation", "header_row", "key_col").alias(s))
    j = side(base, "base").join(side(current, "current"), "sheet").where("base.orientation = current.orientation")
    return shared(j.select(F.col("sheet").alias("id"), "sheet", F.col("base.orientation").alias("orientation"), "base", "current"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each cycle's cells of paired regions, the pairs, and their aligned axes."""
    b, c = cells(spark, sf_dir, False), cells(spark, sf_dir, True)
    pairs = paired(laid_out(b), laid_out(c))
    b, c = layout.held_cells(b, pairs, "base"), layout.held_cells(c, pairs, "current")
    return b, c, pairs, shared(layout.aligned_regions(b, c, pairs))


ENTRIES = "UNION ALL ".join(f"""
  SELECT '{s}' AS side, n, 'rows' AS axis, row AS i, value AS k, m FROM {s}cells WHERE col = 1 AND (row > 1 OR n % 3 <> 1)
  UNION ALL SELECT '{s}', n, 'columns', col, CASE WHEN n % 3 = 2 THEN CAST(col AS VARCHAR) ELSE value END, CASE WHEN n % 3 = 2 THEN NULL ELSE m END FROM {s}cells WHERE row = 1
""" for s in ("b", "c"))  # fmt: skip
ALIGNED = f"""{cells_sql(False)}, {cells_sql(True)}, e AS ({ENTRIES}),
x AS (SELECT *, row_number() OVER (PARTITION BY n, axis ORDER BY i) AS p, max(m) OVER (PARTITION BY n, axis) AS latest FROM e WHERE side = 'b'),
y AS (SELECT *, row_number() OVER (PARTITION BY n, axis ORDER BY i) AS p FROM e WHERE side = 'c'),
keyed AS (SELECT coalesce(x.n, y.n) AS n, coalesce(x.axis, y.axis) AS axis, x.i AS base_index, y.i AS current_index, y.m FROM x FULL JOIN y ON x.n = y.n AND x.axis = y.axis AND x.k = y.k),
ratio AS (SELECT n, axis, count(*) FILTER (base_index IS NOT NULL AND current_index IS NOT NULL) < 0.5 * count(base_index) AS falls, count(base_index) >= 4 AND count(current_index) >= 4 AS unsure FROM keyed GROUP BY 1, 2),
pairs AS (
  SELECT k.*, 'keys' AS how, false AS unsure FROM keyed k JOIN ratio r USING (n, axis) WHERE NOT r.falls
  UNION ALL SELECT coalesce(x.n, y.n), coalesce(x.axis, y.axis), x.i, y.i, y.m, 'positional', r.unsure FROM x FULL JOIN y ON x.n = y.n AND x.axis = y.axis AND x.p = y.p JOIN ratio r ON r.n = coalesce(x.n, y.n) AND r.axis = coalesce(x.axis, y.axis) WHERE r.falls
),
aligned AS (
  SELECT n, axis, CAST(base_index AS BIGINT) AS base_index, CAST(current_index AS BIGINT) AS current_index, CASE WHEN base_index IS NOT NULL AND current_index IS NOT NULL THEN 'paired' WHEN current_index IS NULL THEN 'deleted' WHEN m > (SELECT max(latest) FROM x WHERE x.n = p.n AND x.axis = p.axis) THEN 'growth' ELSE 'inserted' END AS event,
    CASE WHEN n % 3 = 2 AND axis = 'columns' THEN 'positional' ELSE how END AS method, unsure FROM pairs p
)"""


@query(f"WITH {ALIGNED} SELECT {SHEET} AS sheet, axis, base_index, current_index, event, method, unsure FROM aligned")
def axis_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of each sheet paired by key or, where too few keys match, by place."""
    return both(spark, sf_dir)[3].select(F.col("id").alias("sheet"), "axis", "base_index", "current_index", "event", "method", "unsure")


@query(f"""
WITH {ALIGNED}, r AS (SELECT * FROM aligned WHERE axis = 'rows' AND event = 'paired'), k AS (SELECT * FROM aligned WHERE axis = 'columns' AND event = 'paired'),
bp AS (SELECT n, base_index AS base_row, current_index AS row, kb AS base_col, kc AS col, value, num, m FROM (SELECT bcells.*, r.base_index, r.current_index, k.base_index AS kb, k.current_index AS kc FROM bcells JOIN r ON r.n = bcells.n AND r.base_index = bcells.row JOIN k ON k.n = bcells.n AND k.base_index = bcells.col)),
cp AS (SELECT n, base_index AS base_row, row, kb AS base_col, col, value, num, m FROM (SELECT ccells.*, r.base_index, k.base_index AS kb FROM ccells JOIN r ON r.n = ccells.n AND r.current_index = ccells.row JOIN k ON k.n = ccells.n AND k.current_index = ccells.col)),
j AS (SELECT n, base_row, row, base_col, col, bp.value AS bv, bp.num AS base, bp.m AS bm, cp.value AS cv, cp.num AS current, cp.m AS cm FROM bp FULL JOIN cp USING (n, base_row, row, base_col, col)),
ctx AS (SELECT n, CASE WHEN n % 3 = 0 THEN col ELSE row END AS place, dense_rank() OVER (PARTITION BY n ORDER BY m DESC) AS rk FROM ccells WHERE m IS NOT NULL),
f AS (
  SELECT j.*, CASE WHEN rk = 1 THEN 'current_period' WHEN rk <= 2 THEN 'recent_window' WHEN rk IS NOT NULL THEN 'historical' END AS context,
    CASE WHEN base IS NULL OR current IS NULL THEN NULL WHEN abs(current - base) <= 4 * (nextafter(greatest(abs(base), abs(current)), 'inf'::DOUBLE) - greatest(abs(base), abs(current))) THEN 'noise' ELSE 'material' END AS materiality
  FROM j LEFT JOIN ctx ON ctx.n = j.n AND n % 3 < 2 AND place = CASE WHEN j.n % 3 = 0 THEN col ELSE row END
  WHERE bv IS DISTINCT FROM cv OR base IS DISTINCT FROM current
)
SELECT {SHEET.replace("n AS", "f.n AS")} AS sheet, CAST(base_row AS BIGINT) AS base_row, CAST(base_col AS BIGINT) AS base_col, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, 'replacement' AS subtype, materiality, context AS temporal_context, CASE WHEN cm > bm THEN 'period_progression' END AS expected_reason, CASE WHEN materiality IS NOT NULL AND context IS NOT NULL THEN 'restatement' END AS segment FROM f
""".replace("LEFT JOIN ctx ON ctx.n = j.n AND n % 3 < 2", "LEFT JOIN ctx ON ctx.n = j.n AND j.n % 3 < 2"))  # fmt: skip
def cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed cells of paired rows and columns, classified."""
    b, c, pairs, axes = both(spark, sf_dir)
    found = celldiff.value_findings(celldiff.cell_pairs(b, c, pairs, axes), celldiff.recency(c))
    return found.where("finding_class = 'value_changed'").select("sheet", "base_row", "base_col", "row", "col", "subtype", "materiality", "temporal_context", "expected_reason", "segment")


@query(f"""
WITH {ALIGNED}, d AS (SELECT n, axis, base_index AS i FROM aligned WHERE event = 'deleted'), s AS (SELECT n, axis, current_index AS i FROM aligned WHERE event = 'inserted'), g AS (SELECT n, axis, current_index AS i FROM aligned WHERE event = 'growth'),
o AS (SELECT n, axis, bool_or(event = 'growth') AND NOT bool_or(event = 'inserted') AS sliding, bool_or(event = 'deleted') AS deletes FROM aligned GROUP BY 1, 2),
ev AS (
  SELECT n, axis, i, '_key_changed' AS what, 'key_replacement' AS subtype, NULL AS reason FROM d JOIN s USING (n, axis, i)
  UNION ALL SELECT d.n, d.axis, d.i, '_deleted', CASE WHEN sliding THEN 'rolling_turnover' ELSE 'physical_deletion' END, NULL FROM d JOIN o USING (n, axis) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n = d.n AND s.axis = d.axis AND s.i = d.i)
  UNION ALL SELECT s.n, s.axis, s.i, '_inserted', 'physical_insertion', NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE s.n = d.n AND s.axis = d.axis AND s.i = d.i)
  UNION ALL SELECT g.n, g.axis, g.i, '_growth', CASE WHEN sliding AND deletes THEN 'rolling_turnover' ELSE 'extent_growth' END, CASE WHEN sliding AND deletes THEN 'rolling_window' ELSE 'cadence_extension' END FROM g JOIN o USING (n, axis)
)
SELECT {SHEET} AS sheet, axis, CAST(i AS BIGINT) AS "index", CASE axis WHEN 'rows' THEN 'row' ELSE 'column' END || what AS finding_class, subtype, reason AS expected_reason FROM ev
""")
def axis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns that came, went, grew or changed their key in place."""
    b, c, pairs, axes = both(spark, sf_dir)
    return celldiff.axis_findings(axes, b, c).withColumnRenamed("id", "sheet")


#: Formulas of an order's row in both cycles, by what happens to them: kept, extended, another function, wrapped, a new reference, replaced by a value, removed.
FORMULAS = (
    ("=SUM(B{r}:D{r})", "=SUM(B{r}:D{r})"), ("=SUM(B$2:B{p})", "=SUM(B$2:B{r})"), ("=SUM(B{r}:D{r})", "=MAX(B{r}:D{r})"), ("=B{r}/C{r}", "=IFERROR(B{r}/C{r},0)"),
    ("=B{r}-C{r}", "=B{r}-C{r}-D{r}"), ("=B{r}*2", None), ("=B{r}*3", ""),
)


def formula_cells(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 2).alias("row"), (F.col("o_orderkey") % 7).alias("k"))
    written = F.lit(None).cast("string")
    for k, pair in enumerate(FORMULAS):
        text = pair[current]
        if text:
            parts = F.replace(F.replace(F.lit(text), F.lit("{r}"), F.col("row").cast("string")), F.lit("{p}"), (F.col("row") - 1).cast("string"))
            written = F.when(F.col("k") == k, parts).otherwise(written)
    empty = F.col("k") == (6 if current else -1)
    return o.where(~empty).select(F.lit("Orders").alias("sheet"), "row", F.lit(5).cast("long").alias("col"), F.lit("1").alias("value"), F.lit(1.0).alias("num"), F.lit("number").alias("vtype"), written.alias("formula"), F.lit(None).cast(periods.TYPE).alias("period"))


@query("""
SELECT CAST(o_orderkey + 2 AS BIGINT) AS row, CASE k WHEN 5 THEN 'formula_hardcoded' WHEN 6 THEN 'formula_removed' ELSE 'formula_logic_changed' END AS finding_class, CASE k WHEN 1 THEN 'range_extension' END AS expected_reason,
  CASE k WHEN 3 THEN 'wrapped' WHEN 4 THEN 'reference_added' END AS subtype, CASE k WHEN 3 THEN 'IFERROR' WHEN 4 THEN 'D' || CAST(o_orderkey + 2 AS VARCHAR) END AS detail
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders) o WHERE k > 0
""")
def formula_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each order's formula between the cycles."""
    b, c = formula_cells(spark, sf_dir, False), formula_cells(spark, sf_dir, True)
    side = lambda df, s: df.select(F.lit("Orders").alias("id"), "sheet", F.col("row").alias("base_row"), F.col("col").alias("base_col"), "row", "col", F.struct("value", "formula").alias(s))
    pairs = side(b, "b").join(side(c, "c"), ["id", "sheet", "base_row", "base_col", "row", "col"], "full_outer")
    return celldiff.formula_findings(pairs).select("row", "finding_class", "expected_reason", "subtype", "detail")
