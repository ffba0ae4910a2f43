"""Queries on decks, packages, review and history, on the driver's tables as if they were those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers, periods, privacy
from tallyloom.operators import controls, coverage, decks, graph, history, keys, packages, review, triage
from tallyloom.plans.cycles import AXIS, axis, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A deck table for each supplier: nations across, order years down; the current one has a year more and, for some, a column less.
@query("""
WITH b AS (SELECT s_suppkey AS slide, r AS row, c AS col, CASE WHEN r = 0 AND c > 0 THEN CAST(2019 + c AS VARCHAR) || '-0' || CAST(c AS VARCHAR) ELSE CAST((s_suppkey * r + c) % 50 AS VARCHAR) END AS text FROM supplier, range(0, 4) x(r), range(0, 4) y(c)),
c AS (SELECT s_suppkey AS slide, r AS row, c AS col, CASE WHEN r = 0 AND c > 0 THEN CAST(2019 + c AS VARCHAR) || '-0' || CAST(c AS VARCHAR) ELSE CAST((s_suppkey * r + c) % 49 AS VARCHAR) END AS text FROM supplier, range(0, 5) x(r), range(0, 5) y(c) WHERE r < 3 + s_suppkey % 3 AND c < 4 + s_suppkey % 2),
s AS (SELECT slide, max(row) + 1 AS rows, max(col) + 1 AS cols FROM c GROUP BY 1)
SELECT b.slide, CAST(b.row AS INT) AS row, CAST(b.col AS INT) AS col, 'ppt_table_changed' AS finding_class, NULL AS expected_reason FROM b JOIN c USING (slide, row, col) WHERE b.text <> c.text
UNION ALL SELECT slide, 4, NULL, 'ppt_table_row_added', NULL FROM s WHERE rows > 4 UNION ALL SELECT slide, 3, NULL, 'ppt_table_row_removed', NULL FROM s WHERE rows < 4
UNION ALL SELECT slide, NULL, 4, 'ppt_table_column_added', 'cadence_extension' FROM s WHERE cols > 4
""")
def deck_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of slides' tables that changed, and rows and columns that came or went."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide"))

    def grid(n: int, mod: int) -> DataFrame:
        d = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        head = F.concat((2019 + F.col("col")).cast("string"), F.lit("-0"), F.col("col").cast("string"))
        d = d.withColumn("text", F.when((F.col("row") == 0) & (F.col("col") > 0), head).otherwise(((F.col("slide") * F.col("row") + F.col("col")) % mod).cast("string")))
        return periods.with_period(d, "text", "period")

    now = grid(5, 49).where((F.col("row") < 3 + F.col("slide") % 3) & (F.col("col") < 4 + F.col("slide") % 2))
    return decks.table_changes(grid(4, 50), now, ["slide"])


@query("SELECT lower(trim(split_part(text, ' ', 1))) AS title, count(*) AS slides FROM conversations WHERE trim(split_part(coalesce(text, ''), ' ', 1)) <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_slide_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of turns, as slide titles, that occur more than once."""
    return decks.duplicate_titles(table(spark, sf_dir, "conversations").select(F.substring_index(F.coalesce("text", F.lit("")), " ", 1).alias("title")))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS slide, t AS token FROM part, (VALUES ('TBD'), ('draft')) v(t)
WHERE regexp_matches(CASE p_partkey % 4 WHEN 0 THEN 'Revenue (tbd) ' WHEN 1 THEN 'drafted plan ' WHEN 2 THEN 'A Draft, TBD' ELSE 'final ' END || CAST(p_size AS VARCHAR), '(?i)(^|[^\\w])' || t || '([^\\w]|$)')
""")
def draft_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides that still hold an unfinished token."""
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, "Revenue (tbd) ").when(k == 1, "drafted plan ").when(k == 2, "A Draft, TBD").otherwise("final ")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("slide"), F.concat(body, F.col("p_size").cast("string")).alias("text"))
    return decks.draft_tokens(p, "text", ["TBD", "draft"]).select("slide", "token")


@query("""
WITH c AS (SELECT o_custkey AS slide, year(o_orderdate) - 1991 AS row, quarter(o_orderdate) AS col, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT DISTINCT slide, row FROM c)
SELECT slide, CAST(row AS INT) AS row, CAST(q AS INT) AS col FROM g, range(1, 5) t(q) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.slide = g.slide AND c.row = g.row AND c.col = q)
""")
def blank_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters without an order in years that have one: blank cells of populated table rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slide"), (F.year("o_orderdate") - 1991).alias("row"), F.quarter("o_orderdate").alias("col"))
    n = o.groupBy("slide", "row", "col").agg(F.count("*").cast("string").alias("text"))
    every = o.select("slide").distinct().withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return decks.blank_cells(every.join(n, ["slide", "row", "col"], "left"), ["slide"]).select("slide", "row", "col")


@query("""
WITH b AS (SELECT l_suppkey AS slide, CAST(l_linenumber AS VARCHAR) AS digest, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), c AS (SELECT l_suppkey AS slide, CAST(l_linenumber AS VARCHAR) AS digest, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT slide, digest, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS event, abs(d) AS pictures FROM (SELECT slide, digest, coalesce(c.n, 0) - coalesce(b.n, 0) AS d FROM b FULL JOIN c USING (slide, digest)) x WHERE d <> 0
""")
def media_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of slides that came or went, as multisets."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slide"), F.col("l_linenumber").cast("string").alias("digest"), "l_returnflag")
    return decks.media_changes(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "slide")


@query("""
WITH b AS (SELECT o_custkey AS chart, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
c AS (SELECT o_custkey AS chart, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders GROUP BY 1, 2),
l AS (SELECT chart, max(m) AS last FROM b GROUP BY 1), j AS (SELECT coalesce(b.chart, c.chart) AS chart, coalesce(b.m, c.m) AS m, b.v AS bv, c.v AS cv FROM b FULL JOIN c ON b.chart = c.chart AND b.m = c.m)
SELECT j.chart, strftime(make_date(CAST(m // 12 AS INT), CAST(m % 12 + 1 AS INT), 1), '%b-%Y') AS label, CAST(0 AS INT) AS occurrence, CASE WHEN bv IS NULL THEN 'added' WHEN cv IS NULL THEN 'removed' ELSE 'changed' END AS event, CASE WHEN bv IS NULL AND m > last THEN 'cadence_extension' END AS expected_reason
FROM j LEFT JOIN l ON l.chart = j.chart WHERE bv IS DISTINCT FROM cv
""")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of deck charts that came, went or changed; a later month is expected."""
    o = table(spark, sf_dir, "orders")

    def points(d: DataFrame) -> DataFrame:
        p = d.groupBy(F.col("o_custkey").alias("chart"), F.trunc("o_orderdate", "month").alias("place")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("value"))
        return periods.with_period(p.withColumn("label", F.date_format("place", "MMM-yyyy")), "label", "period")

    return decks.category_changes(points(o.where("o_orderstatus <> 'P'")), points(o), ["chart"])


@query(f"""
WITH a AS ({AXIS}), d AS (SELECT DISTINCT m, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS source FROM a JOIN customer ON customer = c_custkey)
SELECT d.m, last, string_agg(source, '; ' ORDER BY source) AS sources FROM d, (SELECT max(m) AS last FROM a) x WHERE d.m <> last GROUP BY 1, 2
""")
def period_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporting periods of a deck (a slide for each nation, with the months of its customers' orders) that aren't the workbook's latest."""
    a = axis(spark, sf_dir)
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("source"))
    deck = a.join(nation, "customer").select("period.kind", "period.k1", "period.k2", "period.k3", "source").distinct()
    latest = packages.latest_periods(a, [])
    found = packages.period_mismatches(latest, deck)
    month = periods.parse_period(F.col("expected"))
    return found.select((F.col("k1") * 12 + F.col("k2")).cast("long").alias("m"), (month["k1"] * 12 + month["k2"]).cast("long").alias("last"), "sources")


@query("""
WITH g AS (SELECT l_suppkey AS member, l_orderkey * 10 + l_linenumber AS figure_id, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
f AS (SELECT member, figure_id, CASE WHEN s = 'O' THEN NULL WHEN f = 'R' THEN 'mismatch' WHEN f = 'A' THEN 'unresolved' ELSE 'verified' END AS status FROM g)
SELECT member, count(*) AS figures, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status IS NULL) AS unmapped,
  CASE WHEN count(*) FILTER (status IS NULL) = count(*) THEN 'unavailable' WHEN count(*) FILTER (status IS NULL OR status = 'unresolved') > 0 THEN 'degraded' ELSE 'checked' END AS state FROM f GROUP BY 1
""")
def package_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each member's figures stand against their cells."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("member"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("figure_id")).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    status = F.when(F.col("l_returnflag") == "R", "mismatch").when(F.col("l_returnflag") == "A", "unresolved").otherwise("verified")
    return packages.reconciled(f.where("l_linestatus <> 'O'").select("member", "figure_id", status.alias("status")), f, ["member"])


ERRORS = """
SELECT l_orderkey AS k, l_linenumber AS n, list_extract(['new', 'changed', 'inherited'], CAST(l_orderkey % 3 AS INT) + 1) AS provenance, l_linenumber = 1 AS structural, l_linenumber = 2 AS na, l_suppkey % 2 = 0 AS txt, l_linenumber > 3 AS presence, l_partkey % 2 = 0 AS mass FROM lineitem"""


@query(f"""
WITH e AS ({ERRORS})
SELECT k, n, CASE WHEN structural OR provenance IN ('new', 'changed') THEN 'critical' WHEN provenance = 'inherited' AND na AND txt THEN 'info' WHEN presence AND mass THEN 'warning' ELSE 'critical' END AS severity FROM e
""")
def error_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of formula errors by where they come from and what is proved of them."""
    li = table(spark, sf_dir, "lineitem")
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array_compact(F.array(tag(F.col("l_linenumber") == 1, "structural_error"), tag(F.col("l_linenumber") == 2, "explicit_na"), tag(F.col("l_suppkey") % 2 == 0, "formula_text"), tag(F.col("l_linenumber") > 3, "formula_presence"), tag(F.col("l_partkey") % 2 == 0, "contiguous_population")))
    provenance = F.get(F.array(*map(F.lit, ("new", "changed", "inherited"))), (F.col("l_orderkey") % 3).cast("int"))
    none = F.lit(None).cast("string")
    d = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.lit("formula_error").alias("finding_class"), none.alias("expected_reason"), none.alias("materiality"), none.alias("temporal_context"), provenance.alias("provenance"), tags.alias("evidence_tags"))
    return d.select("k", "n", triage.severity(evidence=True).alias("severity"))


@query("""
WITH g AS (SELECT o_custkey AS g, count(*) AS members, bool_or(o_totalprice > 400000) AS critical, bool_or(o_totalprice BETWEEN 100000 AND 400000) AS warning, bool_or(o_orderstatus = 'F') AS material, bool_or(o_orderpriority = '1-URGENT') AS fresh, bool_and(o_orderpriority = '5-LOW') AS inherited, bool_or(o_orderstatus = 'P') AS waived, bool_or(o_orderkey % 9 = 0) AS story, bool_or(o_orderkey % 4 = 1) AS impacts FROM orders GROUP BY 1),
s AS (SELECT g AS customer, members, CAST(1000 * critical::INT + 400 * warning::INT + 300 * material::INT + 200 * fresh::INT + 150 * impacts::INT - 100 * story::INT + 120 * (NOT story)::INT - 200 * inherited::INT + 80 * (members >= 25)::INT AS INT) AS score, CASE WHEN waived THEN 2 ELSE 0 END AS tier FROM g)
SELECT *, row_number() OVER (ORDER BY tier, score DESC, customer) AS rank FROM s
""")
def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review groups by what their findings show, deferred ones marked."""
    o = table(spark, sf_dir, "orders")
    d = o.select(
        F.col("o_custkey").alias("customer"), F.when(F.col("o_totalprice") > 400000, "critical").when(F.col("o_totalprice") >= 100000, "warning").otherwise("other").alias("severity"), F.when(F.col("o_orderstatus") == "F", "material").alias("materiality"),
        F.lit("recent_window").alias("temporal_context"), F.when(F.col("o_orderpriority") == "1-URGENT", "new").when(F.col("o_orderpriority") == "5-LOW", "inherited").otherwise("changed").alias("provenance"), F.lit(False).alias("reviewed"), (F.col("o_orderstatus") == "P").alias("waived"),
        F.when(F.col("o_orderkey") % 9 == 0, "S1").alias("story"), F.when(F.col("o_orderkey") % 4 == 1, 3).otherwise(0).alias("impacts"),
    )
    return review.ranked_groups(d, "customer")


@query("""
WITH m AS (SELECT l_suppkey AS population, l_orderkey AS location FROM lineitem WHERE l_linenumber = 1), d AS (SELECT o_orderkey AS location, o_orderstatus AS severity, CASE WHEN o_orderkey % 50 = 0 THEN 'odd' ELSE 'ok' END AS comment, o_orderkey % 40 <> 1 AS finalized FROM orders WHERE o_orderkey % 30 <> 7),
g AS (SELECT population, count(*) AS members, count(severity) AS decided, count(*) FILTER (severity IS NOT NULL AND NOT finalized) AS open, count(DISTINCT severity) AS s, count(DISTINCT comment) AS c FROM m LEFT JOIN d USING (location) GROUP BY 1)
SELECT population, members, CASE WHEN open > 0 THEN 'unfinalized' WHEN decided < members THEN 'partial' WHEN s > 1 THEN 'severity_conflict' WHEN c > 1 THEN 'comment_conflict' ELSE 'inherited' END AS status FROM g
""")
def carried_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a population's members were decided alike before."""
    m = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("population"), F.col("l_orderkey").alias("location"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = o.where(k % 30 != 7).select(k.alias("location"), F.col("o_orderstatus").alias("severity"), F.when(k % 50 == 0, "odd").otherwise("ok").alias("comment"), (k % 40 != 1).alias("finalized"))
    return history.carried_populations(m, d, "population", "location")


@query("""
WITH f AS (SELECT o_custkey AS run, count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'O') AS undecided FROM orders GROUP BY 1), c AS (SELECT c_custkey AS run, CASE c_nationkey % 3 WHEN 0 THEN 'checked' WHEN 1 THEN 'degraded' ELSE 'unavailable' END AS state, c_acctbal > 0 AS ok FROM customer)
SELECT coalesce(f.run, c.run) AS run, coalesce(undecided, 0) AS undecided, CAST(coalesce(state <> 'checked', false) AS BIGINT) AS required, CAST(coalesce(state <> 'checked' AND NOT ok, false) AS BIGINT) AS missing, coalesce(undecided, 0) = 0 AND NOT coalesce(state <> 'checked' AND NOT ok, false) AS ready
FROM f FULL JOIN (SELECT * FROM c WHERE state <> 'checked') c ON f.run = c.run
""")
def signoff_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still stands against signing each run off."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    findings = o.select(F.col("o_custkey").alias("run"), F.when(F.col("o_totalprice") > 200000, "critical").otherwise("info").alias("severity"), (F.col("o_orderstatus") != "O").alias("decided"))
    n = F.col("c_nationkey") % 3
    checks = c.select(F.col("c_custkey").alias("run"), F.lit("values").alias("check"), F.when(n == 0, "checked").when(n == 1, "degraded").otherwise("unavailable").alias("state"))
    return history.signoff(findings, checks, c.where("c_acctbal > 0").select(F.col("c_custkey").alias("run"), F.lit("values").alias("check")), ["run"])


@query("""
SELECT user_id, CAST(sum(CASE WHEN event_id % 5 > 0 THEN value ELSE greatest(0, least(600, date_diff('second', date_trunc('second', ts), TIMESTAMP '2030-01-01 00:00:00'))) END) AS DOUBLE) AS seconds FROM (SELECT user_id, event_id, ts, CAST(event_id % 90 AS DOUBLE) AS value FROM events) e GROUP BY 1
""")
def review_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of review by run: closed sessions' active time, open ones' time so far within a bound."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    d = e.select("user_id", F.col("ts").cast("timestamp").alias("started_at"), F.when(k % 5 > 0, F.col("ts")).alias("ended_at"), (k % 90).cast("double").alias("active_seconds"))
    return history.review_seconds(d, "user_id", "2030-01-01 00:00:00", 600)


@query("""
WITH f AS (SELECT c_nationkey AS member, count(*) * 2000 AS formulas, count(*) * 50000 AS operands, count(*) * 2000000 AS edges, count(*) * 100 AS rules FROM customer GROUP BY 1),
l AS (SELECT member, formulas >= 500000 OR edges >= 250000000 AS skip, unnest([{'m': 'formulas', 'v': formulas, 'w': 75000, 'r': 400000}, {'m': 'operands', 'v': operands, 'w': 1500000, 'r': 8000000}, {'m': 'edges', 'v': edges, 'w': 40000000, 'r': 250000000}, {'m': 'rules', 'v': rules, 'w': 5000, 'r': 40000}]) AS x FROM f)
SELECT member, x.m AS measure, CAST(x.v AS BIGINT) AS value, CASE WHEN x.v >= x.r THEN 'refuse' WHEN x.v >= x.w THEN 'warn' ELSE 'ok' END AS verdict, skip AS dependencies_skipped FROM l
""")
def formula_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What members' formulas would need, against the limits."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("member")).agg(F.count("*").alias("n"))
    return coverage.complexity(n.select("member", *[(F.col("n") * k).alias(c) for c, k in (("formulas", 2000), ("operands", 50_000), ("edges", 2_000_000), ("rules", 100))]), ["member"])


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, lead(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT a, b FROM o WHERE b IS NOT NULL AND a % 5 > 0 UNION SELECT a, c FROM o WHERE c IS NOT NULL AND a % 3 = 0), t AS (SELECT a AS s, b AS r FROM e UNION SELECT t.s, e.b FROM t JOIN e ON t.r = e.a),
n AS (SELECT s, r, row_number() OVER (PARTITION BY s ORDER BY r) AS k FROM t)
SELECT s AS start, array_to_string(list(r ORDER BY r) FILTER (k <= 25), ',') AS impacts, greatest(count(*) - 25, 0) AS more FROM n GROUP BY 1
""")
def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each order's cell, directly or through others: the first few, and how many more. A customer's next order reads most orders, the one after it some."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.lead("o_orderkey", 2).over(w).alias("c"))
    edges = o.where("b is not null and a % 5 > 0").select("a", "b").unionByName(o.where("c is not null and a % 3 = 0").select("a", F.col("c").alias("b")))
    found = graph.affected(o.select(F.col("a").alias("id")), edges)
    return graph.impacts(found).withColumn("impacts", F.array_join("impacts", ","))


@query("""
SELECT 'o_orderkey' AS name, false AS is_sequence UNION ALL SELECT 'o_custkey', false UNION ALL SELECT 'place', true UNION ALL SELECT 'constant', false
""")
def key_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns only number the rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 2 + 5).alias("place"), F.lit(1).alias("constant"))
    return keys.sequences(o.withColumn("o_orderkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(97))).withColumn("_place", (F.col("place") - 5) / 2), ["o_orderkey", "o_custkey", "place", "constant"], "_place")


@query("""
SELECT CAST(c_custkey AS BIGINT) AS row, concat_ws(',', CASE WHEN c_custkey % 9 = 0 THEN 'name' END, CASE WHEN c_custkey % 4 = 0 THEN 'segment' END) AS blank FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 4 = 0
""")
def blank_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose identity key has a blank part, which would stop a run."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    d = c.select(k.cast("long").alias("row"), F.when(k % 9 != 0, F.col("c_name")).alias("name"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return controls.blank_keys(d, ["name", "segment"], "row").withColumn("blank", F.array_join("blank", ","))


@query("""
WITH b AS (SELECT DISTINCT c_nationkey AS s, CAST(c_nationkey % 4 AS VARCHAR) AS d, 10 + c_nationkey AS n FROM customer WHERE c_nationkey < 20), c AS (SELECT DISTINCT c_nationkey AS s, CAST(c_nationkey % 6 AS VARCHAR) AS d, 12 AS n FROM customer WHERE c_nationkey > 3)
SELECT coalesce(b.s, c.s) AS sheet, CASE WHEN b.s IS NULL THEN 'added' WHEN c.s IS NULL THEN 'removed' WHEN b.d = c.d THEN 'identical' ELSE 'changed' END AS state, CAST(CASE WHEN b.d = c.d THEN 0 ELSE greatest(coalesce(b.n, 0), coalesce(c.n, 0)) END AS BIGINT) AS most_findings FROM b FULL JOIN c ON b.s = c.s
""")
def projected_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most findings that each sheet's change can give."""
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet")).distinct()
    k = F.col("sheet")
    return privacy.projected_volume(n.where(k < 20).select("sheet", (k % 4).cast("string").alias("part_digest"), (10 + k).alias("cells")), n.where(k > 3).select("sheet", (k % 6).cast("string").alias("part_digest"), F.lit(12).alias("cells")))


@query("""
SELECT o_orderkey AS key, '$' || CAST(o_orderkey % 90 AS VARCHAR) || '.' || CAST(o_custkey % 10 AS VARCHAR) || 'k' AS shown, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) || ',' || strftime(o_orderdate, '%b-%Y') AS periods FROM orders
""")
def figures_and_periods_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value in the style of another figure, and the periods that a sentence names."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = (k % 90).cast("double") * 1000 + (F.col("o_custkey") % 10) * 100
    figure = F.get(numbers.figures(F.lit("about $1.5k now")), 0)
    text = F.concat(F.lit("Results of Q"), F.quarter("o_orderdate").cast("string"), F.lit(" (until "), F.date_format("o_orderdate", "MMM-yyyy"), F.lit(") rose by 5 units"))
    return o.select(k.alias("key"), numbers.shown_like(figure, value).alias("shown"), F.array_join(F.transform(periods.in_text(text), lambda p: p["label"]), ",").alias("periods"))
