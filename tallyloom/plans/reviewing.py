"""Queries on findings: triage, groups, history, keys, privacy, events."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import numbers, periods, privacy
from tallyloom.operators import axes, history, keys, review, stored, triage
from tallyloom.plans.alignment import CHANGES, MONTHS, aligned_months
from tallyloom.plans.cycles import billed, booked, months, table
from tallyloom.streaming import arrivals, lifecycles

QUERIES, SQL = {}, {}

WAIVERS = [
    {"finding_class": "column_deleted", "sheet": "Months", "location": "C0000000007", "reason": "closed account", "expires": "2999-01-01"},
    {"finding_class": "column_inserted", "sheet": None, "location": "C0000000011", "reason": "late", "expires": "2000-01-01"},
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, base, current of orders on either side, with the context of their month among the customer's; unbooked ones have none.

    Contexts meet booked values before these meet billed ones, so all three are shuffled by key once.
    """
    o = months(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), "o_orderdate"), "o_orderdate")
    known = axes.context(o, ["customer"], recent=periods.RECENT["month"]).select("key", "context")
    b, c = booked(spark, sf_dir).select("key", F.col("value").alias("base")), billed(spark, sf_dir).select("key", F.col("value").alias("current"))
    return b.join(known, "key", "left").join(c, "key", "full_outer")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic findings of the cycle comparison: changed values, and months deleted, inserted or grown."""
    b, c = F.col("base"), F.col("current")
    v = with_context(spark, sf_dir).where(~b.eqNullSafe(c))
    none = F.lit(None).cast("string")
    place = lambda p, x: F.concat(F.lit(p), F.lpad(x.cast("string"), 10, "0"))
    values = v.select(
        F.lit("excel").alias("artifact"), F.lit("Orders").alias("sheet"), place("R", F.col("key")).alias("location"), F.lit("value").alias("element"), F.lit("value_changed").alias("finding_class"), none.alias("expected_reason"),
        numbers.materiality(b, c, numbers.matches(b, c, 1000.0, 0.02)).alias("materiality"), F.col("context").alias("temporal_context"), F.lit("changed").alias("provenance"),
        F.when(b.isNull(), "added").when(c.isNull(), "cleared").otherwise("replacement").alias("message"),
    )
    m = aligned_months(spark, sf_dir).where("event <> 'paired'")
    events = m.select(
        F.lit("excel").alias("artifact"), F.lit("Months").alias("sheet"), place("C", F.col("customer")).alias("location"), F.col("month").alias("element"),
        F.concat(F.lit("column_"), "event").alias("finding_class"), F.when(F.col("event") == "growth", "period_progression").alias("expected_reason"), none.alias("materiality"), F.lit("historical").alias("temporal_context"), F.lit("changed").alias("provenance"), F.col("event").alias("message"),
    )
    return values.unionByName(events)


FINDINGS = f"""
{CHANGES}, v AS (
  SELECT 'Orders' AS sheet, 'R' || lpad(CAST(key AS VARCHAR), 10, '0') AS location, 'value' AS element, 'value_changed' AS finding_class, NULL AS expected_reason,
    CASE WHEN base IS NULL OR current IS NULL THEN NULL WHEN abs(current - base) <= 4 * (nextafter(greatest(abs(base), abs(current)), 'inf'::DOUBLE) - greatest(abs(base), abs(current))) THEN 'noise' WHEN abs(current - base) <= 1000 OR abs(current - base) <= 0.02 * abs(base) THEN 'within_tolerance' ELSE 'material' END AS materiality,
    CASE WHEN r = 1 THEN 'current_period' WHEN r <= 2 THEN 'recent_window' WHEN r IS NOT NULL THEN 'historical' END AS context, CASE WHEN base IS NULL THEN 'added' WHEN current IS NULL THEN 'cleared' ELSE 'replacement' END AS message
  FROM ch LEFT JOIN (SELECT o_orderkey AS k, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) * 12 + month(o_orderdate) DESC) AS r FROM orders) z ON k = key WHERE base IS DISTINCT FROM current
), {MONTHS}, e AS (
  SELECT 'Months' AS sheet, 'C' || lpad(CAST(customer AS VARCHAR), 10, '0') AS location, strftime(make_date(CAST((m - 1) // 12 AS INT), CAST((m - 1) % 12 + 1 AS INT), 1), '%b-%Y') AS element, 'column_' || event AS finding_class,
    CASE WHEN event = 'growth' THEN 'period_progression' END AS expected_reason, NULL AS materiality, 'historical' AS context, event AS message FROM aligned WHERE event <> 'paired'
), a AS (
  SELECT *, CASE WHEN finding_class = 'column_deleted' AND location = 'C0000000007' THEN 'waiver' ELSE expected_reason END AS reason FROM (SELECT * FROM v UNION ALL SELECT * FROM e)
), f AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'expected' WHEN materiality IN ('noise', 'within_tolerance') THEN 'info' WHEN materiality = 'material' AND context IN ('current_period', 'recent_window') THEN 'warning' WHEN finding_class IN ('value_changed', 'column_deleted') THEN 'critical' ELSE 'warning' END AS severity FROM a
)"""


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = triage.waived(findings(spark, sf_dir), WAIVERS, "2026-01-01")
    return d.withColumn("severity", triage.severity())


@query(f"""
WITH {FINDINGS}, o AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, sheet, location, element, finding_class, message) AS n FROM f)
SELECT 'F' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS finding_id, severity, sheet, location, element, finding_class, reason AS expected_reason, materiality FROM o
""")
def cycle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two cycles aligned, compared, triaged, ordered and numbered."""
    return triage.ordered(triaged(spark, sf_dir)).select("finding_id", "severity", "sheet", "location", "element", "finding_class", "expected_reason", "materiality")


@query(f"WITH {FINDINGS} SELECT sheet, finding_class, materiality, message, count(*) AS members, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'expected') AS expected, min(location) AS first_location, max(location) AS last_location FROM f GROUP BY 1, 2, 3, 4")
def review_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by pattern, with counts by severity."""
    return review.patterns(triaged(spark, sf_dir), ["sheet", "finding_class", "materiality", "message"])


@query(f"WITH {FINDINGS} SELECT severity, sheet, count(*) AS members FROM f GROUP BY CUBE (severity, sheet)")
def severity_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and sheet, with all subtotals."""
    return review.subtotals(triaged(spark, sf_dir), ["severity", "sheet"])


@query(f"""
WITH {FINDINGS}, g AS (SELECT location, count(*) AS members, bool_or(severity = 'critical') AS has_critical, count(*) >= 10 AS many, bool_or(reason = 'waiver') AS waived FROM f GROUP BY 1)
SELECT location, members, CAST(100 * has_critical::INT + 10 * many::INT - 50 * waived::INT AS INT) AS score FROM (SELECT location, members, has_critical, many, coalesce(waived, false) AS waived FROM g)
""")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by place with a score of weighted signals."""
    g = triaged(spark, sf_dir).groupBy("location").agg(F.count("*").alias("members"), F.bool_or(F.col("severity") == "critical").alias("has_critical"), (F.count("*") >= 10).alias("many"), F.coalesce(F.bool_or(F.col("expected_reason") == "waiver"), F.lit(False)).alias("waived"))
    return review.priority(g, {"has_critical": 100, "many": 10, "waived": -50}).select("location", "members", "score")


@query("""
WITH c AS (SELECT l_suppkey AS supplier, l_returnflag AS flag, 'L' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS location, CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS ek, l_linenumber - l_linenumber AS shift FROM lineitem),
a AS (SELECT supplier, flag, count(*) AS members, min(ek) = max(ek) AS alike FROM c GROUP BY 1, 2), s AS (SELECT supplier, flag, list_sort(list(location ORDER BY location))[1:5] AS samples FROM c GROUP BY 1, 2)
SELECT supplier, flag, members, array_to_string(samples, ',') AS samples, CASE WHEN members < 10 THEN 'below_threshold' WHEN NOT alike THEN 'heterogeneous' ELSE 'population' END AS kind FROM a JOIN s USING (supplier, flag)
""")
def finding_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are one population, and why others aren't."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.concat(F.lit("L"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("location"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("event_key"), F.lit(0).alias("offset"),
    )
    return review.populations(c, ["supplier", "flag"]).withColumn("samples", F.array_join("samples", ","))


@query("SELECT l_partkey AS part, count(*) AS members, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def series_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose findings span several groups."""
    return review.series(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey"), ["part"], "l_suppkey")


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT c_custkey AS f, CAST(floor(c_acctbal / 20) AS BIGINT) AS token FROM customer UNION SELECT c_custkey, CAST(1000000 + c_custkey // 3 AS BIGINT) FROM customer WHERE c_nationkey < 5),
n AS (SELECT f, min(f) OVER (PARTITION BY token) AS m FROM l), e AS (SELECT f AS a, m AS b FROM n UNION SELECT m, f FROM n), t AS (SELECT a AS s, a AS b FROM e UNION SELECT t.s, e.b FROM t JOIN e ON t.b = e.a)
SELECT s AS customer, min(b) AS story FROM t GROUP BY 1
""")
def finding_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that share driver tokens, directly or through others, as stories."""
    c = table(spark, sf_dir, "customer")
    extra = F.when(F.col("c_nationkey") < 5, F.array(F.expr("1000000 + c_custkey div 3"))).otherwise(F.array().cast("array<bigint>"))
    d = c.select(F.col("c_custkey").alias("customer"), F.concat(F.array(F.floor(F.col("c_acctbal") / 20).cast("long")), extra).alias("tokens"))
    return review.stories(d, "customer", "tokens").select("customer", "story")


@query("""
WITH p AS (SELECT l_orderkey AS id, min(CAST(l_quantity AS BIGINT)) AS d, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), c AS (SELECT l_orderkey AS id, min(CAST(l_quantity AS BIGINT)) AS d, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1)
SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.n > 1 OR c.n > 1 THEN 'ambiguous' WHEN c.n IS NULL THEN 'resolved' WHEN p.n IS NULL THEN 'new' WHEN p.d = c.d THEN 'exact' ELSE 'changed' END AS status FROM p FULL JOIN c ON p.id = c.id
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each finding of the run before."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("long").alias("d"), "l_linenumber")
    return history.carried(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 3"), ["id"], "d")


@query("""
WITH a AS (SELECT l_partkey AS part, count(*) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS part, count(*) AS y FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT coalesce(a.part, b.part) AS part, greatest(coalesce(x, 0) - coalesce(y, 0), 0) AS fixed, least(coalesce(x, 0), coalesce(y, 0)) AS remaining, greatest(coalesce(y, 0) - coalesce(x, 0), 0) AS introduced FROM a FULL JOIN b ON a.part = b.part
""")
def fix_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed, remaining and introduced findings between two runs, as multisets."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag")
    return history.progress(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["part"])


@query("""
SELECT o_custkey AS customer, count(DISTINCT year(o_orderdate)) AS runs, count(*) FILTER (o_totalprice > 250000) AS manual FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
HAVING count(DISTINCT year(o_orderdate)) >= 3 AND count(DISTINCT o_orderstatus) = 1 AND count(*) FILTER (o_totalprice > 250000) >= 2
""")
def recurring_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that recur with one severity and were decided by hand."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("run_id"), F.col("o_orderstatus").alias("severity"), (F.col("o_orderstatus") != "P").alias("finalized"), (F.col("o_totalprice") > 250000).alias("manual"))
    return history.recurring(o, ["customer"])


COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("\nUNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM orders" for c in COLUMNS))
def key_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns are filled and distinct enough to be part of a key."""
    return keys.screen(table(spark, sf_dir, "orders"), COLUMNS)


PARTS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("\nUNION ALL ".join(
    f"SELECT '{'+'.join(c)}' AS key, count(*) AS rows, count(*) AS whole, count(DISTINCT ({', '.join(c)}{', 1' if len(c) == 1 else ''})) AS distinct_keys, count(DISTINCT ({', '.join(c)}{', 1' if len(c) == 1 else ''})) >= 0.995 * count(*) AS is_key FROM lineitem"
    for c in (["l_orderkey"], ["l_linenumber"], ["l_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"], ["l_linenumber", "l_partkey"], PARTS)
))
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which combinations of columns make a key."""
    return keys.combined(table(spark, sf_dir, "lineitem"), PARTS)


LATTICE = ("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", "half")
COMBINED = [c for k in (1, 2, 3) for c in combinations(LATTICE, k)]


def combination_sql(c: tuple[str, ...]) -> str:
    cols, whole = ", ".join(c), " AND ".join(f"{x} IS NOT NULL" for x in c)
    return f"""SELECT '{"+".join(c)}' AS key, {len(c)} AS size, least((SELECT sum(n) FROM x) / (SELECT count(*) FROM b), (SELECT sum(n) FROM y) / (SELECT count(*) FROM c)) AS coverage,
  least((SELECT count(*) FILTER (n = 1) / sum(n) FROM x), (SELECT count(*) FILTER (n = 1) / sum(n) FROM y)) AS uniqueness, count(*) / (SELECT (SELECT count(*) FILTER (n = 1) FROM x) + (SELECT count(*) FILTER (n = 1) FROM y)) AS half_overlap, count(*) AS common, count(*) FILTER (x.r <> y.r) AS moved
  FROM x JOIN y USING ({cols}) WHERE x.n = 1 AND y.n = 1""".join((f"SELECT * FROM (WITH x AS (SELECT {cols}, count(*) AS n, min(row) AS r FROM b WHERE {whole} GROUP BY ALL), y AS (SELECT {cols}, count(*) AS n, min(row) AS r FROM c WHERE {whole} GROUP BY ALL) ", ")"))


@query(f"""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS half FROM orders), b AS (SELECT *, o_orderkey AS row FROM o), c AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row FROM o WHERE o_orderkey % 50 > 0),
k AS ({" UNION ALL ".join(map(combination_sql, COMBINED))}), g AS (SELECT *, string_split(key, '+') AS parts FROM k WHERE coverage >= 0.95 AND uniqueness >= 0.995)
SELECT key, coverage, uniqueness, half_overlap / (1 - half_overlap) AS overlap, moved / greatest(common, 1) AS displaced FROM g WHERE NOT EXISTS (SELECT 1 FROM g s WHERE s.size < g.size AND list_has_all(g.parts, s.parts))
""")
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest combinations of columns that identify orders in two cycles, of which the current one is sorted by price."""
    o = table(spark, sf_dir, "orders").withColumn("half", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))
    now = stored.placed(o.where("o_orderkey % 50 > 0"), "row", F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
    return keys.discovered(o.withColumn("row", F.col("o_orderkey")), now, list(LATTICE), "row").select("key", "coverage", "uniqueness", "overlap", "displaced")


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT count(a.k) AS baseline_keys, count(b.k) AS current_keys, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) / count(*) AS overlap FROM a FULL JOIN b ON a.k = b.k
""")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the keys of two cycles overlap."""
    return keys.overlap(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("""
SELECT lang, CASE WHEN text IS NULL THEN 'none' WHEN length(text) = 0 THEN '0' WHEN length(text) <= 20 THEN '1-20' WHEN length(text) <= 80 THEN '21-80' WHEN length(text) <= 200 THEN '81-200' ELSE '201+' END AS bucket, count(*) AS texts FROM documents GROUP BY 1, 2
""")
def structure_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by length without their content."""
    return table(spark, sf_dir, "documents").groupBy("lang", privacy.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("texts"))


HEX = "list_reduce(list_transform(range(1, 17), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::HUGEINT), lambda a, b: a * 16 + b)"


@query(f"""
WITH d AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, sha256('41|customer|' || c_custkey) AS h FROM customer), f AS (SELECT *, 0.85::DOUBLE + CAST({HEX} AS DOUBLE) / pow(2::DOUBLE, 64) * 0.3::DOUBLE AS factor FROM d)
SELECT c_custkey AS key, 'TXT_' || substr(sha256('41|' || c_name || '|customer|' || c_custkey), 1, 6) AS pseudonym, CAST(round_even(c_nationkey * factor, 0) + CASE WHEN c_nationkey > 0 AND round_even(c_nationkey * factor, 0) = c_nationkey THEN 1 ELSE 0 END AS BIGINT) AS nation, abs(c_acctbal * factor - c_acctbal) <= 0.15 * abs(c_acctbal) + 1e-6 AS near FROM f
""")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as pseudonyms and numbers as others near them, by a seed and by place."""
    place = ("customer", F.col("c_custkey"))
    balance = F.col("c_acctbal")
    near = F.abs(privacy.scrambled(balance, 41, *place) - balance) <= 0.15 * F.abs(balance) + 1e-6
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), privacy.pseudonym(F.col("c_name"), 41, *place).alias("pseudonym"), privacy.scrambled(F.col("c_nationkey"), 41, *place, whole=True).alias("nation"), near.alias("near"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS events FROM events GROUP BY 1, 2, 3")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; the same function takes a stream."""
    return arrivals.by_window(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes").drop("total")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, user_id, count(*) AS events FROM s GROUP BY user_id, k
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end after six hours without an event."""
    return arrivals.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", "10 minutes")


@query("""
WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS identity, year(o_orderdate) AS run, o_orderstatus AS severity, o_orderpriority AS digest, o_orderstatus <> 'P' AS finalized, o_totalprice > 250000 AS manual FROM orders),
r AS (SELECT identity, run, count(*) AS n, min(digest) AS digest, bool_or(finalized) AS finalized, count(*) FILTER (finalized AND manual) AS manual, min(severity) FILTER (finalized) AS low, max(severity) FILTER (finalized) AS high FROM f GROUP BY 1, 2),
c AS (SELECT *, lag(run) OVER w AS before, lag(n) OVER w AS n0, lag(digest) OVER w AS d0, lead(run) OVER w AS after, CAST(sum(finalized::INT) OVER u AS BIGINT) AS runs, CAST(sum(manual) OVER u AS BIGINT) AS by_hand, min(low) OVER u AS lowest, max(high) OVER u AS highest
  FROM r WINDOW w AS (PARTITION BY identity ORDER BY run), u AS (PARTITION BY identity ORDER BY run ROWS UNBOUNDED PRECEDING))
SELECT identity, CAST(run AS BIGINT) AS run, CASE WHEN n > 1 OR (before = run - 1 AND n0 > 1) THEN 'ambiguous' WHEN before IS DISTINCT FROM run - 1 THEN 'new' WHEN d0 = digest THEN 'exact' ELSE 'changed' END AS status, runs, by_hand AS manual, coalesce(runs >= 3 AND by_hand >= 2 AND lowest = highest, false) AS recurring FROM c
UNION ALL SELECT identity, CAST(run + 1 AS BIGINT), CASE WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END, runs, by_hand, false FROM c WHERE after IS DISTINCT FROM run + 1 AND run < (SELECT max(run) FROM r)
""")
def finding_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each customer's finding in each year's run, read as a stream."""
    path = f"{sf_dir}/orders.parquet"
    o = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may also match a single file
    year = F.year("o_orderdate")
    d = o.select(F.col("o_custkey").cast("string").alias("identity"), year.alias("run"), F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"), F.col("o_orderstatus").alias("severity"), F.col("o_orderpriority").alias("digest"), (F.col("o_orderstatus") != "P").alias("finalized"), (F.col("o_totalprice") > 250000).alias("manual"))
    root = f"{stored.folder(spark)}/tallyloom/stream-{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycles.ROCKS)
    try:
        q = lifecycles.lifecycles(d).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(lifecycles.OUT).parquet(f"{root}/out")
