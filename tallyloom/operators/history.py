"""Runs over time: decisions carried forward, fix progress, recurrence, dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(prior: DataFrame, current: DataFrame, identity: list[str], digest: str) -> DataFrame:
    """identity and status: exact (same digest), changed, resolved (gone), new, or ambiguous (an identity that occurs twice on a side)."""
    one = lambda df, s: df.groupBy(*identity).agg(F.count("*").alias(f"n_{s}"), F.min(digest).alias(f"d_{s}"))
    a, b = one(prior, "a").alias("a"), one(current, "b").alias("b")
    cond = F.lit(True)
    for k in identity:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    status = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "ambiguous").when(F.col("n_b").isNull(), "resolved").when(F.col("n_a").isNull(), "new").when(F.col("d_a").eqNullSafe(F.col("d_b")), "exact").otherwise("changed")
    return a.join(b, cond, "full_outer").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in identity], status.alias("status"))


def progress(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """Multiset difference by identity: fixed, remaining and introduced counts."""
    c = lambda df, n: df.groupBy(*identity).agg(F.count("*").alias(n))
    a, b = c(before, "x").alias("a"), c(after, "y").alias("b")
    cond = F.lit(True)
    for k in identity:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return a.join(b, cond, "full_outer").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in identity], F.greatest(x - y, F.lit(0)).alias("fixed"), F.least(x, y).alias("remaining"), F.greatest(y - x, F.lit(0)).alias("introduced"))


def recurring(runs: DataFrame, identity: list[str], *, finalized: int = 3, manual: int = 2) -> DataFrame:
    """Identities seen in so many finalized runs with one severity, of which so many were decided by hand."""
    d = runs.where("finalized").groupBy(*identity).agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("severity").alias("severities"), F.count_if("manual").alias("manual"))
    return d.where((F.col("runs") >= finalized) & (F.col("severities") == 1) & (F.col("manual") >= manual)).drop("severities")


def identities(columns: list[str]):
    """SHA-256 over the columns as JSON with null as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def carried_populations(members: DataFrame, decisions: DataFrame, population: str, location: str) -> DataFrame:
    """population and status of what its members (population, location) were decided before (location, severity, comment, finalized).

    unfinalized: some decision isn't final; partial: not all members have one; severity_conflict, comment_conflict; else inherited.
    """
    j = members.join(decisions, location, "left")
    d = j.groupBy(population).agg(F.count("*").alias("n"), F.count("severity").alias("decided"), F.count_if(F.col("severity").isNotNull() & ~F.col("finalized")).alias("open"), F.countDistinct("severity").alias("severities"), F.countDistinct("comment").alias("comments"))
    status = F.when(F.col("open") > 0, "unfinalized").when(F.col("decided") < F.col("n"), "partial").when(F.col("severities") > 1, "severity_conflict").when(F.col("comments") > 1, "comment_conflict").otherwise("inherited")
    return d.select(population, F.col("n").alias("members"), status.alias("status"))


def signoff(findings: DataFrame, coverage: DataFrame, acknowledged: DataFrame, run: list[str]) -> DataFrame:
    """run, undecided (critical or warning findings without a decision), required and missing acknowledgements of degraded or unavailable checks, ready.

    findings: run, severity, decided. coverage: run, check, state. acknowledged: run, check.
    """
    open_ = findings.groupBy(*run).agg(F.count_if(F.col("severity").isin("critical", "warning") & ~F.col("decided")).alias("undecided"))
    due = coverage.where(F.col("state").isin("degraded", "unavailable"))
    got = acknowledged.select(*run, "check").distinct().withColumn("_ok", F.lit(True))
    n = due.join(got, [*run, "check"], "left").groupBy(*run).agg(F.count("*").alias("required"), F.count_if(F.col("_ok").isNull()).alias("missing"))
    j = open_.join(n, run, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select(*run, zero("undecided").alias("undecided"), zero("required").alias("required"), zero("missing").alias("missing"), ((zero("undecided") == 0) & (zero("missing") == 0)).alias("ready"))


def review_seconds(sessions: DataFrame, run: str, now, most: int) -> DataFrame:
    """run and seconds of review: active seconds of closed sessions, and of open ones the time since their start, so many seconds at most."""
    since = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("started_at")
    seconds = F.when(F.col("ended_at").isNotNull(), F.coalesce("active_seconds", F.lit(0.0))).otherwise(F.greatest(F.lit(0), F.least(since, F.lit(most))).cast("double"))
    return sessions.groupBy(run).agg(F.sum(seconds).alias("seconds"))
