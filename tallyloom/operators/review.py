"""Projections of findings: patterns, populations, series, stories, priority. Each is a partition of the findings, never a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.graph import connected
from tallyloom.operators.stored import numbered, stored

SEVERITIES = ("critical", "warning", "info", "expected")


def counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def patterns(findings: DataFrame, key: list[str]) -> DataFrame:
    """A row for each pattern (null is a value): members, counts by severity, the first and last location.

    Least and greatest texts alone would have Spark sort all findings by pattern; with a set beside them it keeps patterns in a hash map.
    """
    d = findings.groupBy(*key).agg(F.count("*").alias("members"), F.collect_set("severity").alias("_kinds"), *counts(), F.min("location").alias("first_location"), F.max("location").alias("last_location"))
    seen = {s: F.when(F.array_contains("_kinds", s), F.col(s)).otherwise(0).alias(s) for s in SEVERITIES}
    return d.select(*[seen.get(c, F.col(c)) for c in d.columns if c != "_kinds"])


def populations(candidates: DataFrame, key: list[str], threshold: int = 10) -> DataFrame:
    """A row for each key: members, the five smallest locations, kind: population, or why its members stay atomic (below_threshold, heterogeneous).

    heterogeneous: members differ in event_key, or in the offset between baseline and current rows.
    """
    one_event = F.min("event_key").eqNullSafe(F.max("event_key")) & ((F.count("event_key") == 0) | (F.count("event_key") == F.count("*")))
    agg = candidates.groupBy(*key).agg(F.count("*").alias("members"), (one_event & F.min("offset").eqNullSafe(F.max("offset"))).alias("alike"))
    w = Window.partitionBy(*key).orderBy("location")
    top = candidates.withColumn("_n", F.row_number().over(w)).where("_n <= 5").groupBy(*key).agg(F.sort_array(F.collect_list("location")).alias("samples"))
    kind = F.when(F.col("members") < threshold, "below_threshold").when(~F.col("alike"), "heterogeneous").otherwise("population")
    return agg.join(top, key).withColumn("kind", kind).drop("alike")


def priority(groups: DataFrame, weights: dict[str, int]) -> DataFrame:
    """groups with score: the sum of the weights of its signals (boolean columns); a permutation key, nothing is dropped."""
    score = F.lit(0)
    for s, w in weights.items():
        score = score + F.when(F.col(s), w).otherwise(0)
    return groups.withColumn("score", score)


def series(findings: DataFrame, series_key: list[str], group: str) -> DataFrame:
    """Series that span two groups or more: members and groups."""
    return findings.groupBy(*series_key).agg(F.count("*").alias("members"), F.countDistinct(group).alias("groups")).where("groups >= 2")


def stories(findings: DataFrame, finding: str, tokens: str) -> DataFrame:
    """story (its smallest finding) of each finding: findings that share a driver token are one story; one without tokens is its own.

    Findings link to the smallest finding of each of their tokens, so a token of many findings costs one link each.
    """
    each = findings.select(F.col(finding).alias("f"), F.explode(tokens).alias("token")).distinct()
    first = each.groupBy("token").agg(F.min("f").alias("m"))
    part = connected(each.join(first, "token").select(F.col("f").alias("a"), F.col("m").alias("b")))
    return findings.join(part.withColumnRenamed("id", finding), finding, "left").withColumn("story", F.coalesce("part", finding)).drop("part")


def subtotals(findings: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by every combination of the columns."""
    return findings.cube(*columns).agg(F.count("*").alias("members"))


# Weights of what a group's findings show, tiers that defer a group, members that make one wide, evidence lines of a story.
WEIGHTS = {
    "critical": 1000, "warning": 400, "info": 50, "material": 300, "historical": 250, "new": 200, "impacts": 150, "residual": 120, "wide": 80,
    "inherited": -200, "noise": -300, "tolerated": -250, "story": -100,
}
DEFERRED, WIDE, EVIDENCE = {"reviewed": 1, "waived": 2, "expected": 3}, 25, 8


def grouped(findings: DataFrame, key: list[str]) -> DataFrame:
    """Spatial review groups: findings (sheet, row, col, key) of one key that touch are one group; those without a place are groups of their own.

    Gives key, sheet, box, members.
    """
    from tallyloom.operators.regions import components

    tag = F.to_json(F.struct("sheet", *key), {"ignoreNullFields": "false"})
    placed = findings.where("row is not null and col is not null").withColumn("_sheet", tag)
    boxes = components(placed.select("_sheet", "row", "col").distinct(), "_sheet", "row", "col")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.select("sheet", *key).schema)
    told = boxes.withColumn("_k", F.from_json("_sheet", kinds)).select("_k.*", "min_row", "max_row", "min_col", "max_col", F.col("cells").alias("members"))
    alone = findings.where("row is null or col is null").select("sheet", *key, *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("min_row", "max_row", "min_col", "max_col")], F.lit(1).cast(told.schema["members"].dataType).alias("members"))
    return told.unionByName(alone)


def ranked_groups(findings: DataFrame, group: str) -> DataFrame:
    """group, members, score, tier, rank: by tier of deferral, then by the weights of what its findings show, then by group.

    findings: severity, materiality, temporal_context, provenance, reviewed, waived (boolean), and if known impacts (how many
    cells depend on it) and story (null: none explains it). A group is deferred if any member is reviewed, waived or expected;
    noise and tolerance are told by the members that have a materiality.
    """
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    is_ = lambda c, v: F.col(c) == v
    for c, kind in (("impacts", "long"), ("story", "string")):
        findings = findings if c in findings.columns else findings.withColumn(c, F.lit(None).cast(kind))
    tiers = lambda m: F.coalesce(F.bool_and(is_("materiality", m)), F.lit(False)).alias({"noise": "noise", "within_tolerance": "tolerated"}[m])
    d = findings.groupBy(group).agg(
        F.count("*").alias("members"), *[has(is_("severity", s)).alias(s) for s in ("critical", "warning", "info")], has(is_("materiality", "material")).alias("material"), has(is_("temporal_context", "historical")).alias("historical"),
        has(is_("provenance", "new")).alias("new"), F.bool_and(F.coalesce(is_("provenance", "inherited"), F.lit(False))).alias("inherited"), tiers("noise"), tiers("within_tolerance"), has(F.col("impacts") > 0).alias("impacts"), has(F.col("story").isNotNull()).alias("story"),
        has(F.col("reviewed")).alias("_reviewed"), has(F.col("waived")).alias("_waived"), has(is_("severity", "expected")).alias("_expected"),
    ).withColumn("wide", F.col("members") >= WIDE).withColumn("residual", ~F.col("story"))
    score = F.lit(0)
    for s, w in WEIGHTS.items():
        score = score + F.when(F.col(s), w).otherwise(0) if s in d.columns else score
    tier = F.when(F.col("_expected"), DEFERRED["expected"]).when(F.col("_waived"), DEFERRED["waived"]).when(F.col("_reviewed"), DEFERRED["reviewed"]).otherwise(0)
    d = stored(d.select(group, "members", score.alias("score"), tier.alias("tier")), "groups")
    place = F.struct("tier", (-F.col("score")).alias("_s"), group)
    n = numbered(d.select(place.alias("_place")), "_place").select(F.col("_place"), (F.col("n") + 1).alias("rank"))
    return d.withColumn("_place", place).join(n, "_place").drop("_place")


def decided(findings: DataFrame, decisions: DataFrame, group: str) -> DataFrame:
    """findings with the decision of their group (group, severity, comment): members that were decided by hand (manual) keep their own."""
    j = findings.join(decisions.select(group, F.col("severity").alias("_severity"), F.col("comment").alias("_comment")), group, "left")
    apply = F.col("_severity").isNotNull() & ~F.col("manual")
    return j.withColumn("severity", F.when(apply, F.col("_severity")).otherwise(F.col("severity"))).withColumn("comment", F.when(apply, F.col("_comment")).otherwise(F.col("comment"))).drop("_severity", "_comment")


def shape_digest(before: str, after: str):
    """A digest of what a change does to the shape of texts, figures blanked: equal for the same edit at many places."""
    from tallyloom.functions.numbers import skeleton

    return F.sha2(F.to_json(F.struct(skeleton(F.coalesce(F.col(before), F.lit(""))).alias("b"), skeleton(F.coalesce(F.col(after), F.lit(""))).alias("a"))), 256)


def told_stories(findings: DataFrame, story: str, title: str, evidence: str) -> DataFrame:
    """story, title (of its first finding), members, counts by severity, and at most EVIDENCE lines of evidence, by finding."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(story).orderBy("finding"))
    d = findings.withColumn("_n", n)
    lines = d.where(F.col("_n") <= EVIDENCE).groupBy(story).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", evidence))), lambda x: x[evidence]).alias("evidence"))
    return d.groupBy(story).agg(F.min_by(title, "finding").alias("title"), F.count("*").alias("members"), *counts()).join(lines, story)


def represented(rows: DataFrame) -> DataFrame:
    """How many decisions a review asks for, and how many findings they stand for (member_count, null: one)."""
    return rows.agg(F.count("*").alias("decisions"), F.sum(F.coalesce("member_count", F.lit(1))).cast("long").alias("findings"))
