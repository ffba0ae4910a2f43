"""Several members, several artifacts: what is reconciled between them, and how their results become one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_periods(labels: DataFrame, by: list[str]) -> DataFrame:
    """by, kind and the latest period of each kind."""
    key = F.struct("period.k1", "period.k2", "period.k3", "period.label")
    return labels.where("period is not null").groupBy(*by, F.col("period.kind").alias("kind")).agg(F.max(key).alias("latest"))


def period_mismatches(workbook: DataFrame, deck: DataFrame) -> DataFrame:
    """Reporting periods of a deck (kind, k1, k2, k3, source) that aren't the workbook's latest of their kind: the latest's label, and the sources."""
    own = deck.groupBy("kind", "k1", "k2", "k3").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))
    j = own.join(workbook, "kind").where((F.col("k1") != F.col("latest.k1")) | (F.col("k2") != F.col("latest.k2")) | (F.col("k3") != F.col("latest.k3")))
    return j.select("kind", "k1", "k2", "k3", F.col("latest.label").alias("expected"), "sources")


def reconciled(statuses: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """by and how its figures stand: mapped ones by status, those without a mapping, and the state of the check.

    statuses: by, figure_id, status (verified, mismatch, unresolved). degraded: some can't be judged; unavailable: none is mapped.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    d = figures.select(*by, "figure_id").distinct().join(statuses.select(*by, "figure_id", "status"), [*by, "figure_id"], "left")
    d = d.groupBy(*by).agg(F.count("*").alias("figures"), n("verified"), n("mismatch"), n("unresolved"), F.count_if(F.col("status").isNull()).alias("unmapped"))
    state = F.when(F.col("unmapped") == F.col("figures"), "unavailable").when((F.col("unmapped") > 0) | (F.col("unresolved") > 0), "degraded").otherwise("checked")
    return d.withColumn("state", state)


def merged(members: dict[str, DataFrame], name: str = "member") -> DataFrame:
    """Rows of all members in one table, each tagged with its member."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(m)) for m, df in members.items()])


def compatible(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """before's rows that stand for something that after shows in another way (key in both): such runs can't be compared."""
    return before.select(*key).distinct().join(after.select(*key).distinct(), key, "left_semi")


def suggestions(found: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """At most so many suggestions over all members, best first. The limit is the report's."""
    return found.orderBy(*order, by).limit(most)
