"""What a run could check: a missing capability is never a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("checked", "degraded", "unavailable", "not_included")


def rows(spark: SparkSession, checks: dict[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """A row for each check: state, findings. checks: by id the findings (None: it could not run) and the state to report if it ran."""
    out = []
    for name, (found, state) in checks.items():
        if state not in STATES:
            raise ValueError(state)
        own = spark.range(1).select(F.lit(0).cast("long").alias("findings")) if found is None else found.agg(F.count("*").alias("findings"))
        out.append(own.select(F.lit(name).alias("check"), F.lit("unavailable" if found is None and state == "checked" else state).alias("state"), "findings"))
    return reduce(DataFrame.unionByName, out)


def limited(coverage: DataFrame) -> DataFrame:
    """Whether any check was unavailable, and the counts by state."""
    return coverage.agg(F.bool_or(F.col("state") == "unavailable").alias("limited"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def workload(cells: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Measures of a workbook against limits (warn, refuse): measure, value, verdict ok, warn or refuse. Measures: cells, formulas, sheets, area."""
    sheet = cells.groupBy("sheet").agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), (F.max("row") * F.max("col")).alias("area"))
    m = sheet.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "formulas", "area")], F.count("*").alias("sheets"))
    long = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("long").alias("value"), F.lit(w).alias("w"), F.lit(r).alias("r")) for k, (w, r) in limits.items()])).alias("x")).select("x.*")
    return long.select("measure", "value", F.when(F.col("value") > F.col("r"), "refuse").when(F.col("value") > F.col("w"), "warn").otherwise("ok").alias("verdict"))


# What a workbook's formulas may need before a run warns or refuses: warn from, refuse from.
COMPLEXITY = {"formulas": (75_000, 400_000), "operands": (1_500_000, 8_000_000), "edges": (40_000_000, 250_000_000), "rules": (5_000, 40_000)}
#: Formula cells and edges from which dependencies are left out, and said to be.
SKIP_CELLS, SKIP_EDGES = 500_000, 250_000_000


def complexity(facts: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, value, verdict (ok, warn, refuse), and whether dependencies would be skipped. facts: by, formulas, operands, edges, rules."""
    skip = (F.col("formulas") >= SKIP_CELLS) | (F.col("edges") >= SKIP_EDGES)
    long = facts.select(*by, skip.alias("skip"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("long").alias("value"), F.lit(w).alias("w"), F.lit(r).alias("r")) for k, (w, r) in COMPLEXITY.items()])).alias("x"))
    return long.select(*by, "x.measure", "x.value", F.when(F.col("x.value") >= F.col("x.r"), "refuse").when(F.col("x.value") >= F.col("x.w"), "warn").otherwise("ok").alias("verdict"), F.col("skip").alias("dependencies_skipped"))


def populations(kinds: DataFrame) -> DataFrame:
    """finding_class and what became of its candidates (finding_class, kind, members): populations, members in them, and atomic ones by why."""
    n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("members")).otherwise(0)).alias(k)
    return kinds.groupBy("finding_class").agg(F.sum("members").alias("candidates"), F.count_if(F.col("kind") == "population").alias("populations"), n("population"), n("below_threshold"), n("heterogeneous"))
