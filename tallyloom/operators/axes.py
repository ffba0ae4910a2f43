"""Period axes: duplicates, order, gaps, bands, recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import periods


def integrity(df: DataFrame, axis: list[str], place: str, period: str = "period") -> DataFrame:
    """Findings along each axis in order of place: period_duplicate, period_out_of_order, period_gap (with missing, the periods between)."""
    w = Window.partitionBy(*axis, F.col(f"{period}.kind")).orderBy(place)
    p, before = F.col(period), F.lag(period).over(w)
    key = F.struct(*[F.col(f"{period}.{k}") for k in ("k1", "k2", "k3")])
    again = F.row_number().over(Window.partitionBy(*axis, F.col(f"{period}.kind"), key).orderBy(place)) > 1
    d = df.where(p.isNotNull()).withColumn("_before", before).withColumn("_again", again)
    steps = periods.distance(p, F.col("_before"))
    finding = F.when(F.col("_again"), "period_duplicate").when(F.col("_before").isNotNull() & ~periods.is_after(p, F.col("_before")), "period_out_of_order").when(steps > 1, "period_gap")
    return d.select(*axis, F.col(place), p.alias("period"), finding.alias("finding"), F.when(finding == "period_gap", steps - 1).alias("missing")).where("finding is not null")


def bands(df: DataFrame, axis: list[str], place: str, period: str = "period") -> DataFrame:
    """df with column band: runs of neighbouring places of one kind whose periods increase."""
    w = Window.partitionBy(*axis).orderBy(place)
    p, before = F.col(period), F.lag(period).over(w)
    new = (F.lag(place).over(w).isNull()) | (F.col(place) != F.lag(place).over(w) + 1) | ~F.coalesce(periods.is_after(p, before), F.lit(False))
    return df.withColumn("_new", new.cast("int")).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def context(df: DataFrame, band: list[str], period: str = "period", recent: int = 2) -> DataFrame:
    """df with column context: current for a band's latest period, recent for the distinct ones before it, historical for others."""
    key = F.struct(*[F.col(f"{period}.{k}") for k in ("k1", "k2", "k3")])
    rank = F.dense_rank().over(Window.partitionBy(*band).orderBy(key.desc()))
    return df.withColumn("_rank", rank).withColumn("context", F.when(F.col("_rank") == 1, "current_period").when(F.col("_rank") <= recent, "recent_window").otherwise("historical")).drop("_rank")


def date_cadence(df: DataFrame, axis: list[str], date: str) -> DataFrame:
    """cadence of each axis of dates, from the upper median gap between distinct dates; null with fewer than two."""
    w = Window.partitionBy(*axis).orderBy(date)
    gaps = df.select(*axis, F.to_date(date).alias(date)).distinct().withColumn("gap", F.datediff(F.col(date), F.lag(date).over(w)))
    counted = gaps.where("gap is not null").groupBy(*axis, "gap").agg(F.count("*").alias("n"))
    run = Window.partitionBy(*axis).orderBy("gap")
    counted = counted.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*axis)))
    median = counted.where("upto > floor(all / 2)").groupBy(*axis).agg(F.min("gap").alias("median_gap"))
    return df.select(*axis).distinct().join(median, axis, "left").withColumn("cadence", periods.cadence(F.col("median_gap")))


def band_evidence(df: DataFrame, line: list[str], place: str, period: str = "period", *, least: int = 4, share: float = 0.8, contiguous: float = 0.9) -> DataFrame:
    """Lines of cells that are period axes: cells, periods, share, whether they increase, share of neighbouring steps of one, is_axis."""
    w = Window.partitionBy(*line).orderBy(place)
    d = df.select(*line, place, F.col(period).alias("_p")).withColumn("_all", F.count("*").over(Window.partitionBy(*line)))
    d = d.where("_p is not null").withColumn("_b", F.lag("_p").over(w))
    rises = F.coalesce(periods.is_after(F.col("_p"), F.col("_b")), F.col("_b").isNull())
    step = F.coalesce(periods.distance(F.col("_p"), F.col("_b")) == 1, F.lit(False))
    out = d.groupBy(*line).agg(F.max("_all").alias("cells"), F.count("*").alias("periods"), F.min(rises.cast("int")).alias("rises"), F.count_if(step).alias("steps"))
    ok = (F.col("periods") >= least) & (F.col("periods") >= share * F.col("cells")) & (F.col("rises") == 1) & (F.col("steps") >= contiguous * (F.col("periods") - 1))
    return out.withColumn("is_axis", ok)
