"""Value and structure differences of aligned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators.graph import contained

#: A row or column beyond any sheet's, for bands without a bound.
OPEN = 1 << 36


def blank(text: Column) -> Column:
    """Whether a cell is absent, null or white space."""
    return text.isNull() | (F.trim(text) == "")


def values_differ(base: Column, current: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Whether two typed cells differ. A cell: struct<vtype (number, text, bool, date), num, txt>; blank cells are equal.

    Numbers compare within the tolerance; true and 1 differ; 1 and "1" differ.
    """
    no_base, no_current = base.isNull() | base["vtype"].isNull() | ((base["vtype"] == "text") & blank(base["txt"])), current.isNull() | current["vtype"].isNull() | ((current["vtype"] == "text") & blank(current["txt"]))
    same = (base["vtype"] == current["vtype"]) & F.when(base["vtype"] == "number", numbers.matches(base["num"], current["num"], absolute, relative)).otherwise(base["txt"].eqNullSafe(current["txt"]))
    return F.when(no_base & no_current, False).when(no_base | no_current, True).otherwise(~same)


def subtype(base: Column, current: Column) -> Column:
    """added, cleared or replacement of a changed pair of texts."""
    return F.when(blank(base), "added").when(blank(current), "cleared").otherwise("replacement")


def accepted(changes: DataFrame, bands: DataFrame, row: str, col: str, base: str, current: str) -> DataFrame:
    """changes with column accepted: whether a band of (bounds, absolute, relative) that holds the cell takes the change.

    A null bound is open. Changes meet the bands that hold them through blocks, however many bands a profile has; of what is
    found only the distinct (row, col, base, current) that a band takes are shuffled.
    """
    cell = {row: "row", col: "col", base: "_base", current: "_current"}
    keys = changes.select(*[F.col(c).alias(n) for c, n in cell.items()]).withColumn("sheet", F.lit(0))
    bound = lambda c, default: F.coalesce(F.col(c).cast("long"), F.lit(default)).alias(c)
    boxes = bands.select(F.lit(0).alias("sheet"), bound("min_row", 0), bound("max_row", OPEN), bound("min_col", 0), bound("max_col", OPEN), "absolute", "relative")
    delta = F.abs(F.col("_current") - F.col("_base"))
    near = ((F.col("absolute") > 0) & (delta <= F.col("absolute"))) | ((F.col("relative") > 0) & (F.col("_base") != 0) & (delta <= F.col("relative") * F.abs("_base")))
    taken = contained(keys, boxes).where(near).select("row", "col", "_base", "_current").distinct().withColumn("accepted", F.lit(True))
    cond = F.lit(True)
    for c, n in cell.items():
        cond = cond & F.col(f"c.{c}").eqNullSafe(F.col(f"t.{n}"))
    return changes.alias("c").join(taken.alias("t"), cond, "left").select("c.*", F.coalesce("t.accepted", F.lit(False)).alias("accepted"))


def structure(base: DataFrame, current: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Objects added, removed or changed, by null-safe key: key, event, changed (names of the differing fields)."""
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    a, b = base.withColumn("_here", F.lit(1)).alias("a"), current.withColumn("_here", F.lit(1)).alias("b")
    j = a.join(b, cond, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    event = F.when(F.col("a._here").isNull(), "added").when(F.col("b._here").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key], event.alias("event"), F.when(event == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed")).where("event is not null")
