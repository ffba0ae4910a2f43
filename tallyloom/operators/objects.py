"""Sheets, regions, ranges, chart series and links of two cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of a region pair's likeness, the least likeness that pairs, materiality of a chart's geometry.
LABELS, SHAPE, POSITION, LEAST = 0.65, 0.25, 0.10, 0.20
#: The label score of two regions without labels. And how far rows or cols of regions at different places, without a common
#: label, can be apart: 0.25 (x + 1) / 2 + 0.10 / 2 >= 0.20 needs x >= 0.2; a little more, so that buckets of logarithms miss none.
NO_LABELS, ALIKE = 0.25, 5.01
MOVED_EMU, RESIZED = 50_000, 0.02


def sheets(base: DataFrame, current: DataFrame, name: str, renames: dict[str, str], ignored: list[str]) -> DataFrame:
    """sheet_added, sheet_removed, sheet_renamed and unchanged sheets; a confirmed rename wins over an equal name."""
    to = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    b = base.select(F.col(name).alias("base")).where(~F.col(name).isin(ignored)).distinct()
    b = b.withColumn("_k", F.coalesce(F.element_at(to, F.col("base")), F.col("base")) if renames else F.col("base"))
    c = current.select(F.col(name).alias("current")).where(~F.col(name).isin(ignored)).distinct()
    j = b.join(c, F.col("_k") == F.col("current"), "full_outer")
    event = F.when(F.col("base").isNull(), "sheet_added").when(F.col("current").isNull(), "sheet_removed").when(F.col("base") != F.col("current"), "sheet_renamed").otherwise("unchanged")
    return j.select("base", "current", event.alias("event"))


def dice(common: Column, a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|); 0 for two empty sets."""
    return F.when(a + b == 0, 0.0).otherwise(2.0 * common / (a + b))


def region_scores(base: DataFrame, current: DataFrame, labels_base: DataFrame, labels_current: DataFrame) -> DataFrame:
    """All pairs of a sheet's regions with the same orientation and a score of LEAST or more: sheet, a, b, score.

    Regions: sheet, id, orientation, rows, cols, top, and left if columns count. Labels: sheet, id, label. Without a label
    in common, only two regions without any label, two at the same place, or two whose rows and cols are each within
    ALIKE times the other's can reach LEAST; these, and those with a common label, come from equality joins.
    """
    corner = ["top", "left"] if "left" in base.columns and "left" in current.columns else ["top"]
    la, lb = labels_base.select("sheet", F.col("id").alias("a"), "label").distinct(), labels_current.select("sheet", F.col("id").alias("b"), "label").distinct()
    common = la.join(lb, ["sheet", "label"]).groupBy("sheet", "a", "b").agg(F.count("*").alias("common"))
    n = lambda df, c: df.groupBy("sheet", c).agg(F.count("*").alias(f"n_{c}"))
    side = lambda df, labels, c: df.select("sheet", F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("orientation", "rows", "cols", *corner)]).join(n(labels, c), ["sheet", c], "left").fillna(0, [f"n_{c}"])
    x, y = side(base, la, "a"), side(current, lb, "b")
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / math.log(ALIKE)).cast("long")
    near = lambda c: F.explode(F.sequence(band(c) - 1, band(c) + 1))
    same = lambda on: x.selectExpr("sheet", "a", "orientation_a as _o", *[f"{c}_a as _{c}" for c in on]).join(y.selectExpr("sheet", "b", "orientation_b as _o", *[f"{c}_b as _{c}" for c in on]), ["sheet", "_o", *[f"_{c}" for c in on]]).select("sheet", "a", "b")
    bare = x.where("n_a = 0").selectExpr("sheet", "a", "orientation_a as _o").join(y.where("n_b = 0").selectExpr("sheet", "b", "orientation_b as _o"), ["sheet", "_o"]).select("sheet", "a", "b")
    xs = x.withColumn("_r", near("rows_a")).withColumn("_c", near("cols_a")).selectExpr("sheet", "a", "orientation_a as _o", "_r", "_c")
    ys = y.withColumn("_r", band("rows_b")).withColumn("_c", band("cols_b")).selectExpr("sheet", "b", "orientation_b as _o", "_r", "_c")
    shape = xs.join(ys, ["sheet", "_o", "_r", "_c"]).select("sheet", "a", "b")
    pairs = common.select("sheet", "a", "b").unionByName(same(corner)).unionByName(bare).unionByName(shape).distinct().join(common, ["sheet", "a", "b"], "left")
    j = pairs.join(x, ["sheet", "a"]).join(y, ["sheet", "b"]).where("orientation_a = orientation_b")
    ratio = lambda c: F.least(f"{c}_a", f"{c}_b") / F.greatest(f"{c}_a", f"{c}_b", F.lit(1))
    labels = F.when(F.col("n_a") + F.col("n_b") == 0, NO_LABELS).otherwise(dice(F.coalesce("common", F.lit(0)), F.col("n_a"), F.col("n_b")))
    distance = sum((F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in corner), F.lit(0))
    score = LABELS * labels + SHAPE * (ratio("rows") + ratio("cols")) / 2 + POSITION / (1 + distance)
    return j.select("sheet", "a", "b", score.alias("score")).where(F.col("score") >= LEAST)


def series_window(base: Column, current: Column) -> Column:
    """How a chart's categories moved: same, rolled (the first ones went, as many came), extended, shortened, or replaced."""
    nb, nc = F.size(base), F.size(current)
    common = F.size(F.array_intersect(base, current))
    tail = F.slice(base, nb - common + 1, common)
    rolled = (common > 0) & (tail == F.slice(current, 1, common)) & (nb == nc)
    extended = (nc > nb) & (F.slice(current, 1, nb) == base)
    shortened = (nc < nb) & (F.slice(base, 1, nc) == current)
    return F.when(base == current, "same").when(extended, "extended").when(shortened, "shortened").when(rolled, "rolled").otherwise("replaced")


def geometry_changed(x: Column, y: Column, width: Column, height: Column, before: Column) -> Column:
    """Whether a shape moved by MOVED_EMU or more, or its size changed by RESIZED or more. before: struct of the same four."""
    size = lambda a, b: F.abs(a - b) >= RESIZED * F.greatest(b, F.lit(1))
    return (F.abs(x - before["x"]) >= MOVED_EMU) | (F.abs(y - before["y"]) >= MOVED_EMU) | size(width, before["width"]) | size(height, before["height"])


def excerpts(findings: DataFrame, cells: DataFrame, around: int = 3) -> DataFrame:
    """The cells within so many rows and columns of each finding (sheet, row, col, finding), found through blocks of rows."""
    block = 2 * around + 1
    f = findings.select("finding", "sheet", F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(F.sequence(F.floor((F.col("row") - around) / block), F.floor((F.col("row") + around) / block))).alias("_b"))
    c = cells.withColumn("_b", F.floor(F.col("row") / block))
    j = f.join(c, ["sheet", "_b"]).where((F.abs(F.col("row") - F.col("_r")) <= around) & (F.abs(F.col("col") - F.col("_c")) <= around))
    return j.drop("_b", "_r", "_c")


def inversions(rules: DataFrame, group: str, base: str, current: str) -> DataFrame:
    """Rules whose order towards at least one other is reversed in the current cycle.

    A rule is, if one before it in the baseline now stands after it, or one after it before it: two running bounds tell.
    """
    w = Window.partitionBy(group).orderBy(base)
    d = rules.withColumn("_most", F.max(current).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_least", F.min(current).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return d.where((F.col("_most") > F.col(current)) | (F.col("_least") < F.col(current))).drop("_most", "_least")


def selected(members: DataFrame, member: str, order: list, most: int) -> DataFrame:
    """At most so many rows, taken in turn from each member: the report's bounded selection, in its order."""
    d = members.withColumn("_n", F.row_number().over(Window.partitionBy(member).orderBy(*order)))
    return d.where(F.col("_n") <= most).orderBy("_n", member).limit(most).drop("_n")
