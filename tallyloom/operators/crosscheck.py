"""Reconciliation of displayed figures with cells, and of repeated claims with each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers, similarity
from tallyloom.operators import asof
from tallyloom.operators.stored import numbered, stored

#: A figure and a cell within 5 % of each other lie in the same or in neighbouring buckets of this width in the logarithm; numbers smaller than TINY share one.
NEAR, WIDTH, TINY = 0.05, math.log(1.06), 1e-12


def bucket(value: Column) -> Column:
    """Buckets of the logarithm, one ascending sequence from the least to the greatest number; all that is closer to 0 than TINY has its own."""
    size = F.floor(F.log(F.greatest(F.abs(value), F.lit(TINY)) / TINY) / WIDTH)
    return (F.signum(value) * size).cast("long")


def cell_name(row: Column, col: Column) -> Column:
    """A cell as text: D10."""
    n = col.cast("long") - 1
    one = lambda x: F.chr(F.lit(65) + x % 26)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    letters = F.when(n < 26, one(n)).when(n < 702, F.concat(one(two), one(n))).otherwise(F.concat(one(three), one(two), one(n)))
    return F.concat(letters, row.cast("string"))


def candidates(figures: DataFrame, cells: DataFrame, most: int = 5) -> DataFrame:
    """Of each figure the best cells: those that display as it, or lie within 5 %; displayed ones first, then by likeness of labels, difference, sheet, cell (as text).

    figures: figure_id, mantissa, scale, percent, decimals, negative, figure_value, and context (the text around it) if labels
    count. cells: sheet, row, col, value, and row_label and column_label if known. Among cells with the same labels (without
    context: all) those that a figure ranks first are its nearest neighbours, so an as-of join finds its place among their
    distinct values and no more than most values on either side of it are looked at. Labels are tried that have a cell in the
    buckets of the logarithm that what matches a figure can lie in; a pair of context and labels is compared once.
    """
    told = "context" in figures.columns
    cells = cells.where(F.abs("value") < F.lit(math.inf))  # others match nothing
    for c in ("row_label", "column_label"):
        cells = cells if c in cells.columns else cells.withColumn(c, F.lit(None).cast("string"))
    labels = F.concat_ws(" ", "sheet", F.coalesce("row_label", F.lit("")), F.coalesce("column_label", F.lit("")))
    named = cells.withColumn("_cell", cell_name(F.col("row"), F.col("col"))).withColumn("_group", labels if told else F.lit("")).withColumn("_v", F.col("value").cast("double") + 0.0)  # -0 is 0
    same = Window.partitionBy("_v", "_group").orderBy("sheet", "_cell")
    named = stored(named.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_n"), "cells")
    places = stored(numbered(named.select(F.struct("_group", "_v").alias("_id")), "_id").select("_id.*", "n"), "places")
    ends = places.groupBy("_group").agg(F.min("n").alias("_first"), F.max("n").alias("_last"))

    half = F.col("scale") * F.when(F.col("percent"), 0.01).otherwise(1.0) * (0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9)
    reach = F.when(F.col("figure_value") == 0, F.lit(NEAR)).otherwise(NEAR * F.abs("figure_value"))
    lo, hi = F.col("figure_value") - F.greatest(half, reach), F.col("figure_value") + F.greatest(half, reach)
    context = F.coalesce("context", F.lit("")) if told else F.lit("")
    f = stored(figures.select("figure_id", "mantissa", "scale", "percent", "decimals", "negative", "figure_value", context.alias("_context"), F.monotonically_increasing_id().alias("_figure")), "figures")
    near = f.select("_figure", F.explode(F.sequence(bucket(lo - 1e-9 * F.abs(lo)), bucket(hi + 1e-9 * F.abs(hi)))).alias("_b"))
    pairs = near.join(places.select("_group", bucket(F.col("_v")).alias("_b")).distinct(), "_b").select("_figure", "_group").distinct().join(f, "_figure")
    if told:
        pairs = stored(pairs, "pairs")
        scores = stored(pairs.select("_context", "_group").distinct().withColumn("label_score", similarity.token_set(F.col("_context"), F.col("_group"))), "scores")
        pairs = pairs.join(scores, ["_context", "_group"])
    else:
        pairs = pairs.withColumn("label_score", F.lit(0.0))
    at = asof.asof(pairs.withColumn("_at", F.col("figure_value").cast("double")), places.withColumnRenamed("_v", "_below"), ["_group"], "_at", "_below").join(ends, "_group")
    place = F.coalesce("n", F.col("_first") - 1)
    at = at.withColumn("n", F.explode(F.sequence(F.greatest(place - (most - 1), "_first"), F.least(place + most, "_last")))).drop("_group")
    j = at.join(named.join(places, ["_group", "_v"]), "n")
    shown = numbers.display_matches(F.col("mantissa"), F.col("scale"), F.col("percent"), F.col("decimals"), F.col("negative"), F.col("value"))
    diff = numbers.relative_difference(F.col("figure_value"), F.col("value"))
    j = j.withColumn("shown", shown).withColumn("difference", diff).where(F.col("shown") | (F.col("difference") <= NEAR))
    w = Window.partitionBy("figure_id").orderBy(F.col("shown").desc(), F.col("label_score").desc(), "difference", "sheet", "_cell")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("figure_id", "rank", "sheet", "row", "col", "value", "shown", "label_score", "difference", "row_label", "column_label")


def verified(mappings: DataFrame, figures: DataFrame, cells: DataFrame) -> DataFrame:
    """Of each mapping (figure_id, sheet, row, col): verified, mismatch, or unresolved (no such figure or cell)."""
    j = mappings.join(figures, "figure_id", "left").join(cells, ["sheet", "row", "col"], "left")
    shown = numbers.display_matches(F.col("mantissa"), F.col("scale"), F.col("percent"), F.col("decimals"), F.col("negative"), F.col("value"))
    return j.select("figure_id", "sheet", "row", "col", F.when(F.col("figure_value").isNull() | F.col("value").isNull(), "unresolved").when(shown, "verified").otherwise("mismatch").alias("status"))


def claims(figures: DataFrame, identity: list[str], slide: str, value: str, half: str) -> DataFrame:
    """Claims made on two slides or more that differ by more than their precision shows."""
    return figures.groupBy(*identity).agg(F.countDistinct(slide).alias("slides"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(half).alias("half")).where((F.col("slides") >= 2) & (F.col("high") - F.col("low") > 2 * F.col("half"))).drop("half")


def nearest_label(cells: DataFrame, line: list[str], place: str, label: str, name: str) -> DataFrame:
    """cells with the last label before each in its line."""
    w = Window.partitionBy(*line).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.last(label, ignorenulls=True).over(w))
