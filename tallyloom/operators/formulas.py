"""Formula checks on populated cells: consistency within runs, hardcoded cells, missing extensions, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inconsistent(cells: DataFrame, run: list[str], place: str, form: str, *, least: int = 3, share: float = 0.5) -> DataFrame:
    """Cells whose relative form isn't their run's dominant one; dominant: the most frequent (of equals the first met), in more than the share of at least so many cells."""
    d = cells.where(F.col(form).isNotNull())
    n = d.groupBy(*run, form).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    total = n.groupBy(*run).agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("first"), F.col(form).alias("dominant"))).alias("top"))
    total = total.where((F.col("all") >= least) & (F.col("top.n") > share * F.col("all"))).select(*run, F.col("top.dominant").alias("dominant"))
    return d.join(total, run).where(F.col(form) != F.col("dominant"))


def hardcoded(pairs: DataFrame) -> DataFrame:
    """Pairs whose formula became a value (formula_hardcoded) or nothing (formula_removed). pairs: base_formula, formula, value."""
    return pairs.where("base_formula is not null and formula is null").withColumn("finding", F.when(F.col("value").isNotNull(), "formula_hardcoded").otherwise("formula_removed"))


def not_extended(cells: DataFrame, line: list[str], share: float = 0.5, least: int = 2) -> DataFrame:
    """New cells without a formula in lines where enough of the paired cells have one. cells: grown (boolean), formula, populated."""
    ratio = cells.where("not grown and populated").groupBy(*line).agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"))
    ratio = ratio.where((F.col("cells") >= least) & (F.col("formulas") >= share * F.col("cells"))).select(*line)
    return cells.where("grown and formula is null").join(ratio, line, "left_semi")


def gaps(cells: DataFrame, line: list[str], place: str, *, least: int = 4, share: float = 0.6) -> DataFrame:
    """Places between the first and last formula of a line that have none, where formulas fill enough of them."""
    f = cells.where("formula is not null")
    span = f.groupBy(*line).agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.countDistinct(place).alias("n"))
    span = span.where((F.col("n") >= least) & (F.col("n") >= share * (F.col("hi") - F.col("lo") + 1)))
    dense = span.select(*line, F.explode(F.sequence("lo", "hi")).alias(place))
    return dense.join(f.select(*line, place).distinct(), [*line, place], "left_anti")


def errors(cells: DataFrame, baseline: DataFrame, key: list[str], error: str) -> DataFrame:
    """Cells with an error literal and where it comes from: inherited (the same before), changed (the cell was there without it), new."""
    now = cells.where(F.col(error).isNotNull())
    b = baseline.select(*key, F.col(error).alias("_before")).withColumn("_was", F.lit(True))
    j = now.join(b, key, "left")
    return j.withColumn("provenance", F.when(F.col("_was").isNull(), "new").when(F.col("_before") == F.col(error), "inherited").otherwise("changed")).drop("_before", "_was")


def by_run(cells: DataFrame, line: list[str], place: str) -> DataFrame:
    """cells with column run: neighbouring places of a line."""
    w = Window.partitionBy(*line).orderBy(place)
    return cells.withColumn("run", F.col(place) - F.row_number().over(w))
