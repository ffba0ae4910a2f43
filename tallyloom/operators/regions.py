"""Shapes of populated cells: runs, connected regions, rectangle covers, error populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.graph import connected, shared


def runs(df: DataFrame, line: list[str], place: str) -> DataFrame:
    """Gaps and islands: line, first, last of each run of neighbouring places (each place once)."""
    w = Window.partitionBy(*line).orderBy(place)
    d = df.select(*line, place).distinct().withColumn("_island", F.col(place) - F.row_number().over(w))
    return d.groupBy(*line, "_island").agg(F.min(place).alias("first"), F.max(place).alias("last")).drop("_island")


def regions(cells: DataFrame, sheet: str, row: str, col: str) -> DataFrame:
    """Connected components' bounding boxes, merged until no two overlap: sheet, min_row, max_row, min_col, max_col, cells."""
    return merged(components(cells, sheet, row, col), sheet)


def merged(boxes: DataFrame, sheet: str, rows: int = 64, columns: int = 16) -> DataFrame:
    """Boxes (sheet, min_row, max_row, min_col, max_col, cells) of which those that overlap become their union, until none do.

    Boxes that overlap share a block of rows x columns, and are joined through the block that holds the upper left corner
    of what they share, so each pair is met once.
    """
    at = lambda c, n: F.floor(F.col(c) / n)
    corners = ["min_row", "max_row", "min_col", "max_col"]
    while True:
        d = shared(boxes.withColumn("id", F.concat_ws(":", F.col(sheet).cast("string"), *[F.col(c).cast("string") for c in corners])))
        listed = d.withColumn("_br", F.explode(F.sequence(at("min_row", rows), at("max_row", rows)))).withColumn("_bc", F.explode(F.sequence(at("min_col", columns), at("max_col", columns))))
        x, y = (listed.select(F.col(sheet).alias("_s"), "_br", "_bc", F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in corners]) for i in ("a", "b"))
        overlap = "a < b and min_row_a <= max_row_b and min_row_b <= max_row_a and min_col_a <= max_col_b and min_col_b <= max_col_a"
        first = (F.floor(F.greatest("min_row_a", "min_row_b") / rows) == F.col("_br")) & (F.floor(F.greatest("min_col_a", "min_col_b") / columns) == F.col("_bc"))
        links = shared(x.join(y, ["_s", "_br", "_bc"]).where(overlap).where(first).select("a", "b"))
        if not links.head(1):
            return d.drop("id")
        named = d.join(connected(links), "id", "left").withColumn("part", F.coalesce("part", "id"))
        boxes = named.groupBy(sheet, "part").agg(F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"), F.sum("cells").alias("cells")).drop("part")


def components(cells: DataFrame, sheet: str, row: str, col: str) -> DataFrame:
    """Bounding boxes of cells connected left, right, up or down: sheet, min_row, max_row, min_col, max_col, cells.

    Cells become runs of each row; runs that overlap in neighbouring rows are linked. A run overlaps few runs of the row
    below, found through its columns in blocks, so the join grows with the cells.
    """
    r = runs(cells, [sheet, row], col)
    r = r.withColumn("id", F.concat_ws(":", F.col(sheet).cast("string"), F.col(row).cast("string"), F.col("first").cast("string")))
    blocks = r.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor(F.col("last") / 64))))
    a, b = blocks.alias("a"), blocks.alias("b")
    links = a.join(b, (F.col(f"a.{sheet}") == F.col(f"b.{sheet}")) & (F.col(f"a.{row}") + 1 == F.col(f"b.{row}")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last")))
    part = connected(links.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
    named = r.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    return named.groupBy(sheet, "part").agg(F.min(row).alias("min_row"), F.max(row).alias("max_row"), F.min("first").alias("min_col"), F.max("last").alias("max_col"), F.sum(F.col("last") - F.col("first") + 1).alias("cells")).drop("part")


def cover(cells: DataFrame, sheet: str, row: str, col: str) -> DataFrame:
    """sheet, min_row, max_row, min_col, max_col of rectangles that cover the cells: runs of columns in each row, then neighbouring rows with the same run."""
    r = runs(cells, [sheet, row], col).withColumnsRenamed({"first": "min_col", "last": "max_col"})
    return runs(r, [sheet, "min_col", "max_col"], row).select(sheet, F.col("first").alias("min_row"), F.col("last").alias("max_row"), "min_col", "max_col")


def populations(cells: DataFrame, column: list[str], row: str, *, some: int = 20, share: float = 0.5, run: float = 0.8, many: int = 200) -> DataFrame:
    """Columns whose flagged cells are a population: count, longest run, and concentrated (so large a share), contiguous (so large a run) or neither.

    cells: all of a column, with a boolean column flagged.
    """
    total = cells.groupBy(*column).agg(F.count("*").alias("cells"), F.count_if("flagged").alias("flagged"))
    longest = runs(cells.where("flagged"), column, row).groupBy(*column).agg(F.max(F.col("last") - F.col("first") + 1).alias("longest"), F.count("*").alias("runs"))
    d = total.join(longest, column)
    enough = ((F.col("flagged") >= some) & ((F.col("flagged") >= share * F.col("cells")) | (F.col("longest") >= run * F.col("flagged")))) | (F.col("flagged") >= many)
    return d.withColumn("population", enough)
