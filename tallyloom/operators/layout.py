"""What kind of table each region of a sheet is: its period axis, orientation, header and key; and how two versions line up.

Cells: sheet, row, col, value (text; null: none), vtype (number, text, bool, date), num, formula (null: none), period (struct
or null; see periods.with_period). Regions: sheet, min_row, max_row, min_col, max_col. A region's id is its sheet and corners.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import periods
from tallyloom.operators.graph import contained, shared

# What a line of labels needs to be a period axis, strictly: labels, their share, the longest run's share of them.
STRICT_PERIODS, STRICT_SHARE, STRICT_RUN = 4, 0.8, 0.9
# What it needs when no line passes the strict test; how far the best must lead its axis and the other one.
LENIENT_PERIODS, LENIENT_SHARE = 2, 0.6
LEAD_SAME, LEAD_OTHER = 1.5, 0.2
# Columns at a region's left that can hold its periods; share of cells that aren't numbers in a label column;
# shares of formulas and of periods that make a column derived.
KEY_COLUMNS, LABELS, DERIVED = 3, 0.8, 0.5
# Share of matched keys below which an axis falls back to positions, size from which that is unsure; share of a
# block's rows with a label, and of labels that both versions have.
MATCHED, UNSURE, STABLE, OVERLAP = 0.5, 4, 0.6, 0.8

BOX = ["min_row", "max_row", "min_col", "max_col"]
REGION = ["sheet", *BOX]


def axis_of(orientation: Column) -> Column:
    return F.when(orientation == "wide", "columns").when(orientation == "long", "rows").otherwise("none")


def within(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region's populated cells, with the region's columns."""
    return contained(cells.where(F.col("value").isNotNull()), regions)


def evidence(cells: DataFrame, line: list[str], place: str) -> DataFrame:
    """Lines of cells with cells, periods, and whether each is a period axis by the strict and by the lenient test."""
    w = Window.partitionBy(*line).orderBy(place)
    key = F.struct("period.k1", "period.k2", "period.k3")
    found = cells.where("period is not null").withColumn("_key", key).withColumn("_back", F.coalesce(F.col("_key") < F.lag("_key").over(w), F.lit(False))).withColumn("_run", F.col(place) - F.row_number().over(w))
    runs = found.groupBy(*line, "_run").agg(F.count("*").alias("n"), F.bool_or("_back").alias("back"))
    of = runs.groupBy(*line).agg(F.sum("n").alias("periods"), F.max("n").alias("longest"), F.bool_or("back").alias("back"))
    out = cells.groupBy(*line).agg(F.count("*").alias("cells")).join(of, line)
    strict = (F.col("periods") >= STRICT_PERIODS) & (F.col("periods") >= STRICT_SHARE * F.col("cells")) & ~F.col("back") & (F.col("longest") >= STRICT_RUN * F.col("periods"))
    return out.select(*line, "cells", "periods", strict.alias("strict"), ((F.col("periods") >= LENIENT_PERIODS) & (F.col("periods") >= LENIENT_SHARE * F.col("cells"))).alias("lenient"))


def candidates(cells: DataFrame) -> DataFrame:
    """Lines that may be a region's period axis: its top row right of the first column, and each of its first columns below the top row."""
    across = cells.where("row = min_row and col > min_col").select(*REGION, F.lit("columns").alias("axis"), F.col("row").alias("anchor"), F.col("col").alias("place"), "period")
    down = cells.where(F.col("col") < F.col("min_col") + KEY_COLUMNS).where("row > min_row").select(*REGION, F.lit("rows").alias("axis"), F.col("col").alias("anchor"), F.col("row").alias("place"), "period")
    return evidence(across.unionByName(down), [*REGION, "axis", "anchor"], "place")


def winners(lines: DataFrame) -> DataFrame:
    """Of each region with a strict line: winner (axis, anchor), or null where others come so near that none is clear."""
    first = Window.partitionBy(*REGION).orderBy(F.col("periods").desc(), "axis", "anchor")
    d = lines.where("strict").withColumn("_n", F.row_number().over(first))
    best = d.where("_n = 1").select(*REGION, F.col("axis").alias("_axis"), "anchor", F.col("periods").alias("best"))
    rest = d.where("_n > 1").select(*REGION, "axis", "periods")
    near = best.join(rest, REGION, "left").groupBy(*REGION, "_axis", "anchor", "best").agg(F.max(F.when(F.col("axis") == F.col("_axis"), F.col("periods"))).alias("same"), F.max(F.when(F.col("axis") != F.col("_axis"), F.col("periods"))).alias("other"))
    clear = F.coalesce(F.col("best") >= LEAD_SAME * F.col("same"), F.lit(True)) & F.coalesce(F.col("other") < (1 - LEAD_OTHER) * F.col("best"), F.lit(True))
    return near.select(*REGION, F.when(clear, F.struct(F.col("_axis").alias("axis"), "anchor")).alias("winner"))


def oriented(cells: DataFrame, regions: DataFrame, pins: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """Regions with orientation (wide: periods across, long: periods down, block), header_row and key_col.

    A region with strict period lines is that of the clear winner, else a block; one without takes its first lenient line,
    the top row before columns. A sheet with pins (REGION, orientation, header_row, key_col; the last two may be null) has
    these instead; ignored sheets (sheet) have none.
    """
    if ignored is not None:
        regions = regions.join(ignored.select("sheet").distinct(), "sheet", "left_anti")
    if pins is not None:
        regions = regions.join(pins.select("sheet").distinct(), "sheet", "left_anti")
    lines = candidates(within(cells, regions))
    lenient = lines.where("lenient").groupBy(*REGION).agg(F.min(F.struct("axis", "anchor")).alias("first"))
    d = regions.select(*REGION).join(winners(lines).withColumn("_strict", F.lit(True)), REGION, "left").join(lenient, REGION, "left")
    chosen = F.when(F.coalesce("_strict", F.lit(False)), F.col("winner")).otherwise(F.col("first"))
    d = d.withColumn("_c", chosen)
    orientation = F.when(F.col("_c.axis") == "columns", "wide").when(F.col("_c.axis") == "rows", "long").otherwise("block")
    out = d.select(*REGION, orientation.alias("orientation"), F.when(orientation != "block", F.col("min_row")).alias("header_row"), F.when(orientation == "long", F.col("_c.anchor")).otherwise(F.col("min_col")).alias("key_col"))
    if pins is None:
        return out
    head = F.coalesce("header_row", F.when(F.col("orientation") != "block", F.col("min_row")))
    return out.unionByName(pins.select(*REGION, "orientation", head.alias("header_row"), F.coalesce("key_col", "min_col").alias("key_col")))


def axis_periods(held: DataFrame) -> DataFrame:
    """id, place, period of each region's period axis: the key column or header row, else the first line that is periodic.

    held: within() of the regions, with id, orientation, header_row and key_col.
    """
    down = held.where("orientation = 'long'").where(F.col("row") >= F.col("min_row") + F.when(F.col("header_row") == F.col("min_row"), 1).otherwise(0)).select("id", F.col("col").alias("anchor"), F.col("row").alias("place"), "period", (F.col("col") != F.col("key_col")).alias("later"))
    across = held.where("orientation = 'wide' and col > min_col").select("id", F.col("row").alias("anchor"), F.col("col").alias("place"), "period", (F.col("row") != F.coalesce("header_row", F.lit(-1))).alias("later"))
    both = down.unionByName(across)
    n = both.groupBy("id", "later", "anchor").agg(F.count("*").alias("cells"), F.count("period").alias("periods"))
    first = n.where((F.col("periods") >= LENIENT_PERIODS) & (F.col("periods") >= LENIENT_SHARE * F.col("cells"))).groupBy("id").agg(F.min(F.struct("later", "anchor")).alias("f"))
    return both.where("period is not null").join(first, "id").where(F.col("anchor") == F.col("f.anchor")).select("id", "place", "period")


def suggestions(cells: DataFrame, oriented_regions: DataFrame) -> DataFrame:
    """Strict period lines inside blocks, which a profile would have to pin: REGION, axis, anchor, periods."""
    c = within(cells, oriented_regions.where("orientation = 'block'"))
    across = c.where("row <> min_row").select(*REGION, F.lit("columns").alias("axis"), F.col("row").alias("anchor"), F.col("col").alias("place"), "period")
    down = c.select(*REGION, F.lit("rows").alias("axis"), F.col("col").alias("anchor"), F.col("row").alias("place"), "period")
    return evidence(across.unionByName(down), [*REGION, "axis", "anchor"], "place").where("strict").select(*REGION, "axis", "anchor", "periods")


def key_columns(held: DataFrame, long_regions: DataFrame) -> DataFrame:
    """id and line: the leading columns that identify a long region's rows; at least its key column.

    Label columns from the left on; a column after the first that is mostly formulas and periods ends them.
    """
    c = held.where("orientation = 'long'").where(F.col("row") > F.coalesce("header_row", "min_row"))
    share = lambda x: F.count_if(x) / F.count("*")
    n = c.groupBy("id", "min_col", "col").agg(share(~F.col("vtype").isin("number", "bool")).alias("labels"), share(F.col("formula").isNotNull()).alias("formulas"), share(F.col("period").isNotNull()).alias("dated"))
    derived = (F.col("formulas") >= DERIVED) & (F.col("dated") >= DERIVED) & (F.col("col") > F.col("min_col"))
    good = n.where((F.col("labels") >= LABELS) & ~derived)
    led = good.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("col"))).where(F.col("col") == F.col("min_col") + F.col("_n") - 1).select("id", F.col("col").alias("line"))
    return led.unionByName(long_regions.join(led, "id", "left_anti").select("id", F.coalesce("key_col", "min_col").alias("line")))


def entries(held: DataFrame, regions: DataFrame, along: str, keys: DataFrame, first: Column) -> DataFrame:
    """id, index, key (one text of all parts, with the occurrence), periods (of the parts) of each row or column from first on.

    keys: id and line (the columns, or the rows, whose cells are the key's parts, in order).
    """
    across = "col" if along == "row" else "row"
    keys = keys.join(keys.groupBy("id").agg(F.min("line").alias("_first")), "id")
    c = held.join(keys, "id").where(F.col(across) == F.col("line")).where(F.col(along) >= first)
    part = F.struct((F.col("line") - F.col("_first")).cast("int").alias("at"), F.concat_ws(":", F.when(F.col("vtype").isin("number", "bool"), F.lit("n")).otherwise(F.lit("t")), "value").alias("value"), F.col("period"))
    of = c.groupBy("id", F.col(along).alias("index")).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # as many as a key has columns
    every = regions.select("id", F.explode(F.sequence(first, F.col(f"max_{along}"))).alias("index"))
    d = every.join(of, ["id", "index"], "left").withColumn("_raw", F.coalesce(F.to_json(F.transform("parts", lambda p: F.struct(p["at"].alias("l"), p["value"].alias("v")))), F.lit("[]")))
    occurrence = F.row_number().over(Window.partitionBy("id", "_raw").orderBy("index"))
    dated = F.filter(F.transform("parts", lambda p: F.struct(p["at"].alias("at"), p["period"].alias("period"))), lambda x: x["period"].isNotNull())
    return d.select("id", "index", F.concat_ws("#", "_raw", occurrence.cast("string")).alias("key"), dated.alias("periods"))


def positions(regions: DataFrame, along: str) -> DataFrame:
    """entries() of rows or columns known by their place alone."""
    d = regions.select("id", f"min_{along}", F.explode(F.sequence(F.col(f"min_{along}"), F.col(f"max_{along}"))).alias("index"))
    none = F.array().cast(f"array<struct<at:int,period:{periods.TYPE}>>")
    return d.select("id", "index", (F.col("index") - F.col(f"min_{along}")).cast("string").alias("key"), none.alias("periods"))


def aligned(base: DataFrame, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, base_index, current_index, event (paired, deleted, inserted, growth), method (keys, positional), unsure; of each axis.

    Entries (by: id unless told otherwise; index, key, periods) pair by key; where fewer than MATCHED of the baseline's find a
    partner, by place in order instead.
    """
    by = by or ["id"]
    b, c = base.select(*by, "key", F.col("index").alias("base_index")), current.select(*by, "key", F.col("index").alias("current_index"), "periods")
    keyed = shared(b.join(c, [*by, "key"], "full_outer").select(*by, "base_index", "current_index", "periods"))
    n = keyed.groupBy(*by).agg(F.count("base_index").alias("b"), F.count("current_index").alias("c"), F.count_if(F.col("base_index").isNotNull() & F.col("current_index").isNotNull()).alias("m"))
    falls = n.where((F.col("b") > 0) & (F.col("m") < MATCHED * F.col("b"))).select(*by, ((F.col("b") >= UNSURE) & (F.col("c") >= UNSURE)).alias("unsure"))
    d = keyed.join(falls, by, "left").withColumn("falls", F.col("unsure").isNotNull())
    own = d.where("falls")
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c))
    x = own.where("base_index is not null").select(*by, "unsure", place("base_index").alias("place"), "base_index")
    y = own.where("current_index is not null").select(*by, "unsure", place("current_index").alias("place"), "current_index", "periods")
    by_place = x.join(y, [*by, "unsure", "place"], "full_outer").select(*by, "base_index", "current_index", "periods", F.lit("positional").alias("method"), "unsure")
    by_key = d.where("not falls").select(*by, "base_index", "current_index", "periods", F.lit("keys").alias("method"), F.lit(False).alias("unsure"))
    pairs = by_key.unionByName(by_place)
    latest = base.select(*by, F.explode("periods").alias("p")).groupBy(*by, F.col("p.at").alias("at"), F.col("p.period.kind").alias("kind")).agg(F.max(F.struct("p.period.k1", "p.period.k2", "p.period.k3")).alias("last"))
    came = pairs.where("base_index is null").select(*by, "current_index", F.explode("periods").alias("p")).select(*by, "current_index", F.col("p.at").alias("at"), F.col("p.period.kind").alias("kind"), F.col("p.period").alias("period"))
    last = F.struct(F.col("kind"), F.col("last.k1"), F.col("last.k2"), F.col("last.k3"))
    grows = came.join(latest, [*by, "at", "kind"]).where(periods.is_after(F.col("period"), last)).select(*by, "current_index").distinct().withColumn("_grows", F.lit(True))
    event = F.when(F.col("base_index").isNotNull() & F.col("current_index").isNotNull(), "paired").when(F.col("current_index").isNull(), "deleted").when(F.col("_grows"), "growth").otherwise("inserted")
    return pairs.join(grows, [*by, "current_index"], "left").select(*by, "base_index", "current_index", event.alias("event"), "method", "unsure")


def keyed_blocks(held: list[DataFrame], sides: list[DataFrame]) -> DataFrame:
    """id of the blocks whose rows may align by label: on both sides enough rows are named by a constant text that is no period, none twice, and both share enough."""
    found = []
    for cells, regions in zip(held, sides, strict=True):
        c = cells.where("orientation = 'block'").where(F.col("col") == F.coalesce("key_col", "min_col"))
        labels = c.where((F.col("vtype") == "text") & (F.trim("value") != "") & F.col("formula").isNull() & F.col("period").isNull()).select("id", F.col("value").alias("label"))
        n = labels.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("d")).join(regions.select("id", (F.col("max_row") - F.col("min_row") + 1).alias("rows")), "id")
        found.append((labels.distinct(), n.where((F.col("n") == F.col("d")) & (F.col("n") >= STABLE * F.col("rows"))).select("id", "n")))
    (x, nx), (y, ny) = found
    common = x.join(y, ["id", "label"]).groupBy("id").agg(F.count("*").alias("common"))
    both = nx.withColumnRenamed("n", "nx").join(ny.withColumnRenamed("n", "ny"), "id").join(common, "id")
    return both.where(F.col("common") >= OVERLAP * F.greatest("nx", "ny")).select("id")


def held_cells(cells: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """within() of one side's regions of pairs, written once for all that read it."""
    return shared(within(cells, one_side(pairs, side)))


def one_side(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select("id", "orientation", "sheet", *[F.col(f"{side}.{c}").alias(c) for c in (*BOX, "header_row", "key_col")])


def aligned_regions(base_held: DataFrame, current_held: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, axis (rows, columns), base_index, current_index, event, method, unsure of each pair of regions.

    pairs: id, orientation, sheet, and of both sides (a struct base and one current) BOX, header_row, key_col; held: each side's
    held_cells(). Long rows go by their key columns, wide rows by the label column, both columns by the header row; block rows
    by stable labels or place, block columns by place.
    """
    held, sides = [base_held, current_held], [one_side(pairs, s) for s in ("base", "current")]
    by_label = shared(keyed_blocks(held, [r.where("orientation = 'block'") for r in sides]))
    head, lines = F.coalesce("header_row", "min_row"), []
    for cells, r in zip(held, sides, strict=True):
        long, wide, block = (r.where(F.col("orientation") == o) for o in ("long", "wide", "block"))
        named, label = block.join(by_label, "id", "left_semi"), F.coalesce("key_col", "min_col").alias("line")
        keyed = [
            ("rows", entries(cells, long, "row", key_columns(cells, long), head + 1)), ("rows", entries(cells, wide, "row", wide.select("id", label), head)), ("rows", entries(cells, named, "row", named.select("id", label), F.col("min_row"))),
            ("columns", entries(cells, r.where("orientation <> 'block'"), "col", r.where("orientation <> 'block'").select("id", head.alias("line")), F.col("min_col"))),
            ("rows", positions(block.join(by_label, "id", "left_anti"), "row")), ("columns", positions(block, "col")),
        ]
        parts = [e.withColumn("axis", F.lit(axis)).withColumn("by_place", F.lit(i >= 4)) for i, (axis, e) in enumerate(keyed)]
        lines.append(shared(reduce(DataFrame.unionByName, parts)))
    out = aligned(*lines, by=["id", "axis", "by_place"])
    return out.withColumn("method", F.when(F.col("by_place"), "positional").otherwise(F.col("method"))).drop("by_place")
