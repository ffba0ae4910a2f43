"""What changed between two versions of a sheet: cells of aligned rows and columns, the axes themselves, and formulas.

Cells as in layout, with number_format and style where a source has them. Pairs of regions and their aligned axes as layout
gives them. Everything is a row for each finding; nothing here looks at a whole sheet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import formulas, numbers, periods
from tallyloom.operators import axes
from tallyloom.operators.diff import blank, values_differ
from tallyloom.operators.graph import contained
from tallyloom.operators.layout import BOX, axis_periods

FIELDS = ("value", "vtype", "num", "formula", "period", "number_format", "style")


def cell_pairs(base_held: DataFrame, current_held: DataFrame, pairs: DataFrame, axes: DataFrame) -> DataFrame:
    """Corresponding cells of paired rows and columns: id, sheet, orientation, base_row, base_col, row, col, and structs b and c (null: no cell).

    held: each side's layout.held_cells(). Only populated cells are joined, never the product of rows and columns.
    """
    rows = axes.where("axis = 'rows' and event = 'paired'").select("id", F.col("base_index").alias("base_row"), F.col("current_index").alias("row"))
    cols = axes.where("axis = 'columns' and event = 'paired'").select("id", F.col("base_index").alias("base_col"), F.col("current_index").alias("col"))

    def side(d: DataFrame, s: str, r: str, c: str) -> DataFrame:
        d = d.select("id", F.col("row").alias(r), F.col("col").alias(c), F.struct(*[F.col(f) if f in d.columns else F.lit(None).cast("string").alias(f) for f in FIELDS]).alias(s[0]))
        return d.join(rows, ["id", r]).join(cols, ["id", c])

    key = ["id", "base_row", "base_col", "row", "col"]
    j = side(base_held, "base", "base_row", "base_col").join(side(current_held, "current", "row", "col"), key, "full_outer")
    return j.join(pairs.select("id", "sheet", "orientation"), "id")


def in_ranges(cells: DataFrame, ranges: DataFrame | None, name: str) -> DataFrame:
    """cells with a boolean column: whether one of the ranges (sheet, BOX) holds the cell."""
    if ranges is None:
        return cells.withColumn(name, F.lit(False))
    hit = contained(cells.select("sheet", "row", "col").distinct(), ranges.select("sheet", *BOX)).select("sheet", "row", "col").distinct().withColumn(name, F.lit(True))
    return cells.join(hit, ["sheet", "row", "col"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def recency(held: DataFrame) -> DataFrame:
    """id, place, context of each dated place of a region's period axis that has data, within runs of neighbouring places of one kind that don't go back.

    A run's latest periods are recent, as many as its kind's window counts; dates take the window of the cadence that their
    median gap shows. Without a window, as for dates without a cadence, all is historical.
    """
    data = held.where("orientation = 'long' and col <> key_col").select("id", F.col("row").alias("place")).unionByName(held.where("orientation = 'wide' and row <> header_row").select("id", F.col("col").alias("place"))).distinct()
    dated = axis_periods(held).join(data, ["id", "place"], "left_semi")
    key = F.struct("period.k1", "period.k2", "period.k3")
    w = Window.partitionBy("id").orderBy("place")
    before = F.lag("period").over(w)
    goes_on = (F.col("place") == F.lag("place").over(w) + 1) & (F.col("period.kind") == before["kind"]) & ((key >= F.struct(before["k1"], before["k2"], before["k3"])) | periods.is_after(F.col("period"), before))
    dated = dated.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("band", F.sum("_new").over(w))
    days = dated.where("period.kind = 'date'").select("id", "band", F.make_date("period.k1", "period.k2", "period.k3").alias("date"))
    dated = dated.join(axes.date_cadence(days, ["id", "band"], "date").select("id", "band", "cadence"), ["id", "band"], "left")
    rank = F.dense_rank().over(Window.partitionBy("id", "band").orderBy(key.desc()))
    kind = F.when(F.col("period.kind") == "date", F.col("cadence")).otherwise(F.col("period.kind"))
    window = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in periods.RECENT.items() for x in kv]), kind), F.lit(0))
    return dated.select("id", "place", F.when(rank > window, "historical").when(rank == 1, "current_period").otherwise("recent_window").alias("context"))


def value_findings(pairs: DataFrame, contexts: DataFrame, *, absolute: float = 0.0, relative: float = 0.0, accepted: Column | None = None, ignore: DataFrame | None = None, refresh: DataFrame | None = None, value_only: DataFrame | None = None, blank_allowed: Column | None = None) -> DataFrame:
    """value_changed, number_format_changed and style_changed of corresponding cells.

    pairs: cell_pairs(). Cells in ignore ranges give nothing, those in value_only ranges no value_changed; formulas are
    compared elsewhere. materiality, context and anomalous are of replacements; expected_reason is period_progression,
    profile_refresh or null; segment says what the change is to its series: restatement, new_period, cleared_period.
    """
    b, c = F.col("b"), F.col("c")
    d = pairs
    for ranges, name in ((ignore, "_ignored"), (refresh, "_refreshed"), (value_only, "_value_only")):
        d = in_ranges(d, ranges, name)
    d = d.where(~F.col("_ignored"))
    advanced = F.coalesce(periods.is_after(c["period"], b["period"]), F.lit(False))
    moving = d.where(F.col("orientation") == "block").where(advanced).select("id").distinct().withColumn("_refresh_block", F.lit(True))
    place = F.when(F.col("orientation") == "long", F.col("row")).when(F.col("orientation") == "wide", F.col("col"))
    d = d.withColumn("place", place).join(moving, "id", "left").join(contexts, ["id", "place"], "left")
    no_b, no_c = b.isNull() | blank(b["value"]), c.isNull() | blank(c["value"])
    base, current = F.struct(b["vtype"].alias("vtype"), b["num"].alias("num"), b["value"].alias("txt")), F.struct(c["vtype"].alias("vtype"), c["num"].alias("num"), c["value"].alias("txt"))
    changed = F.coalesce(b["formula"], c["formula"]).isNull() & values_differ(F.when(b.isNotNull(), base), F.when(c.isNotNull(), current), absolute, relative) & ~F.col("_value_only")
    if blank_allowed is not None:
        changed = changed & ~(no_c & blank_allowed)
    subtype = F.when(no_c & ~no_b, "cleared_population").when(no_b & ~no_c, "added_population").otherwise("replacement")
    numeric = (b["vtype"] == "number") & (c["vtype"] == "number")
    replaced = subtype == "replacement"
    tier = F.when(replaced & numeric, numbers.materiality(b["num"], c["num"], F.coalesce(accepted, F.lit(False)) if accepted is not None else F.lit(False)))
    anomalous = F.coalesce(numeric & numbers.is_anomalous(b["num"], c["num"]), F.lit(False))
    reason = F.when(no_c, None).when(advanced, "period_progression").when(F.col("_refreshed"), "profile_refresh")
    refreshed_now = replaced & reason.isNull() & ~no_c & F.coalesce("_refresh_block", F.lit(False)) & numeric & ~anomalous
    context = F.when(refreshed_now, "current_period").when(replaced, F.col("context"))
    dated = F.col("context").isNotNull()
    segment = F.when(replaced & tier.isNotNull() & dated, "restatement").when((subtype == "added_population") & dated & (c["vtype"] == "number"), "new_period").when((subtype == "cleared_population") & dated & (b["vtype"] == "number"), "cleared_period")
    place_columns = ["id", "sheet", "base_row", "base_col", "row", "col"]
    none = F.lit(None).cast("string")
    values = d.where(changed).select(*place_columns, F.lit("value_changed").alias("finding_class"), subtype.alias("subtype"), tier.alias("materiality"), context.alias("temporal_context"), reason.alias("expected_reason"), segment.alias("segment"), b["value"].alias("baseline_value"), c["value"].alias("current_value"))
    out = values
    for field, name in (("number_format", "number_format_changed"), ("style", "style_changed")):
        x, y = b[field], c[field]
        out = out.unionByName(d.where(x != y).select(*place_columns, F.lit(name).alias("finding_class"), none.alias("subtype"), none.alias("materiality"), none.alias("temporal_context"), none.alias("expected_reason"), none.alias("segment"), x.alias("baseline_value"), y.alias("current_value")))
    return out


def low_confidence(axes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and sheet of regions whose axes matched too weakly to compare cells: one disclosure each instead."""
    return axes.where("unsure").select("id").distinct().join(pairs.select("id", "sheet"), "id")


def axis_findings(axes: DataFrame, base_held: DataFrame, current_held: DataFrame) -> DataFrame:
    """Rows and columns deleted, inserted, grown, or whose key changed in place: id, axis, index, finding_class, subtype, expected_reason.

    An index both deleted and inserted is one key change; growth without insertions makes deletions a rolling window's turnover.
    """
    d = axes.where("event <> 'paired'")
    gone = d.where("event = 'deleted'").select("id", "axis", F.col("base_index").alias("index"))
    came = d.where("event = 'inserted'").select("id", "axis", F.col("current_index").alias("index"))
    reused = gone.join(came, ["id", "axis", "index"], "left_semi")
    of = d.groupBy("id", "axis").agg(F.bool_or(F.col("event") == "growth").alias("grows"), F.bool_or(F.col("event") == "inserted").alias("inserts"), F.bool_or(F.col("event") == "deleted").alias("deletes"))
    kind = F.when(F.col("axis") == "rows", "row").otherwise("column")
    sliding = F.col("grows") & ~F.col("inserts")
    row = lambda df, event, subtype, reason: df.select("id", "axis", F.col("index").cast("long").alias("index"), F.concat(kind, F.lit(event)).alias("finding_class"), subtype.alias("subtype"), reason.cast("string").alias("expected_reason"))
    none = F.lit(None)
    deleted = row(gone.join(reused, ["id", "axis", "index"], "left_anti").join(of, ["id", "axis"]), "_deleted", F.when(sliding, "rolling_turnover").otherwise("physical_deletion"), none)
    inserted = row(came.join(reused, ["id", "axis", "index"], "left_anti"), "_inserted", F.lit("physical_insertion"), none)
    rolls = sliding & F.col("deletes")
    grown = row(d.where("event = 'growth'").withColumn("index", F.col("current_index")).join(of, ["id", "axis"]), "_growth", F.when(rolls, "rolling_turnover").otherwise("extent_growth"), F.when(rolls, "rolling_window").otherwise("cadence_extension"))

    def labels(held: DataFrame, s: str) -> DataFrame:
        down = held.where("col = key_col").select("id", F.lit("rows").alias("axis"), F.col("row").alias("index"), "formula", "period")
        across = held.where("row = header_row").select("id", F.lit("columns").alias("axis"), F.col("col").alias("index"), "formula", "period")
        return down.unionByName(across).select("id", "axis", "index", F.struct("formula", "period").alias(s))

    keys = reused.join(labels(base_held, "b"), ["id", "axis", "index"], "left").join(labels(current_held, "c"), ["id", "axis", "index"], "left")
    derived = F.col("b.formula").isNotNull() & F.col("c.formula").isNotNull()
    advanced = F.coalesce(periods.is_after(F.col("c.period"), F.col("b.period")), F.lit(False))
    changed = row(keys, "_key_changed", F.when(derived, "key_derived_label").otherwise("key_replacement"), F.when(advanced, "period_progression"))
    return deleted.unionByName(inserted).unionByName(grown).unionByName(changed)


def formula_findings(pairs: DataFrame) -> DataFrame:
    """What happened to formulas of corresponding cells: id, place, finding_class, expected_reason, subtype, detail.

    formula_hardcoded or formula_removed where one went (a value is left, or none); formula_logic_changed where relative forms
    differ: expected if ranges were only extended at their end, of subtype wrapped (detail: the function) if the old formula
    is now an argument, or reference_added (detail: the references). A formula where there was none gives nothing.
    """
    b, c = F.col("b"), F.col("c")
    event = F.when(c.isNotNull() & ~blank(c["value"]), "formula_hardcoded").otherwise("formula_removed")
    place = ["id", "sheet", "base_row", "base_col", "row", "col"]
    had = pairs.where(b["formula"].isNotNull()).select(*place, b["formula"].alias("_b"), c["formula"].alias("_c"), event.alias("_lost"))
    x = F.col("_x")
    found = F.when(F.col("_c").isNull(), F.col("_lost")).when(x["base"] != x["current"], "formula_logic_changed")
    subtype = F.when(x["wrapper"].isNotNull(), "wrapped").when(F.size(x["added"]) > 0, "reference_added")
    detail = F.when(x["wrapper"].isNotNull(), x["wrapper"]).when(F.size(x["added"]) > 0, F.array_join(x["added"], ","))
    d = formulas.with_comparison(had, "_b", "_c", ("base_row", "base_col"), ("row", "col"), "_x").where(found.isNotNull())
    return d.select(*place, found.alias("finding_class"), F.when(x["extended"], "range_extension").alias("expected_reason"), F.when(~x["extended"], subtype).alias("subtype"), F.when(~x["extended"], detail).alias("detail"))
