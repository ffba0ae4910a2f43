"""What a workbook holds besides cells: names, tables, rules, charts, links, macros; and how two versions of it differ.

Parts are rows with an id of their own and columns for what they say. Matching is a cascade of equality joins; only rules fall
back to likeness, over pairs whose ranges overlap.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.align import mutual_best, unique_cascade
from tallyloom.operators.diff import structure
from tallyloom.operators.graph import shared
from tallyloom.operators.objects import geometry_changed, series_window

# Points for an equal operator, for equal shapes of one of a validation's formulas, and of a format's formulas.
SAME_OPERATOR, SAME_FORMULA, SAME_FORMULAS, OVERLAP = 20, 15, 30, 10_000
# Kinds of risk that are links to other files; every other kind is active content. Links that only matter if reached.
EXTERNAL = ("external_link", "external_formula", "external_name", "ole_link", "dde_link")
PASSIVE = ("external_link", "external_name")
REFERENCE = r"^((?:'(?:[^']|'')+'|[^!']+)!)?\$?([A-Za-z]{1,3})\$?(\d+):\$?([A-Za-z]{1,3})\$?(\d+)$"


def is_extension(base: Column, current: Column) -> Column:
    """Whether a range keeps its sheet and start and reaches further down or to the right, not both."""
    part = lambda c, i: F.upper(F.regexp_extract(F.ltrim(c, F.lit("=")), REFERENCE, i))
    row = lambda c: part(c, 5).try_cast("long")
    col = lambda c: F.lpad(part(c, 4), 3, " ")
    same = (part(base, 1) == part(current, 1)) & (part(base, 2) == part(current, 2)) & (part(base, 3) == part(current, 3)) & (part(base, 2) != "") & (part(current, 2) != "")
    return F.coalesce(same & (((col(base) == col(current)) & (row(current) > row(base))) | ((row(base) == row(current)) & (col(current) > col(base)))), F.lit(False))


def visibility(base: DataFrame, current: DataFrame) -> DataFrame:
    """Sheets (sheet, state) whose visibility changed: sheet, before, after."""
    return base.select("sheet", F.col("state").alias("before")).join(current.select("sheet", F.col("state").alias("after")), "sheet").where("before <> after")


def names(base: DataFrame, current: DataFrame) -> DataFrame:
    """Defined names (scope, null for the workbook; name; ref): added, removed or changed, expected if the range was only extended."""
    found = structure(base, current, ["scope", "name"], ["ref"])
    cond = lambda t: F.col("d.scope").eqNullSafe(F.col(f"{t}.scope")) & (F.col("d.name") == F.col(f"{t}.name"))
    j = found.alias("d").join(base.alias("x"), cond("x"), "left").join(current.alias("y"), cond("y"), "left")
    expected = F.when((F.col("d.event") == "changed") & is_extension(F.col("x.ref"), F.col("y.ref")), "range_extension")
    return j.select("d.scope", "d.name", F.concat(F.lit("named_range_"), F.col("d.event")).alias("finding_class"), expected.alias("expected_reason"))


def tables(base: DataFrame, current: DataFrame, proved: DataFrame | None = None) -> DataFrame:
    """Native tables (id, name, source_id, sheet, ref, columns, settings): table_removed, added, renamed, range_changed, columns_reordered, columns_changed, settings_changed.

    Matched by name in any case, then by source_id and sheet, then by sheet, range and columns. A changed range is expected if
    its new rows are proved a later period: proved (id of the current table, reason).
    """
    keyed = lambda df: df.withColumn("_name", F.lower("name")).withColumn("_columns", F.array_join("columns", "\u0001"))
    pairs = unique_cascade(keyed(base), keyed(current), [("name", ["_name"]), ("source", ["source_id", "sheet"]), ("place", ["sheet", "ref", "_columns"])], "id")
    x, y = base.select(*[F.col(c).alias(f"{c}_b") for c in base.columns]), current.select(*[F.col(c).alias(f"{c}_c") for c in current.columns])
    j = pairs.join(x, F.col("base_id") == F.col("id_b")).join(y, F.col("current_id") == F.col("id_c"))
    reasons = proved.select(F.col("id").alias("current_id"), "reason") if proved is not None else None
    j = j.join(reasons, "current_id", "left") if reasons is not None else j.withColumn("reason", F.lit(None).cast("string"))
    reordered = F.array_sort("columns_b") == F.array_sort("columns_c")
    event = lambda cond, name, why=F.lit(None).cast("string"): F.when(cond, F.struct(F.lit(name).alias("finding"), why.alias("expected_reason")))
    events = F.array_compact(F.array(
        event(F.lower("name_b") != F.lower("name_c"), "table_renamed"),
        event((F.col("ref_b") != F.col("ref_c")) | (F.col("sheet_b") != F.col("sheet_c")), "table_range_changed", F.when(F.col("sheet_b") == F.col("sheet_c"), F.col("reason"))),
        event((F.col("columns_b") != F.col("columns_c")) & reordered, "table_columns_reordered"), event(~reordered, "table_columns_changed"),
        event(~F.col("settings_b").eqNullSafe(F.col("settings_c")), "table_settings_changed"),
    ))
    changed = j.select(F.col("base_id"), F.col("current_id"), F.explode(events).alias("e")).select("base_id", "current_id", "e.finding", "e.expected_reason")
    none = F.lit(None)
    gone = base.join(pairs.select(F.col("base_id").alias("id")), "id", "left_anti").select(F.col("id").alias("base_id"), none.cast(current.schema["id"].dataType).alias("current_id"), F.lit("table_removed").alias("finding"), none.cast("string").alias("expected_reason"))
    came = current.join(pairs.select(F.col("current_id").alias("id")), "id", "left_anti").select(none.cast(base.schema["id"].dataType).alias("base_id"), F.col("id").alias("current_id"), F.lit("table_added").alias("finding"), none.cast("string").alias("expected_reason"))
    return changed.unionByName(gone).unionByName(came)


def extension_proof(cells: DataFrame, tables_: DataFrame) -> DataFrame:
    """id, reason of current tables whose new rows (table, row, col, period, formula, grown) are proved a later period.

    A column proves it if all its cells are periods without formulas, and every new one follows the old ones' latest.
    """
    key = F.struct("period.k1", "period.k2", "period.k3")
    c = cells.groupBy("id", "col").agg(
        F.bool_and(F.col("period").isNotNull() & F.col("formula").isNull()).alias("dated"), F.max(F.when(~F.col("grown"), key)).alias("latest"), F.min(F.when(F.col("grown"), key)).alias("first"), F.countDistinct("period.kind").alias("kinds"),
    )
    good = c.where("dated and kinds = 1 and first > latest").select("id").distinct()
    return tables_.select("id").join(good, "id", "left_semi").withColumn("reason", F.lit("period_progression"))


def unpaired(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """Regions (id) that found no partner: id, side."""
    a = base.select("id").join(pairs.select(F.col("base_id").alias("id")), "id", "left_anti").withColumn("side", F.lit("baseline"))
    return a.unionByName(current.select("id").join(pairs.select(F.col("current_id").alias("id")), "id", "left_anti").withColumn("side", F.lit("current")))


def metadata(base: DataFrame, current: DataFrame) -> DataFrame:
    """Comments, queries and connections (kind, key, content: text, digest or the whole record): kind, key, finding_class."""
    found = structure(base, current, ["kind", "key"], ["content"])
    name = F.when(F.col("kind") == "comment", "cell_comment_changed").when(F.col("kind") == "query", "power_query_changed").otherwise("connection_changed")
    return found.select("kind", "key", "event", name.alias("finding_class"))


def line_ranges(base: str, current: str) -> list[str]:
    """Lines of the current text that changed, as first-last; of lines that only went, where they were."""
    a, b = base.split("\n"), current.split("\n")
    return [f"{j1 + 1}-{max(j2, j1 + 1)}" for op, _, _, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]


def modules(base: DataFrame, current: DataFrame) -> DataFrame:
    """Macro modules (module, code): module, event, and the changed ranges of lines."""

    @F.arrow_udf("array<string>")
    def ranges(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else line_ranges(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.string()))

    found = structure(base, current, ["module"], ["code"])
    j = found.join(base.select("module", F.col("code").alias("_a")), "module", "left").join(current.select("module", F.col("code").alias("_b")), "module", "left")
    return j.select("module", "event", F.when(F.col("event") == "changed", ranges(F.col("_a"), F.col("_b"))).alias("lines"))


def risks(base: DataFrame, current: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """A row for each kind of risk in the current workbook (kind, item): kind, finding_class, count, provenance.

    Passive links are left out where it is proved which are reached (reached: item) and none is.
    """
    n = current.groupBy("kind").agg(F.count("*").alias("count"))
    if reached is not None:
        live = current.join(reached.select("item").distinct(), "item", "left_semi").groupBy("kind").agg(F.count("*").alias("live"))
        n = n.join(live, "kind", "left").where(~F.col("kind").isin(*PASSIVE) | F.col("live").isNotNull()).drop("live")
    had = base.select("kind").distinct().withColumn("_had", F.lit(True))
    j = n.join(had, "kind", "left")
    return j.select("kind", F.when(F.col("kind").isin(*EXTERNAL), "external_link").otherwise("active_content").alias("finding_class"), "count", F.when(F.col("_had"), "inherited").otherwise("new").alias("provenance"))


def formula_shape(formula: Column) -> Column:
    """A formula without spaces and case, its numbers as #."""
    return F.regexp_replace(F.lower(F.replace(formula, F.lit(" "), F.lit(""))), r"\d+(\.\d+)?", "#")


def matched_rules(base: DataFrame, current: DataFrame, condition: list[str], formulas: list[str], points: int) -> DataFrame:
    """base_id, current_id, pass of validation or format rules: by equal condition, equal target, then each other's best likeness.

    Rules: id, sheet, kind, operator, target (text of the ranges), boxes (array of struct min_row, max_row, min_col, max_col), and
    the columns of condition and formulas. Likeness asks for the same sheet and kind and for ranges that overlap.
    """
    keyed = lambda df: df.withColumn("_condition", F.to_json(F.struct("sheet", "kind", "operator", *condition), {"ignoreNullFields": "false"}))
    b, c = keyed(base), keyed(current)
    found = shared(unique_cascade(b, c, [("condition", ["_condition"]), ("target", ["sheet", "target"])], "id"))
    rest_b = b.join(found.select(F.col("base_id").alias("id")), "id", "left_anti")
    rest_c = c.join(found.select(F.col("current_id").alias("id")), "id", "left_anti")
    boxes = lambda df, s: df.select("sheet", "kind", F.col("id").alias(f"id_{s}"), F.explode("boxes").alias("x")).select("sheet", "kind", f"id_{s}", *[F.col(f"x.{k}").alias(f"{k}_{s}") for k in ("min_row", "max_row", "min_col", "max_col")])
    overlap = "min_row_a <= max_row_b and min_row_b <= max_row_a and min_col_a <= max_col_b and min_col_b <= max_col_a"
    near = boxes(rest_b, "a").join(boxes(rest_c, "b"), ["sheet", "kind"]).where(overlap).select("id_a", "id_b").distinct()
    shape = lambda f, s: F.coalesce(formula_shape(F.col(f"{s}.{f}")), F.lit("\u0001"))
    j = near.join(rest_b.alias("x"), F.col("id_a") == F.col("x.id")).join(rest_c.alias("y"), F.col("id_b") == F.col("y.id"))
    score = F.lit(OVERLAP) + F.when(F.col("x.operator").eqNullSafe(F.col("y.operator")), SAME_OPERATOR).otherwise(0)
    for f in formulas:
        score = score + F.when(shape(f, "x") == shape(f, "y"), points).otherwise(0)
    best = mutual_best(j.select("id_a", "id_b", score.alias("score")), "id_a", "id_b", "score")
    return found.unionByName(best.select(F.col("id_a").alias("base_id"), F.col("id_b").alias("current_id"), F.lit("likeness").alias("pass")))


def rule_findings(base: DataFrame, current: DataFrame, pairs: DataFrame, facets: dict[str, list[str]], noun: str) -> DataFrame:
    """A row for each facet in which matched rules differ, and for rules without a partner: base_id, current_id, finding_class."""
    x, y = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns]), current.select(*[F.col(c).alias(f"c_{c}") for c in current.columns])
    j = pairs.join(x, F.col("base_id") == F.col("b_id")).join(y, F.col("current_id") == F.col("c_id"))
    differ = lambda cols: ~F.struct(*[F.col(f"b_{c}").alias(c) for c in cols]).eqNullSafe(F.struct(*[F.col(f"c_{c}").alias(c) for c in cols]))
    found = j.select("base_id", "current_id", F.explode(F.array_compact(F.array(*[F.when(differ(cols), F.lit(f"{noun}_{name}_changed")) for name, cols in facets.items()]))).alias("finding_class"))
    gone = base.join(pairs.select(F.col("base_id").alias("id")), "id", "left_anti").select(F.col("id").alias("base_id"), F.lit(None).cast(current.schema["id"].dataType).alias("current_id"), F.lit(f"{noun}_removed").alias("finding_class"))
    came = current.join(pairs.select(F.col("current_id").alias("id")), "id", "left_anti").select(F.lit(None).cast(base.schema["id"].dataType).alias("base_id"), F.col("id").alias("current_id"), F.lit(f"{noun}_added").alias("finding_class"))
    return found.unionByName(gone).unionByName(came)


def matched_charts(base: DataFrame, current: DataFrame) -> DataFrame:
    """base_id, current_id, pass of charts (id, sheet, title, signature: names of series, anchor: geometry, source_index).

    By title, signature, geometry where each occurs once, then by title and by signature in order, then by index.
    """
    keyed = lambda df: df.withColumn("_title", F.when(F.col("title") != "", F.lower("title"))).withColumn("_signature", F.when(F.size("signature") > 0, F.array_join(F.array_sort(F.transform("signature", F.lower)), "\u0001")))
    passes = [("title", ["sheet", "_title"]), ("signature", ["sheet", "_signature"]), ("geometry", ["sheet", "anchor"]), ("title in order", ["sheet", "_title"], "source_index"), ("signature in order", ["sheet", "_signature"], "source_index"), ("index", ["sheet", "source_index"])]
    return unique_cascade(keyed(base), keyed(current), passes, "id")


def series_findings(base: DataFrame, current: DataFrame, charts: DataFrame) -> DataFrame:
    """Series of matched charts (chart, id, name, values_ref, categories_ref, categories, source_index): added, removed, renamed, source changed.

    Matched by name, source, then index within a chart. A changed source is expected if its range was only extended, or its
    categories rolled on or were extended.
    """
    b = base.join(charts.select(F.col("base_id").alias("chart"), F.col("current_id").alias("_pair")), "chart")
    c = current.withColumn("_pair", F.col("chart"))
    keyed = lambda df: df.withColumn("_name", F.lower("name")).withColumn("_source", F.when(F.coalesce("values_ref", "categories_ref").isNotNull(), F.concat_ws("\u0001", F.coalesce("values_ref", F.lit("")), F.coalesce("categories_ref", F.lit("")))))
    c = c.join(charts.select(F.col("current_id").alias("chart")), "chart", "left_semi")
    pairs = shared(unique_cascade(keyed(b), keyed(c), [("name", ["_pair", "_name"]), ("source", ["_pair", "_source"]), ("index", ["_pair", "source_index"])], "id"))
    x, y = b.select(*[F.col(k).alias(f"b_{k}") for k in b.columns]), c.select(*[F.col(k).alias(f"c_{k}") for k in c.columns])
    j = pairs.join(x, F.col("base_id") == F.col("b_id")).join(y, F.col("current_id") == F.col("c_id"))
    window = series_window(F.col("b_categories"), F.col("c_categories"))
    moved = ~F.col("b_values_ref").eqNullSafe(F.col("c_values_ref")) | ~F.col("b_categories_ref").eqNullSafe(F.col("c_categories_ref"))
    why = F.when(is_extension(F.col("b_values_ref"), F.col("c_values_ref")) | (window == "extended"), "range_extension").when(window == "rolled", "rolling_window")
    event = lambda cond, name, reason=F.lit(None).cast("string"): F.when(cond, F.struct(F.lit(name).alias("finding"), reason.alias("expected_reason")))
    events = F.array_compact(F.array(event(~F.lower("b_name").eqNullSafe(F.lower("c_name")), "chart_series_renamed"), event(moved, "chart_series_source_changed", why)))
    changed = j.select("base_id", "current_id", F.explode(events).alias("e")).select("base_id", "current_id", "e.finding", "e.expected_reason")
    none = F.lit(None).cast("string")
    gone = b.join(pairs.select(F.col("base_id").alias("id")), "id", "left_anti").select(F.col("id").alias("base_id"), F.lit(None).cast(c.schema["id"].dataType).alias("current_id"), F.lit("chart_series_removed").alias("finding"), none.alias("expected_reason"))
    came = c.join(pairs.select(F.col("current_id").alias("id")), "id", "left_anti").select(F.lit(None).cast(b.schema["id"].dataType).alias("base_id"), F.col("id").alias("current_id"), F.lit("chart_series_added").alias("finding"), none.alias("expected_reason"))
    return changed.unionByName(gone).unionByName(came)


def chart_findings(base: DataFrame, current: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Of matched charts (id, fields, x, y, width, height): chart_<field>_changed, and chart_geometry_changed where it moved or grew enough."""
    x, y = base.select(*[F.col(k).alias(f"b_{k}") for k in base.columns]), current.select(*[F.col(k).alias(f"c_{k}") for k in current.columns])
    j = pairs.join(x, F.col("base_id") == F.col("b_id")).join(y, F.col("current_id") == F.col("c_id"))
    before = F.struct(*[F.col(f"b_{k}").alias(k) for k in ("x", "y", "width", "height")])
    moved = geometry_changed(F.col("c_x"), F.col("c_y"), F.col("c_width"), F.col("c_height"), before)
    found = [F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"c_{f}")), F.lit(f"chart_{f}_changed")) for f in fields] + [F.when(moved, F.lit("chart_geometry_changed"))]
    return j.select("base_id", "current_id", F.explode(F.array_compact(F.array(*found))).alias("finding_class"))


def chart_references(references: DataFrame, sheets: DataFrame) -> DataFrame:
    """References of charts' series (chart, series, role: values or categories, sheet, cells): chart, series, status valid, invalid (no such sheet or cells) or mismatch (lengths differ)."""
    known = sheets.select("sheet").distinct().withColumn("_known", F.lit(True))
    d = references.join(known, "sheet", "left").withColumn("_ok", F.coalesce("_known", F.lit(False)) & (F.coalesce("cells", F.lit(0)) > 0))
    s = d.groupBy("chart", "series").agg(F.bool_and("_ok").alias("ok"), (F.min("cells") < F.max("cells")).alias("differ"))
    return s.select("chart", "series", F.when(~F.col("ok"), "invalid").when(F.col("differ"), "mismatch").otherwise("valid").alias("status"))


def pivots(base: DataFrame, current: DataFrame) -> DataFrame:
    """Pivots (sheet, name, source, location): added, removed, or the changed fields."""
    return structure(base, current, ["sheet", "name"], ["source", "location"])


def external_connections(connections: DataFrame) -> DataFrame:
    """Connections (name, kind, target) that leave the workbook."""
    return connections.where(F.col("kind").isin("database", "web", "text", "olap") | F.col("target").rlike(r"(?i)^\w+://")).select("name", "kind", F.lit("external_connection").alias("finding_class"))


def numbered_rules(rules: DataFrame) -> DataFrame:
    """Rules with place: by priority (none last), then source_index, within their sheet."""
    return rules.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy(F.col("priority").asc_nulls_last(), "source_index")))
