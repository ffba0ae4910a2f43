"""Operators that no query's SQL checks, on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import periods, privacy
from tallyloom.operators import celldiff, controls, graph, keys, layout, packages, parts, review, triage

CELL = "sheet string, row long, col long, value string, vtype string, num double, formula string"


def cells_of(spark, rows):
    """rows: sheet, row, col, value; numbers are number cells."""
    made = [(s, r, c, str(v), "number" if isinstance(v, (int, float)) else "text", float(v) if isinstance(v, (int, float)) else None, None) for s, r, c, v in rows]
    return periods.with_period(spark.createDataFrame(made, CELL), "value", "period")


def tuples(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_orientation(spark):
    months = ["Jan-26", "Feb-26", "Mar-26", "Apr-26", "May-26"]
    sheets = {
        "wide": [("wide", 1, c + 2, m) for c, m in enumerate(months)] + [("wide", 2, c + 1, c) for c in range(6)],
        "tie": [("tie", 1, c + 2, m) for c, m in enumerate(months)] + [("tie", r + 2, 1, m) for r, m in enumerate(months)],
        "few": [("few", r + 2, 1, m) for r, m in enumerate(months[:2])] + [("few", 1, 1, "x")],
        "back": [("back", 1, c + 2, m) for c, m in enumerate(reversed(months))],
        "inner": [("inner", 3, c + 1, m) for c, m in enumerate(months)] + [("inner", 1, 1, "t"), ("inner", 2, 1, "u")],
        "pinned": [("pinned", 1, 1, "x")],
    }
    cells = cells_of(spark, [x for s in sheets.values() for x in s])
    boxes = cells.groupBy("sheet").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    pins = spark.createDataFrame([("pinned", 1, 9, 1, 4, "long", None, 2)], "sheet string, min_row long, max_row long, min_col long, max_col long, orientation string, header_row long, key_col long")
    found = layout.oriented(cells, boxes, pins, spark.createDataFrame([("few",)], "sheet string"))
    got = {r.sheet: (r.orientation, r.header_row, r.key_col) for r in found.collect()}
    assert got == {"wide": ("wide", 1, 1), "tie": ("block", None, 1), "back": ("wide", 1, 2), "inner": ("block", None, 1), "pinned": ("long", 1, 2)}
    assert {r.sheet: r.orientation for r in layout.oriented(cells, boxes).collect()}["few"] == "long"
    assert tuples(layout.suggestions(cells, found), "sheet", "axis", "anchor", "periods") == [("inner", "columns", 3, 5), ("tie", "rows", 1, 5)]


def test_values_of_a_refreshed_block(spark):
    b = "struct<value:string,vtype:string,num:double,formula:string,period:" + periods.TYPE + ",number_format:string,style:string>"
    rows = [
        (1, "Jun-26", "text", None, "Jul-26", "text", None), (2, "10", "number", 10.0, "12", "number", 12.0), (3, "10", "number", 10.0, "-10", "number", -10.0), (4, "5", "number", 5.0, None, None, None), (5, None, None, None, "7", "number", 7.0), (6, "a", "text", None, "a", "text", None),
    ]
    d = spark.createDataFrame(rows, "row long, x string, xt string, xn double, y string, yt string, yn double")
    side = lambda v, t, n, fmt: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("value"), F.col(t).alias("vtype"), F.col(n).alias("num"), F.lit(None).cast("string").alias("formula"), periods.parse_period(F.col(v)).alias("period"), F.lit(fmt).alias("number_format"), F.lit("s").alias("style"))).cast(b)
    pairs = d.select(F.lit("r").alias("id"), F.lit("S").alias("sheet"), F.lit("block").alias("orientation"), F.col("row").alias("base_row"), F.lit(1).alias("base_col"), "row", F.lit(1).alias("col"), side("x", "xt", "xn", "0").alias("b"), side("y", "yt", "yn", "0.0").alias("c"))
    none = spark.createDataFrame([], "id string, place long, context string")
    box = lambda lo, hi: spark.createDataFrame([("S", lo, hi, 1, 1)], "sheet string, min_row long, max_row long, min_col long, max_col long")
    got = celldiff.value_findings(pairs, none, ignore=box(5, 5), refresh=box(3, 3))
    values = tuples(got.where("finding_class = 'value_changed'"), "row", "subtype", "materiality", "temporal_context", "expected_reason")
    assert values == [(1, "replacement", None, None, "period_progression"), (2, "replacement", "material", "current_period", None), (3, "replacement", "material", None, "profile_refresh"), (4, "cleared_population", None, None, None)]
    assert got.where("finding_class = 'number_format_changed'").count() == 4


def test_contained_in_large_rectangles(spark):
    rng = random.Random(4)
    points = [("S", rng.randint(1, 1_048_576), rng.randint(1, 16_384)) for _ in range(300)]
    boxes = [("S", 1, 1_048_576, 3, 9000), ("S", 1, 1_048_576, 1, 16_384), ("S", 500_000, 500_000, 1, 16_384)] + [("S", r, r + rng.randint(0, 200_000), c, c + rng.randint(0, 9000)) for r, c in ((rng.randint(1, 900_000), rng.randint(1, 9_000)) for _ in range(60))]
    p, b = spark.createDataFrame(points, "sheet string, row long, col long"), spark.createDataFrame([(*x, i) for i, x in enumerate(boxes)], "sheet string, min_row long, max_row long, min_col long, max_col long, box int")
    want = sorted((r, c, i) for _, r, c in points for i, (_, a, z, f, t) in enumerate(boxes) if a <= r <= z and f <= c <= t)
    assert tuples(graph.contained(p, b), "row", "col", "box") == want


def test_required_over_many_positions(spark):
    controls_share, controls.SHARE = controls.SHARE, 7
    try:
        rows, cols = spark.range(20).withColumnRenamed("id", "r"), spark.range(50).withColumnRenamed("id", "c")
        full = rows.crossJoin(cols).where("r = 3 or (r + c) % 3 > 0")
        assert tuples(controls.required(full, rows, cols, ["r"], ["c"]), "r", "c") == [(r, c) for r in range(20) for c in range(50) if r != 3 and (r + c) % 3 == 0]
    finally:
        controls.SHARE = controls_share


def rules(spark, rows):
    kind = "id long, sheet string, kind string, operator string, formula1 string, formula2 string, target string, boxes array<struct<min_row:int,max_row:int,min_col:int,max_col:int>>"
    return spark.createDataFrame([(i, "S", "whole", op, f1, f2, str(box), [box]) for i, op, f1, f2, box in rows], kind)


def test_rules_match_by_condition_target_and_likeness(spark):
    base = rules(spark, [(1, "between", "1", "9", (1, 9, 1, 1)), (2, "between", "A1", "5", (20, 29, 1, 1)), (3, "less", "4", None, (40, 49, 1, 1)), (4, "less", "4", None, (60, 69, 9, 9)), (5, "x", None, None, (80, 81, 1, 1))])
    now = rules(spark, [(11, "between", "1", "9", (2, 9, 1, 1)), (12, "equal", "7", None, (20, 29, 1, 1)), (13, "less", "5", None, (45, 60, 1, 1)), (14, "more", "A", None, (45, 60, 1, 2)), (15, "y", None, None, (99, 99, 1, 1))])
    pairs = parts.matched_rules(base, now, ["formula1", "formula2"], ["formula1", "formula2"], parts.SAME_FORMULA)
    assert tuples(pairs, "base_id", "current_id", "pass") == [(1, 11, "condition"), (2, 12, "target"), (3, 13, "likeness")]
    found = parts.rule_findings(base, now, pairs, {"target": ["target"], "condition": ["operator", "formula1", "formula2"]}, "data_validation")
    assert sorted((r.base_id or 0, r.current_id or 0, r.finding_class.removeprefix("data_validation_")) for r in found.collect()) == [
        (0, 14, "added"), (0, 15, "added"), (1, 11, "target_changed"), (2, 12, "condition_changed"), (3, 13, "condition_changed"), (3, 13, "target_changed"), (4, 0, "removed"), (5, 0, "removed"),
    ]


def test_charts_and_series(spark):
    kind = "id long, sheet string, title string, signature array<string>, anchor string, source_index int"
    base = spark.createDataFrame([(1, "S", "Growth", ["a"], "x", 0), (2, "S", "Twin", ["b"], "y", 1), (3, "S", "Twin", ["c"], "z", 2), (4, "S", None, ["d", "E"], None, 3), (5, "S", None, [], None, 9)], kind)
    now = spark.createDataFrame([(11, "S", "GROWTH", ["q"], "x", 5), (12, "S", "twin", ["b"], None, 6), (13, "S", "Twin", ["r"], None, 7), (14, "S", None, ["e", "D"], None, 8), (15, "S", None, [], None, 9)], kind)
    pairs = parts.matched_charts(base, now)
    assert tuples(pairs, "base_id", "current_id", "pass") == [(1, 11, "title"), (2, 12, "signature"), (3, 13, "title in order"), (4, 14, "signature"), (5, 15, "index")]
    kind = "chart long, id long, name string, values_ref string, categories_ref string, categories array<string>, source_index int"
    a = spark.createDataFrame([(1, 1, "Sales", "Data!$B$2:$B$9", "c", ["1", "2"], 0), (1, 2, "Old", "r1", None, ["1"], 1), (1, 3, "Roll", "r2", "c2", ["1", "2", "3"], 2), (1, 4, "Gone", "r3", None, [], 3)], kind)
    b = spark.createDataFrame([(11, 1, "sales", "Data!$B$2:$B$10", "c", ["1", "2"], 0), (11, 2, "New", "r1", None, ["1"], 1), (11, 3, "Roll", "r9", "c2", ["2", "3", "4"], 2)], kind)
    got = tuples(parts.series_findings(a, b, pairs.where("base_id = 1")).fillna(0).fillna(""), "base_id", "current_id", "finding", "expected_reason")
    assert got == [(1, 1, "chart_series_source_changed", "range_extension"), (2, 2, "chart_series_renamed", ""), (3, 3, "chart_series_source_changed", "rolling_window"), (4, 0, "chart_series_removed", "")]


def test_modules(spark):
    base = spark.createDataFrame([("A", "x\ny\nz"), ("B", "same"), ("C", "gone")], "module string, code string")
    now = spark.createDataFrame([("A", "x\nY\nz\nw"), ("B", "same"), ("D", "new")], "module string, code string")
    assert {r.module: (r.event, r.lines) for r in parts.modules(base, now).collect()} == {"A": ("changed", ["2-2", "4-4"]), "C": ("removed", None), "D": ("added", None)}


@pytest.mark.parametrize(("a", "b", "want"), [("S!$A$1:$B$9", "S!$A$1:$B$12", True), ("S!A1:B9", "S!A1:AA9", True), ("A1:B9", "A1:C10", False), ("A1:B9", "A2:B10", False), ("A1:B9", "A1:B8", False), ("name", "name2", False), (None, "A1:B2", False)])
def test_extension(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(parts.is_extension(F.col("a"), F.col("b"))).first()[0] is want


def test_triage_rules(spark):
    rows = [("row_deleted", "rolling_turnover", None, None, "x"), ("row_deleted", "physical_deletion", None, None, "x"), ("value_changed", None, "material", "current_period", "x"), ("style_changed", None, None, None, "x"), ("formula_inconsistent", None, None, None, "inherited")]
    d = spark.createDataFrame([(*r, None) for r in rows], "finding_class string, subtype string, materiality string, temporal_context string, provenance string, expected_reason string")
    s = triage.severity(subtype="subtype", overrides={"style_changed": "critical"}, tiers={"material": "info"})
    assert [r[0] for r in d.select(s).collect()] == ["warning", "critical", "info", "critical", "info"]
    old = triage.expired(spark, [{"finding_class": "c", "reason": "r", "expires": "2020-01-01"}, {"finding_class": "d", "reason": "r", "expires": "2999-01-01"}], "2026-01-01")
    assert tuples(old, "element", "finding_class") == [("c", "waiver_expired")]
    f = spark.createDataFrame([("a", "S"), ("a", "T"), ("a", None), ("b", "S"), (None, None)], "member string, sheet string")
    assert len(triage.in_scope(f, "member", "sheet", ["a"], {"a": ["S"]}).collect()) == 3


def test_review(spark):
    f = spark.createDataFrame([("S", "k", 1, 1), ("S", "k", 1, 2), ("S", "k", 3, 3), ("S", None, 1, 3), ("S", "k", None, None)], "sheet string, kind string, row long, col long")
    got = sorted((r.kind or "", r.min_row or 0, r.max_col or 0, r.members) for r in review.grouped(f, ["kind"]).collect())
    assert got == [("", 1, 3, 1), ("k", 0, 0, 1), ("k", 1, 2, 2), ("k", 3, 3, 1)]
    d = spark.createDataFrame([("g", "warning", None, False), ("g", "info", "mine", True), ("h", "info", None, False)], "group string, severity string, comment string, manual boolean")
    out = review.decided(d, spark.createDataFrame([("g", "critical", "all")], "group string, severity string, comment string"), "group")
    assert sorted((r.group, r.severity, r.comment or "") for r in out.collect()) == [("g", "critical", "all"), ("g", "info", "mine"), ("h", "info", "")]
    s = spark.createDataFrame([(1, f"F{i:02}", f"t{i}", f"e{i}", "info") for i in range(12)], "story int, finding string, title string, line string, severity string")
    r = review.told_stories(s, "story", "title", "line").first()
    assert (r.title, r.members, r.info, r.evidence) == ("t0", 12, 12, [f"e{i}" for i in range(8)])
    assert tuples(review.represented(spark.createDataFrame([(None,), (5,)], "member_count int"))) == [(2, 6)]


def test_hidden_texts(spark):
    d = spark.createDataFrame([("Acme sold $1.2M in Q3 2026-05",)], "t string").select(privacy.redacted(F.col("t"), 7, "A1").alias("r"), "t")
    r = d.select("r", privacy.leaks(F.col("r"), F.array(F.lit("acme"), F.lit("sold"))).alias("l")).first()
    assert "$1.2M" in r.r and "2026-05" in r.r and "Acme" not in r.r and r.l == []
    files = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "path string, content binary")
    assert [x.paths for x in privacy.duplicates(files).collect()] == [["a", "b"]]


def test_keys_and_packages(spark):
    cells = spark.createDataFrame([("S", 1, 1, "Title", "text"), ("S", 2, 1, "a", "text"), ("S", 2, 2, "b", "text"), ("S", 3, 1, "1", "number"), ("T", 1, 1, "1", "number")], "sheet string, row int, col int, value string, vtype string")
    assert tuples(keys.header_rows(cells)) == [("S", 2)]
    c = spark.createDataFrame([("S", "a", 1.0, 1.0, 0.95, 0.5, 20_000), ("S", "b", 0.5, 1.0, 0.99, 0.5, 20_000)], "sheet string, key string, coverage double, uniqueness double, overlap double, displaced double, projected long")
    assert tuples(keys.evaluated(c), "key", "suggested", "rank") == [("a", True, 1), ("b", False, 2)]
    both = packages.merged({"x": spark.range(2), "y": spark.range(1)})
    assert tuples(both, "member", "id") == [("x", 0), ("x", 1), ("y", 0)]
    t = spark.createDataFrame([("t", 1, 3, 5, 5, "g")], "target string, min_row int, max_row int, min_col int, max_col int, group string")
    p = spark.createDataFrame([("g", 11, 13, 2, 2, r, 2, f"p{r}") for r in (11, 12, 13)], "group string, min_row int, max_row int, min_col int, max_col int, row int, col int, period string")
    assert tuples(controls.governing(t, p), "row", "period") == [(1, "p11"), (2, "p12"), (3, "p13")]
