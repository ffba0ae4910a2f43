"""Segments of an axis, confirmed columns, governing rules, and identity by each policy, on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import segments


def rows(spark, keys, header=None, footer=None):
    return spark.createDataFrame([("r", i, k, header, footer) for i, k in enumerate(keys, 1)], "axis string, i long, k string, header long, footer long")


def events(d):
    return sorted(((r.segment if "segment" in d.columns else "", r.base, r.current, r.event) for r in d.collect()), key=str)


def test_preamble_from_its_end_and_footer_from_its_start(spark):
    b, c = rows(spark, ["t", "h", "x", "y", "sum"], 2, 5), rows(spark, ["new", "t", "h", "y", "x", "sum", "note"], 3, 6)
    got = events(segments.segmented(b, c, ["axis"], ["k"], "i", "header", "footer"))
    assert got == sorted([("preamble", 1, 2, "paired"), ("preamble", 2, 3, "paired"), ("preamble", None, 1, "inserted"), ("body", 3, 5, "paired"), ("body", 4, 4, "paired"), ("footer", 5, 6, "paired"), ("footer", None, 7, "inserted")], key=str)
    plain = events(segments.segmented(rows(spark, ["x"]), rows(spark, ["x"]), ["axis"], ["k"], "i", "header", "footer"))
    assert plain == [("body", 1, 1, "paired")]


@pytest.mark.parametrize(("policy", "want"), [
    ("skip", [(1, 2, "paired"), (2, None, "skipped"), (3, None, "skipped"), (None, 1, "skipped"), (4, None, "deleted"), (None, 3, "inserted")]),
    ("occurrence", [(1, 2, "paired"), (2, 1, "paired"), (3, None, "deleted"), (4, None, "deleted"), (None, 3, "inserted")]),
    ("position", [(1, 2, "paired"), (2, 1, "paired"), (3, 3, "paired"), (4, None, "deleted")]),
])
def test_policies(spark, policy, want):
    b, c = rows(spark, ["u", "d", "d", "gone", None]), rows(spark, ["d", "u", "new"])
    got = segments.identified(b, c, ["axis"], ["k"], "i", policy)
    assert sorted(((r.base, r.current, r.event) for r in got.collect()), key=str) == sorted(want, key=str)
    assert segments.identified(b.limit(0), c.limit(0), ["axis"], ["k"], "i", policy).count() == 0


def test_confirmed_columns(spark):
    cols = lambda ns: spark.createDataFrame([("r", n) for n in ns], "region string, col long")
    m = spark.createDataFrame([("r", 1, 3), ("r", 9, 4), ("s", 2, 2)], "region string, base long, current long")
    got = {(r.base, r.current, r.event, r.moved) for r in segments.confirmed_columns(cols([1, 2, 3]), cols([1, 2, 3, 4]), m, "region").collect()}
    assert got == {(1, 3, "paired", True), (2, 1, "paired", False), (3, 2, "paired", False), (None, 4, "inserted", False)}


def test_governing_rule(spark):
    regions = spark.createDataFrame([(1, "S", 1, 100_000, 1, 3), (2, "S", 1, 5, 5, 6), (3, "T", 1, 9, 1, 9)], "id long, sheet string, min_row long, max_row long, min_col long, max_col long")
    rules = spark.createDataFrame([("late", "S", 3, 2, 2), ("first", "S", 90_000, 3, 1), ("outside", "S", 6, 5, 0), ("other", "S", 5, 5, 7)], "rule string, sheet string, row long, col long, place long")
    assert {r.id: r.rule for r in segments.governing(regions, rules).collect()} == {1: "first", 2: "other", 3: None}


def test_key_parts(spark):
    d = spark.createDataFrame([(" Ab ", "text"), ("ab", "text"), ("5", "number"), ("5", "text"), ("  ", "text"), (None, "blank")], "v string, t string")
    part = lambda **k: [r.p for r in d.select(segments.key_part(F.col("v"), F.col("t"), **k).alias("p")).collect()]
    a = part()
    assert a[0] == a[1] and a[2] != a[3] and a[4] is a[5] is None
    b, c = part(exact=True), part(exact=True, trim=True)
    assert b[0] != b[1] and c[0] == "text:Ab" and c[0] != c[1]
