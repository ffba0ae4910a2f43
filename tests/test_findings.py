"""The step that findings of the cycle comparison share: months aligned, contexts joined, patterns counted."""

import random

import pytest
from pyspark.sql import functions as F
from volumes import shuffled_rows

from tallyloom.functions import periods
from tallyloom.operators import align, review, triage
from tallyloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(2))
def test_presence_as_keyed(spark, seed):
    """Where no key repeats, null parts included, presence() and grown() give what keyed() and with_growth() give."""
    r = random.Random(seed)
    labels = ["Jan-2024", "Feb-2024", "Mar-2024", "Q1 2024", "Q2 2024", "CW40", "CW02", "other", None]
    every = [(a, x) for a in (1, 2, 3, None) for x in labels]
    side = lambda: periods.with_period(spark.createDataFrame(r.sample(every, 18), "a long, label string"), "label", "period")
    b, c = side().cache(), side().cache()
    want = align.with_growth(align.keyed(b, c, ["a", "label"], ["label"]), b, F.col("period"), ["a"])
    want = want.select(F.coalesce("base.a", "current.a").alias("a"), F.coalesce("base.label", "current.label").alias("label"), "event")
    twice = c.unionByName(c)  # a key may come more than once on its way
    got = align.grown(periods.with_period(align.presence(b, twice, ["a", "label"]), "label", "period"), ["a"]).select("a", "label", "event")
    key = lambda d: sorted(map(repr, map(tuple, d.collect())))
    plain = lambda d: [x for x in key(d) if not x.startswith("(None")]  # noqa: E731  rows without an axis have their own latest in grown()
    assert plain(got) == plain(want) and len(key(got)) == len(key(want))


def test_patterns_are_hashed(spark):
    """Patterns are kept in a hash map, not sorted with all findings; a severity of no kind counts as none."""
    d = spark.createDataFrame([("a", "critical", "x2"), ("a", "critical", "x1"), ("a", None, "x3"), (None, "other", None)], "p string, severity string, location string")
    out = review.patterns(d, ["p"])
    assert {tuple(x) for x in out.collect()} == {("a", 3, 2, 0, 0, 0, "x1", "x3"), (None, 1, 0, 0, 0, 0, None, None)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_findings_shuffle(spark):
    """Orders meet their contexts and bills by one shuffle each, months are shuffled twice and parsed apart from the rows."""
    orders, lines = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "lineitem"))
    with shuffled_rows(spark) as told:
        catalogue.queries()["severity_subtotals"](spark, DATA).collect()
    print("rows shuffled", told, orders, lines)
    assert told[0] < 5 * orders + 4 * lines


def test_ordered_null_and_ties(spark):
    """Null sorts as empty; ids are 1 to n without gaps."""
    rows = [("warning", "a", s, str(i), "e", "c", "m") for i, s in enumerate(["S2", None, "S1", "S1"])] + [("critical", "a", "S9", None, "e", "c", "m")]
    d = spark.createDataFrame(rows, "severity string, artifact string, sheet string, location string, element string, finding_class string, message string")
    got = triage.ordered(d)
    assert got.columns == [*d.columns, "finding_id"]
    assert [(x.finding_id, x.severity, x.sheet, x.location) for x in got.orderBy("finding_id").collect()] == [("F0001", "critical", "S9", None), ("F0002", "warning", None, "1"), ("F0003", "warning", "S1", "2"), ("F0004", "warning", "S1", "3"), ("F0005", "warning", "S2", "0")]
