"""As-of joins against looking through all rows, with keys larger than a task, and candidates ranked with labels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.similarity import token_set_ratio
from tallyloom.operators import asof, crosscheck
from tallyloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(left, right, strict, following):
    out = []
    for i, k, t in left:
        ok = [(u, v) for q, u, v in right if None not in (k, t, q, u) and q == k and ((u > t if strict else u >= t) if following else (u < t if strict else u <= t))]
        best = (min(ok) if following else max(ok)) if ok else (None, None)
        out.append((i, k, t, *best))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("following", [False, True])
def test_random_rows(spark, strict, following):
    r = random.Random(7)
    key = lambda: r.choice(["hot"] * 6 + ["b", "c", "d", None])
    left = [(i, key(), r.choice([*range(60), None])) for i in range(300)]
    right = [(key(), r.choice([*range(0, 60, 3), None]), v) for v in range(40)]
    a, b = spark.createDataFrame(left, "i long, k string, t long").repartition(5), spark.createDataFrame(right, "k string, u long, v long").repartition(3)
    got = asof.asof(a, b, ["k"], "t", "u", tie="v", strict=strict, following=following)
    assert got.columns == ["i", "k", "t", "u", "v"]
    assert sorted(map(tuple, got.collect())) == plain(left, right, strict, following)


def test_one_key_over_many_tasks(spark):
    """The last right row lies many tasks before; others have none at all."""
    a = spark.range(5000).selectExpr("id as i", "'one' as k", "id + 10 as t").unionByName(spark.range(50).selectExpr("-1 - id as i", "'other' as k", "id as t"))
    b = spark.createDataFrame([("one", 5, 1.5), ("one", 12, 2.5), ("zzz", 1, 9.0)], "k string, u long, v double")
    got = {r.i: r.v for r in asof.asof(a, b, ["k"], "t", "u").collect()}
    assert got == {i: 1.5 if i < 2 else 2.5 for i in range(5000)} | {-1 - i: None for i in range(50)}


def test_two_keys_empty_sides_and_clashes(spark):
    a = spark.createDataFrame([(1, "x", 1, 5), (2, "x", 2, 5)], "i long, k string, m int, t long")
    b = spark.createDataFrame([("x", 2, 3, [7, 8])], "k string, m int, u long, v array<long>")
    assert {r.i: r.v for r in asof.asof(a, b, ["k", "m"], "t", "u").collect()} == {1: None, 2: [7, 8]}
    assert {r.i: r.v for r in asof.asof(a, b.limit(0), ["k", "m"], "t", "u").collect()} == {1: None, 2: None}
    assert asof.asof(a.limit(0), b, ["k", "m"], "t", "u").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof.asof(a, b.withColumnRenamed("v", "I"), ["k", "m"], "t", "u")


def test_labelled_candidates(spark):
    q = catalogue.queries()["labelled_candidates"](spark, DATA).collect()
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet").collect()
    nation = {r.n_nationkey: r.n_name for r in read("nation")}
    segments = ("automobile", "BUILDING", "furniture", "HOUSEHOLD", "machinery")
    customers, want = read("customer"), {}
    for s in read("supplier"):
        m = math.floor(abs(s.s_acctbal) / 10 + 0.5) / 100
        value = (-m if s.s_acctbal < 0 else m) * 1000
        context = f"Balance of {segments[s.s_suppkey % 5].upper()} {nation[s.s_nationkey]}"
        found = []
        for c in customers:
            shown = abs(c.c_acctbal / 1000 - (-m if s.s_acctbal < 0 else m)) <= 0.5 * 0.01 + 1e-9
            diff = abs(c.c_acctbal - value) / abs(value) if value else abs(c.c_acctbal)
            if shown or diff <= 0.05:
                found.append((not shown, -token_set_ratio(context, f"Accounts {c.c_mktsegment} Balance"), diff, f"D{c.c_custkey + 2}", c.c_custkey + 2))
        want[s.s_suppkey] = [x[4] for x in sorted(found)[:5]]
    got = {k: [] for k in want}
    for r in sorted(q, key=lambda r: r.rank):
        got[r.figure_id].append(r.row)
    assert got == want and any(r.label_score > 60 for r in q)


def ranked(figures, cells, most):
    """Of each figure (id, value, decimals, context) the best cells (sheet, row, label, value), by looking through all."""
    out = {}
    for i, v, decimals, context in figures:
        found = []
        for sheet, row, label, x in cells:
            shown = abs(x - v) <= 0.5 * 10.0**-decimals + 1e-9
            diff = abs(x) if v == 0 else abs(x - v) / abs(v)
            if shown or diff <= 0.05:
                score = token_set_ratio(context, f"{sheet} {label} ") if context is not None else 0.0
                found.append((not shown, -score, diff, sheet, f"D{row}"))
        out[i] = [x[3:] for x in sorted(found)[:most]]
    return out


@pytest.mark.parametrize("with_context", [False, True])
def test_candidates_of_many_near_values(spark, with_context):
    """Ties of value and of distance, zero, both signs, labels that differ, ends of the values; and no join of all that is near."""
    r = random.Random(9)
    values = [0.0, -0.0, 1e6, -1e6] + [r.choice([-1, 1]) * r.randrange(90, 120) / r.choice([1, 2, 4]) for _ in range(300)]
    cells = [(r.choice(["A", "B"]), i, r.choice(["north", "south", "west"]), v) for i, v in enumerate(values)]
    figures = [(i, float(v), r.choice([0, 2]), f"{r.choice(['north', 'south', 'east'])} total" if with_context else None) for i, v in enumerate([0, 100, -100, 105, 60, -30, 5, 1e6, 25, 119])]
    c = spark.createDataFrame([(s, i, 4, label, v) for s, i, label, v in cells], "sheet string, row long, col long, row_label string, value double")
    f = spark.createDataFrame([(i, abs(v), 1.0, False, d, v < 0, v, t) for i, v, d, t in figures], "figure_id long, mantissa double, scale double, percent boolean, decimals int, negative boolean, figure_value double, context string")
    got = {i: [] for i, *_ in figures}
    out = crosscheck.candidates(f if with_context else f.drop("context"), c, 3)
    for x in sorted(out.collect(), key=lambda x: x["rank"]):
        got[x.figure_id].append((x.sheet, f"D{x.row}"))
    assert got == ranked(figures, cells, 3)


def test_candidates_join_few_rows(spark):
    """A figure near all of 20,000 cells is joined with the nearest ones only."""
    n = 20_000
    c = spark.range(n).select(F.lit("A").alias("sheet"), F.col("id").alias("row"), F.lit(4).alias("col"), (1000 + F.col("id") / n).alias("value"))
    f = spark.range(50).select(F.col("id").alias("figure_id"), F.lit(1000.5).alias("mantissa"), F.lit(1.0).alias("scale"), F.lit(False).alias("percent"), F.lit(3).alias("decimals"), F.lit(False).alias("negative"), F.lit(1000.5).alias("figure_value"))
    out = crosscheck.candidates(f, c)
    assert {x.row for x in out.collect()} == {n // 2 + i for i in range(-2, 3)}
    assert joined(out) <= n  # not 50 times as many


def joined(df):
    """The most rows that a join of the executed plan gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name.endswith("JoinExec"):
                most = max(most, p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most
