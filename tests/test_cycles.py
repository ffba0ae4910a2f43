"""Circular references against reachability from every vertex, and at sizes where pairs or layers would not end."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cycles


def plain(edges):
    """id -> smallest id of its set, by walking from each id both ways."""
    after, before = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
            before.setdefault(b, set()).add(a)

    def reach(start, step):
        found, front = set(), [start]
        while front:
            for y in step.get(front.pop(), ()):
                if y not in found:
                    found.add(y)
                    front.append(y)
        return found

    both = {x: reach(x, after) & reach(x, before) for x in {*after, *before}}
    return {x: min(s) for x, s in both.items() if x in s}


def found(df):
    return {r.id: r.cycle for r in df.collect()}


def frame(spark, edges):
    return spark.createDataFrame(edges or [(None, None)], "a long, b long")


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_in_small_blocks(spark, seed):
    r = random.Random(seed)
    n = 60
    near = [(i, i + r.choice([1, 1, 2, 3, -1, -4])) for i in range(n)]
    edges = near + [(r.randrange(n), r.randrange(n)) for _ in range(12)] + [(None, 1), (5, None)] + near[:5]
    got = cycles.cycles(frame(spark, edges), block=4, alone=10)
    assert found(got) == plain(edges)
    assert found(cycles.cycles(frame(spark, edges))) == plain(edges)


def test_graph_that_does_not_shrink_goes_by_colours(spark):
    r = random.Random(9)
    edges = [(r.randrange(30), r.randrange(30, 60)) for _ in range(90)] + [(r.randrange(30, 60), r.randrange(30)) for _ in range(60)] + [(61, 62), (62, 61), (63, 63)]
    assert found(cycles.cycles(frame(spark, edges), block=2, alone=5)) == plain(edges)


def test_no_edges_and_texts(spark):
    assert cycles.cycles(frame(spark, [])).count() == 0
    d = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z"), ("w", "w")], "a string, b string")
    assert found(cycles.cycles(d)) == {"x": "x", "y": "x", "w": "w"}


@pytest.mark.parametrize("kind", ["ring", "chain", "ladder"])
def test_hundred_thousand_cells(spark, kind):
    n = 100_000
    i = spark.range(n)
    one = i.select(F.col("id").alias("a"), ((F.col("id") + 1) % n if kind == "ring" else F.col("id") + 1).alias("b"))
    edges = one if kind != "ladder" else one.unionByName(i.select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"))).unionByName(spark.createDataFrame([(90_001, 70_000)], "a long, b long"))
    began = time.time()
    got = cycles.cycles(edges)
    sets = {r.cycle: r["count"] for r in got.groupBy("cycle").count().collect()}
    assert sets == {"ring": {0: n}, "chain": {}, "ladder": {70_000: 20_002}}[kind]
    assert time.time() - began < 120
    if kind == "ring":  # what the largest graph between the rounds needs is in proportion to the edges
        assert got.count() == n


def test_findings(spark):
    cells = spark.createDataFrame([(2, 1, r) for r in range(1, 12)] + [(7, 3, 1)], "cycle long, col long, row long").repartition(5)
    got = {r.cycle: r for r in cycles.findings(cells, "cycle", ["row"], F.concat(F.lit("S!A"), F.col("row").cast("string"))).collect()}
    names = [f"S!A{r}" for r in range(1, 12)]
    assert got[2].cells == 11 and got[2].location == "S!A1" and got[2].element == "; ".join(names[:8]) + "; +3 more cells"
    assert got[2].event_key == "excel-cycle:" + hashlib.sha256(json.dumps(names, separators=(",", ":")).encode()).hexdigest()[:12]
    assert got[7].element == "S!A1" and cycles.findings(cells.limit(0), "cycle", ["row"], F.lit("x")).count() == 0
