"""Clusters against all distances in every round, in Python and in SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import centroids
from tallyloom.llm import queries as Q
from tests.llm import plain
from tests.llm.test_llm_edges import sorted_rows

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def df(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def plain_rows(rows):
    return sorted(map(repr, plain.clusters(rows)))


def test_op12(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got, want = Q.op12_centroids(spark, DATA), con.sql(Q.oracle_sql()["op12_centroids"])
    assert got.columns == want.columns
    rows = sorted_rows(got)
    assert rows == sorted(map(repr, want.fetchall()))
    assert rows == plain_rows(con.sql("select vec_id, embedding from embeddings").fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_repeated_rows(spark, seed):
    r = np.random.default_rng(seed)
    grid = [(i, [int(x) / 2 for x in r.integers(-1, 2, 3)] + [0.0] * 61) for i in range(60)]  # many equal distances, floors below 0
    rows = grid + grid[:10] + [(None, grid[3][1]), (None, [0.25] * 64)]
    assert sorted_rows(centroids.report(df(spark, rows))) == plain_rows(rows)


def test_left_out_rows(spark):
    good = [(i, [math.sin(i * j) for j in range(64)]) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None, *[1.0] * 63]), (105, [math.nan] * 64), (106, [math.inf, *[0.0] * 63])]
    d = df(spark, good + bad)
    for c in ("v", "cluster", "distance", "upper", "inertia"):
        d = d.withColumn(c, F.lit("kept"))
    assert sorted_rows(centroids.report(d)) == plain_rows(good)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    rows = [(i, [float(i * j % 5) for j in range(64)]) for i in range(n)]
    assert sorted_rows(centroids.report(df(spark, rows))) == plain_rows(rows)
    same = [(i, [1.0] * 64) for i in range(n)]
    assert sorted_rows(centroids.report(df(spark, same))) == plain_rows(same)


def test_long_vectors(spark):
    rows = [(i, [(-1) ** i * 2.0**16 * (i + 1)] + [float(i)] * 63) for i in range(15)]
    assert sorted_rows(centroids.report(df(spark, rows))) == plain_rows(rows)
    with pytest.raises(Exception, match="too long for distances"):
        centroids.report(df(spark, [*rows, (99, [2.0**30] * 64)]))


def test_bounds_save_scans(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(8, 64)) * 40
    rows = [(i, (middles[i % 8] + r.normal(size=64)).tolist()) for i in range(400)]
    state, c = centroids.clustered(df(spark, rows))
    assert c.shape == (8, 64)
    got = [r.scans for r in state.collect()]
    assert len(got) == 400 and sum(got) < 400 * 4  # 11 rounds
    for x in state.collect():  # bounds hold
        d = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(np.frombuffer(x.v, "<i8"), m, strict=True))) for m in c]
        assert x.upper >= d[x.cluster] * (1 - 1e-12) and x.lower <= min(e for j, e in enumerate(d) if j != x.cluster) * (1 + 1e-12)
