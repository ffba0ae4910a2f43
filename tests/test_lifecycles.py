"""Findings across runs as a stream: run by run, all at once, and with rows that come too late."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history
from tallyloom.streaming import lifecycles

SCHEMA = "identity string, run long, severity string, digest string, finalized boolean, manual boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycles.ROCKS)
    yield
    spark.conf.set(name, before)


def streamed(spark, folder, batches, name):
    at = F.timestamp_seconds(F.col("run") * 86_400)
    rows = lambda b: spark.createDataFrame(b, SCHEMA).withColumn("at", at).coalesce(1)
    rows(batches[0]).write.parquet(f"{folder}/in")
    for i, b in enumerate(batches):
        if i:
            rows(b).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows(b).schema).parquet(f"{folder}/in")
        q = lifecycles.lifecycles(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()  # each batch by a stream of its own, which takes up the states of the one before
    return sorted(map(tuple, spark.read.schema(lifecycles.OUT).parquet(f"{folder}/out").collect()))


def test_batches(spark, rocks, tmp_path):
    r = random.Random(4)
    rows = []
    for i in range(25):
        for run in range(1, 6):
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                rows.append((f"f{i}", run, r.choice(["warning", "warning", "critical"]) if i % 3 else "info", r.choice("xy"), r.random() < 0.9, r.random() < 0.6))
    rows.append((None, 1, "info", "x", True, True))
    one = streamed(spark, str(tmp_path / "one"), [rows], "one")
    many = streamed(spark, str(tmp_path / "many"), [[x for x in rows if x[1] == k] for k in range(1, 6)], "many")
    assert one == many and {x[2] for x in one} == {"new", "exact", "changed", "resolved", "ambiguous"}
    d = spark.createDataFrame(rows, SCHEMA).where("identity is not null").withColumnRenamed("run", "run_id")
    recurring = {x.identity for x in history.recurring(d, ["identity"]).collect()}
    last = {}
    for identity, run, status, _, _, again in one:
        if status != "resolved":
            last[identity] = max(last.get(identity, (0, False)), (run, again))
    finals = {x.identity: x.m for x in d.groupBy("identity").agg(F.max("run_id").alias("m")).collect()}
    assert {i for i, (run, again) in last.items() if again and run == finals[i]} == recurring and recurring
    for run in range(1, 5):  # two runs at a time, as carried() sees them
        side = lambda k: d.where(F.col("run_id") == k)
        want = {(x.identity, x.status) for x in history.carried(side(run), side(run + 1), ["identity"], "digest").collect()}
        assert {(i, s) for i, k, s, *_ in one if k == run + 1} == want


def test_late_rows_change_nothing(spark, rocks, tmp_path):
    row = lambda run, digest: ("f", run, "info", digest, True, True)
    got = streamed(spark, str(tmp_path / "late"), [[row(1, "x")], [row(3, "x")], [row(2, "z")], [row(4, "x")]], "late")
    assert [(run, status, runs) for _, run, status, runs, _, _ in got if status != "late"] == [(1, "new", 1), (2, "resolved", 1), (3, "new", 2), (4, "exact", 3)]
