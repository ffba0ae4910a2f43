"""The manifest's proofs against a tree built level by level."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle
from tallyloom.llm import queries as Q
from tests.llm import plain
from tests.llm.test_llm_edges import ROWS, SCHEMA, sorted_rows

DATA = "/root/testdata/sf0.001"


def plain_rows(rows):
    return sorted(map(repr, plain.merkle([(d, s, lang, n, t) for d, t, lang, s, n in rows])))


def test_walk_gives_the_paths_of_a_whole_tree():
    for n in (1, 2, 3, 5, 31, 32, 33, 100, 127, 128):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        for height in {(n - 1).bit_length(), 8}:
            levels = [leaves]
            while len(levels) <= height:
                levels.append([merkle.parent(levels[-1][i], (levels[-1][i + 1 : i + 2] or [None])[0]) for i in range(0, len(levels[-1]), 2)])
            want = [[(levels[k][(j >> k) ^ 1 :][:1] or [None])[0] for k in range(height)] for j in range(n)]
            for subtree in (1, 2, 3, 5, 9):
                root, paths = merkle.walk(leaves, height, subtree)
                assert (root, list(paths)) == (levels[height][0], want)


def test_walk_keeps_few_nodes():
    leaves = [str(i) for i in range(1 << 10)]
    made = []
    before = merkle.Growth.__init__
    try:
        merkle.Growth.__init__ = lambda self, *a: (before(self, *a), made.append(self))[0]
        for _ in merkle.walk(leaves, 10)[1]:
            assert all(len(g.nodes) <= 1 << 6 and len(g.stack) <= 11 for g in made[-3:])
    finally:
        merkle.Growth.__init__ = before


@pytest.mark.parametrize("block", [2, 3, 10])
def test_rows_of_all_kinds(spark, block):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    for c in ("_idx", "_n", "_tree", "_part", "leaf", "root", "siblings", "other"):
        docs = docs.withColumn(c, F.lit("kept"))
    got = sorted_rows(merkle.report(docs, block))
    assert got == plain_rows(ROWS) and any("False" in r for r in got)


def test_empty_and_single(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(14, "only", None, "a", 2**63 - 1)]
    got = merkle.report(spark.createDataFrame(one, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == plain_rows(one)
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_carried_columns(spark):
    df = spark.range(50).select("id", F.lit("g").alias("group"), F.array("id").alias("extra"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.with_proofs(df, "group", ["id"], "leaf", block=3)
    assert got.columns == ["id", "group", "extra", "leaf", "siblings", "sides", "subroot", "root"]
    assert all(r.extra == [r.id] and r.sides[0] == "lr"[1 - r.id % 2] for r in got.collect())


def test_op11(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = Q.op11_merkle(spark, DATA), con.sql(Q.oracle_sql()["op11_merkle"])
    assert got.columns == want.columns
    rows = sorted_rows(got)
    assert rows == sorted(map(repr, want.fetchall()))
    assert rows == sorted(map(repr, plain.merkle(con.sql("select doc_id, source, lang, n_chars, text from documents").fetchall())))
