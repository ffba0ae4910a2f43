"""Clusters of integer vectors around moving centroids, exact, with Hamerly's bounds.

Each vector carries an upper bound of the distance to its own centroid and one lower bound of that to every other. A round
loosens them by how far the centroids drifted; only where they, or half the way from the own centroid to its nearest neighbour,
don't decide is the own distance taken, and only where that doesn't decide either are all distances, in integers. Bounds are
rounded outwards and must differ strictly, so ties always reach the integers. Vectors that changed their cluster move their
components from one exact sum to the other; the driver sees sums and counts of clusters and nothing of single vectors. A round is
a table in the shared folder: a lost executor's part is made again from the round before.

Defined results: vectors that are null, of another length or with a null or non-finite component are left out; rows may repeat;
fewer vectors than clusters give as many clusters as vectors; ids that are null are the last to start a centroid; equal ids go by
the bytes of their components; no vectors give no rows. A vector whose squared length in steps exceeds 2**60, so that distances
might not fit a long, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.shared import discard, kept

DIMENSIONS, CLUSTERS, ROUNDS, STEPS, SEED = 64, 8, 10, 1024, 3
MOST_SQUARE = 2.0**60

#: v: components as little-endian integers of 64 bits; before: the cluster of the round before; scans: how often all distances were taken.
STATE = "vec_id long, v binary, cluster int, before int, upper double, lower double, scans int"
ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("before", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("scans", pa.int32())])

#: Beyond what rounding of a distance and of its root can come to.
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    width = 8 * m.shape[1]
    offsets = pa.py_buffer(np.arange(0, len(m) * width + 1, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(m), [None, offsets, pa.py_buffer(np.ascontiguousarray(m, "<i8"))])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows that packed() wrote."""
    if not len(column):
        return np.zeros((0, width), np.int64)
    _, offsets, data = column.cast(pa.binary()).buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, "<i8", len(column) * width, first).reshape(-1, width)


def integer_vectors(df: DataFrame, id_column: str, vector: str, dimensions: int = DIMENSIONS, steps: int = STEPS) -> DataFrame:
    """vec_id and v, the components in whole steps, of the vectors that are whole and finite."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("v")), dimensions), False))
            x = np.floor(steps * b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions))
            whole = np.isfinite(x).all(axis=1)
            if (np.square(x[whole]).sum(axis=1) > MOST_SQUARE).any():
                raise ValueError("a vector is too long for distances of 64 bits")
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(whole)), packed(x[whole].astype(np.int64))], names=["vec_id", "v"])

    own = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return own.mapInArrow(convert, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; so many rows reach the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([np.frombuffer(r.v, "<i8") for r in rows], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to one centroid, or each to its own."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), an upper bound of its distance and a lower one of all others'."""
    d = np.stack([squares(x, k) for k in c], axis=1)
    near = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(d)), near].astype(np.float64)) * UP
    if len(c) == 1:
        return near, upper, np.full(len(x), np.inf)
    return near, upper, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * DOWN


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far the one of all others that moved most, rounded up."""
    own = np.sqrt(squares(new, old).astype(np.float64)) * UP
    return own, np.array([np.delete(own, i).max(initial=0.0) for i in range(len(own))])


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one, rounded down."""
    return np.array([np.sqrt(np.delete(squares(c, k), i).min(initial=2**62).astype(np.float64)) / 2 * DOWN for i, k in enumerate(c)])


def assigned_first(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    def assign(batches):
        for b in batches:
            near, upper, lower = scanned(matrix(b.column("v"), c.shape[1]), c)
            n = len(near)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.nulls(n, pa.int32()), pa.array(upper), pa.array(lower), pa.array(np.ones(n, np.int32))], schema=ARROW)

    return vectors.mapInArrow(assign, STATE)


def assigned_again(state: DataFrame, old: np.ndarray, c: np.ndarray) -> DataFrame:
    own, others = drifts(old, c)
    gaps = half_gaps(c)

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v"), c.shape[1])
            before, scans = b.column("cluster").to_numpy(), b.column("scans").to_numpy().copy()
            near = before.copy()
            upper = np.nextafter(b.column("upper").to_numpy() + own[near], np.inf)
            lower = np.nextafter(b.column("lower").to_numpy() - others[near], -np.inf)
            safe = np.maximum(lower, gaps[near])
            open_ = np.flatnonzero(upper >= safe)
            upper[open_] = np.sqrt(squares(x[open_], c[near[open_]]).astype(np.float64)) * UP
            open_ = open_[upper[open_] >= safe[open_]]
            if len(open_):
                near[open_], upper[open_], lower[open_] = scanned(x[open_], c)
                scans[open_] += 1
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near), pa.array(before), pa.array(upper), pa.array(lower), pa.array(scans)], schema=ARROW)

    return state.mapInArrow(assign, STATE)


def moved(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What counts and component sums of each cluster change by: k x width sums of sums reach the driver."""

    def add(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x = matrix(b.column("v"), width)
            for sign, name in ((1, "cluster"), (-1, "before")):
                c = b.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for j in np.unique(c[c >= 0]):
                    counts[j] += sign * int((c == j).sum())
                    sums[j] += sign * x[c == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), width + 1)), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), k)), pa.array(np.column_stack([counts, sums]).reshape(-1))], names=["cluster", "place", "part"])

    parts = state.where("cluster <> before or before is null").select("v", "cluster", "before").mapInArrow(add, "cluster int, place int, part long")
    counts, sums = np.zeros(k, object), np.zeros((k, width), object)
    for j, p, s in parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
        if p < 0:
            counts[j] = int(s)
        else:
            sums[j, p] = int(s)
    return counts, sums


def clustered(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, steps: int = STEPS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The table of STATE after the last assignment, and the final centroids. Ends early when no vector changes its cluster, as no centroid can then."""
    vectors = kept(integer_vectors(df, id_column, vector, dimensions, steps), "vectors")
    c = first_centroids(vectors, clusters, seed)
    if not len(c):
        return vectors.selectExpr("vec_id", "v", "0 cluster", "0 before", "0D upper", "0D lower", "0 scans"), c
    state = kept(assigned_first(vectors, c), "clusters")
    discard(vectors)
    counts, sums = moved(state, *c.shape)
    for _ in range(rounds):
        new = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for n, row, old in zip(counts, sums, c, strict=True)], np.int64)
        if (new == c).all():
            break
        previous, state = state, kept(assigned_again(state, c, new), "clusters")
        discard(previous)
        c = new
        more, by = moved(state, *c.shape)
        counts, sums = counts + more, sums + by
    return state, c


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that is kept."""
    spark: SparkSession = embeddings.sparkSession
    state, c = clustered(embeddings)

    def measure(batches):
        for b in batches:
            near = b.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(squares(matrix(b.column("v"), c.shape[1]), c[near]) if len(near) else [], pa.int64())], names=["vec_id", "cluster", "distance"])

    out = state.select("vec_id", "cluster", "v").mapInArrow(measure, "vec_id long, cluster int, distance long")
    sums = dict(out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    per = spark.createDataFrame([(j, int(sums.get(j, 0)), int(sum(sums.values())), d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
