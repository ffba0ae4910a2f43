"""Where jobs keep intermediate tables and files, and how rows are cut into ordered shards."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts or sets that a Python worker gets at once.
BATCH_ROWS = 500

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see. Only a local session may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return re.sub(r"^file:/+", "file:///", root.rstrip("/"))


def fresh_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_root(spark)}/tallyloom/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what kept() wrote, once nothing reads it any more."""
    for df in tables:
        store, path = located(df.kept_at)
        store.delete_dir(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """For jobs that run within: Arrow batches of so many rows at most, so that long rows don't add up to much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


def commit_files(written: DataFrame, folder: str) -> str:
    """Runs the job that writes files under temporary names, gives those of successful tasks their final names, and writes the manifest; returns the folder.

    written: a row for each file, with temp and name (paths within the folder). Executors move the files; moving one that was
    moved before does nothing, so a lost executor's moves can be made again. The manifest is a table of the other columns; a
    folder without _MANIFEST/_SUCCESS isn't complete.
    """
    spark, (store, root) = written.sparkSession, located(folder)
    store.create_dir(root, recursive=True)
    written.write.parquet(f"{folder}/_temporary/files")
    files = spark.read.schema(written.schema).parquet(f"{folder}/_temporary/files")

    def move(batches):
        store, root = located(folder)
        for b in batches:
            for temp, name in zip(b.column("temp").to_pylist(), b.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type == fs.FileType.File:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
            yield b

    files.mapInArrow(move, files.schema).drop("temp").write.parquet(f"{folder}/_MANIFEST")
    store.delete_dir(f"{root}/_temporary")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a complete folder."""
    store, root = located(folder)
    if store.get_file_info(f"{root}/_MANIFEST/_SUCCESS").type != fs.FileType.File:
        raise ValueError(f"{folder} isn't complete")
    return spark.read.parquet(f"{folder}/_MANIFEST")


#: Shards of a table at most: what the driver knows of its keys is bound by this, not by the table.
MOST_SHARDS = 20_000
#: Cells that heavy ones are cut into in a round, together, about (or 16 each).
CELLS = 200_000


class Shards:
    """How the rows of a table go to shards along a long key: first keys of the ranges, and over how many shards each range is dealt.

    A range of one key that is too heavy for a shard is dealt by a hash; so are rows without a key, which come first.
    """

    def __init__(self, bounds: list[int], widths: list[int], without: int):
        self.bounds, self.widths = np.array(bounds, np.int64), np.array(widths, np.int32)
        self.without = without  # shards of their own for rows without a key; 0: they are in the first
        self.starts = (without + np.cumsum(self.widths) - self.widths).astype(np.int32)
        self.count = int(without + self.widths.sum())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shards) and (self.bounds.tolist(), self.widths.tolist(), self.without) == (other.bounds.tolist(), other.widths.tolist(), other.without)

    def of_values(self, keys: np.ndarray, none: np.ndarray, ties: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.bounds, keys, side="right")
        own = self.starts[i] + ties % self.widths[i]
        return np.where(none, ties % max(self.without, 1), own).astype(np.int32)

    def of(self, key: Column, tie: Column) -> Column:
        """The shard of each row; tie tells rows of a heavy key apart."""
        if len(self.bounds) < 64 and not self.without and (self.widths == 1).all():
            return F.coalesce(sum((F.when(key >= b, 1).otherwise(0) for b in self.bounds.tolist()), F.lit(0)), F.lit(0)).cast("int")

        @F.arrow_udf("int")
        def place(keys: pa.Array, ties: pa.Array) -> pa.Array:
            none = keys.is_null().to_numpy(zero_copy_only=False)
            return pa.array(self.of_values(keys.fill_null(0).to_numpy(zero_copy_only=False), none, ties.to_numpy(zero_copy_only=False)))

        return place(key.cast("long"), tie)


def hashed(text: Column) -> Column:
    """A number of 63 bits that tells texts apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def shards_of(df: DataFrame, key: str, weight: Column, target: int, *, split: bool = True) -> Shards:
    """Shards of about target weight each, or more where there would be over MOST_SHARDS, cut along a long key.

    Depends on the rows alone, not on how they are partitioned. The driver sees one row for each cell of the key's range that
    has rows, CELLS or 16 for each shard at most. split: whether a key heavier than target may be dealt over several shards.
    """
    spark = df.sparkSession
    cur = df.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w"))
    lo, hi, total, without = cur.agg(F.min("k"), F.max("k"), F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("w"))), F.lit(0))).first()
    target = max(target, -(-total // MOST_SHARDS))
    none = -(-without // target) if split and without > target else 0
    if lo is None:
        return Shards([], [1], none)
    coarse = 2 if hi - lo >= 1 << 62 else 0  # differences of keys must fit a long
    lo, hi, cur = lo >> coarse, hi >> coarse, cur.where("k is not null").withColumn("k", F.shiftright("k", coarse))
    width = max(1, -(-(hi - lo + 1) // (4 * max(1, -(-(total - without) // target)) + 16)))
    cur, light = cur.withColumn("s", F.expr(f"{lo}L + ((k - {lo}L) div {width}) * {width}")), []
    while True:
        cells = [(r[0], r[1] or 0) for r in cur.groupBy("s").agg(F.sum("w")).collect()]
        heavy = {s for s, w in cells if w > target and width > 1}
        light += [c for c in cells if c[0] not in heavy]
        if not heavy:
            break
        sub = -(-width // max(16, min(1 << 16, CELLS // len(heavy))))
        cur = cur.join(F.broadcast(spark.createDataFrame([(s,) for s in sorted(heavy)], "s long")), "s").select("k", "w", F.expr(f"s + ((k - s) div {sub}) * {sub}").alias("s"))
        width = sub
    bounds, widths, have = [], [1], 0
    for start, w in sorted(light):
        own = -(-w // target) if split and w > target and not coarse else 1
        if have and (have + w > target or own > 1):
            bounds.append(start << coarse)
            widths.append(1)
            have = 0
        if own > 1:  # this key alone, then the next range
            widths[-1] = own
            bounds.append(start + 1)
            widths.append(1)
        else:
            have += w
    return Shards(bounds, widths, none)
