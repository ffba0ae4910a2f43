"""Tables between the rounds of a job: Parquet in the folder that all machines see, deleted when no longer read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, purpose: str = "round") -> DataFrame:
    """df written and read back: lineage is cut, and what a lost executor had is read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tallyloom/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, in whatever store that is."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df, written once, with the place of each row from 0 in that order (which must leave no ties): a range sort of the rows themselves and the counts of its parts, nothing is joined back."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _offset(stored(rows.withColumn("_m_", F.monotonically_increasing_id()), "placed"), name)


def numbered(ids: DataFrame, column: str = "id") -> DataFrame:
    """The distinct values of a column with n, their places from 0 in ascending order."""
    return placed(ids.select(column).distinct(), "n", F.col(column))


def _offset(runs: DataFrame, name: str) -> DataFrame:
    part = F.shiftright("_m_", 33)
    before, offsets = 0, []
    for p, first, rows in sorted(runs.groupBy(part).agg(F.min("_m_"), F.count("*")).collect()):  # a row for each part of the sort
        offsets.append((p, before - first))
        before += rows
    known = runs.sparkSession.createDataFrame(offsets, "_part_ long, _offset_ long")
    columns = [c for c in runs.columns if c != "_m_"]
    return runs.join(F.broadcast(known), part == F.col("_part_")).select(*columns, (F.col("_m_") + F.col("_offset_")).alias(name))
