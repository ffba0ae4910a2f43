"""Where findings go: parquet by run, JSON reports, structural fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_run(findings: DataFrame, folder: str, run_id: str, rows_per_file: int = 1_000_000) -> None:
    """Writes a run's findings under its id; a rerun replaces that run alone."""
    d = findings.withColumn("run_id", F.lit(run_id))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("run_id").parquet(folder)


def json_report(findings: DataFrame, folder: str) -> None:
    """Findings as JSON lines, in the order of their ids."""
    findings.orderBy("finding_id").write.mode("overwrite").json(folder)


def structure_fingerprint(cells: DataFrame) -> DataFrame:
    """Counts of cells by sheet and kind, and how many distinct formulas they have: a workbook's structure without its content."""
    kind = F.when(F.col("formula").isNotNull(), "formula").otherwise(F.coalesce("vtype", F.lit("blank")))
    return cells.groupBy("sheet", kind.alias("kind")).agg(F.count("*").alias("cells"), F.countDistinct("formula").alias("formulas"), F.max("row").alias("rows"), F.max("col").alias("columns"))
