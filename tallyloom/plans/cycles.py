"""Two cycles of the same deliverable from the driver's tables: what was booked and what was billed.

The baseline is orders as booked; the current cycle is the same orders as billed by their line items. Money is summed in
whole cents, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import periods


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, customer, month, value of each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "MMM-yyyy").alias("month"), F.col("o_totalprice").alias("value"))


def billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and value of each order that has line items."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100 + 0.5).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg((F.sum(cents) / 100).alias("value"))


BILLED = "SELECT l_orderkey AS key, sum(CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT)) / 100.0 AS value FROM lineitem GROUP BY 1"


def months(df: DataFrame, date: str, of: DataFrame | None = None) -> DataFrame:
    """df with month (a label) and period (parsed from it). Labels are parsed once a month that of (df, if none is given) has, and sent to the rows: at most twelve a year."""
    m = F.trunc(date, "month")
    each = (df if of is None else of).select(m.alias("_m")).distinct()
    each = periods.with_period(each.withColumn("month", F.date_format("_m", "MMM-yyyy")), "month", "period")
    return df.join(F.broadcast(each), m.eqNullSafe(each["_m"]), "left").drop("_m")


def booked_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, month, period: a wide table's column headers, once each."""
    d = booked_dates(spark, sf_dir)
    return months(d.distinct(), "m", d).drop("m")


def booked_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and first of the month of each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.trunc("o_orderdate", "month").alias("m"))


def billed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and first of the month of each line item."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.trunc("l_shipdate", "month").alias("m"))
    return li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer")), "key").select("customer", "m")


def all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of the month of all orders and line items, of any customer."""
    return booked_dates(spark, sf_dir).select("m").unionByName(table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("m")))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, place (1, 2, ... by order key) and period (the order's month): one axis for each customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", "o_orderdate")
    d = months(o, "o_orderdate").withColumn("place", F.row_number().over(Window.partitionBy("customer").orderBy("o_orderkey")).cast("long"))
    return d.select("customer", "place", "period")


AXIS = "SELECT o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populated cells: sheet (one), row (customer), col (months since year 0), once each."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("Orders").alias("sheet"), F.col("o_custkey").alias("row"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("col")).distinct()


GRID = "SELECT DISTINCT 'Orders' AS sheet, o_custkey AS row, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS col FROM orders"
