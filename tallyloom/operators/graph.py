"""Reachability over edges: components, dependents, chains. Lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.stored import stored


def shared(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="tallyloom-"))
    return df.checkpoint()


def connected(links: DataFrame) -> DataFrame:
    """id and part (the smallest id reached) of each id in links (a, b), by alternating large and small stars."""
    e = shared(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = size(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        e = shared(large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.withColumnRenamed("m", "v")).distinct())
        after = size(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("part"))).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All (start, reached, distance) with the least distance over edges (a, b), of any depth; ends when nothing new is reached.

    Steps double: after each round all pairs within n steps are known. A shortest path of n + 1 to 2 n steps is one of
    exactly n followed by a known one, so paths of n are joined with the known pairs.
    """
    found = shared(edges.select(F.col("a").alias("start"), F.col("b").alias("reached"), F.lit(1).alias("distance")).distinct())
    n = 1
    while True:
        half = found.where(F.col("distance") == n).select("start", F.col("reached").alias("_mid"))
        rest = found.select(F.col("start").alias("_mid"), "reached", "distance")
        step = half.join(rest, "_mid").groupBy("start", "reached").agg((F.min("distance") + n).cast("int").alias("distance"))
        new = shared(step.join(found, ["start", "reached"], "left_anti"))
        if not new.head(1):
            return found
        found = shared(found.unionByName(new))
        n *= 2


#: A rectangle is listed in the blocks that it meets at the finest level where they are no more than this.
MOST_BLOCKS, LEVELS = 64, 10
#: Up to so many rectangles of a level are sent to the points; a block that holds most points is then no task of its own.
MOST_SENT = 1000


def contained(points: DataFrame, rectangles: DataFrame, rows: int = 64, columns: int = 16) -> DataFrame:
    """Points (sheet, row, col, ...) joined to rectangles (sheet, min_row, max_row, min_col, max_col, ...) that hold them.

    An equality join on blocks of rows x columns, then the exact test. Blocks of each level are eight times as high and as
    wide as those of the one below, so a whole column or sheet takes few blocks too; points are listed at the levels in use.
    Levels of few rectangles leave the points where they are.
    """
    at = lambda c, n, k: F.floor(F.col(c) / (n * 8**k)).cast("long")
    met = lambda k: (at("max_row", rows, k) - at("min_row", rows, k) + 1) * (at("max_col", columns, k) - at("min_col", columns, k) + 1)
    level = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        level = F.when(met(k) <= MOST_BLOCKS, k).otherwise(level)
    r = rectangles.withColumn("_l", level)
    used = {x["_l"]: x["count"] for x in r.groupBy("_l").count().collect() if x["_l"] is not None}  # LEVELS + 1 at most
    span = lambda lo, hi, n: F.explode(F.sequence(*(F.floor(F.col(c) / (n * F.pow(F.lit(8.0), "_l"))).cast("long") for c in (lo, hi))))
    r = r.withColumn("_br", span("min_row", "max_row", rows)).withColumn("_bc", span("min_col", "max_col", columns))

    def joined(levels: list[int], sent: bool) -> DataFrame:
        p = points.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(k).alias("_l"), at("row", rows, k).alias("_br"), at("col", columns, k).alias("_bc")) for k in levels]) if levels else F.array().cast("array<struct<_l:int,_br:bigint,_bc:bigint>>")))
        p, q = p.select(*points.columns, "_b._l", "_b._br", "_b._bc"), r.where(F.col("_l").isin(levels))
        return p.join(F.broadcast(q) if sent else q, ["sheet", "_l", "_br", "_bc"]).where("row between min_row and max_row and col between min_col and max_col").drop("_l", "_br", "_bc")

    few = sorted(k for k, n in used.items() if n <= MOST_SENT)
    many = sorted(k for k, n in used.items() if n > MOST_SENT)
    out = joined(many, False) if many or not few else None
    return out if not few else joined(few, True) if out is None else out.unionByName(joined(few, True))


# Impacts that a finding shows.
MOST_IMPACTS = 25
#: After so many rounds what they found is written as one table.
MOST_PARTS = 16


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """start and reached of the ids (id) that changed, over edges (a, b) from what is read to what reads it: breadth first, from the changed ids alone.

    A round joins only what the one before reached anew, and writes only that; there are as many rounds as the longest
    shortest path has edges; for long chains closure() takes the logarithm of that. A start that lies on a cycle reaches itself.
    """
    e = stored(edges.select("a", "b").distinct(), "edges")
    front = stored(changed.select(F.col("id").alias("start")).distinct().join(e, F.col("start") == F.col("a")).select("start", F.col("b").alias("reached")).distinct(), "reached")
    found = [front]
    while front.head(1):
        step = front.join(e, F.col("reached") == F.col("a")).select("start", F.col("b").alias("reached")).distinct()
        front = stored(step.join(reduce(DataFrame.unionByName, found), ["start", "reached"], "left_anti"), "reached")
        found.append(front)
        if len(found) == MOST_PARTS:
            found = [stored(reduce(DataFrame.unionByName, found), "reached")]
    return reduce(DataFrame.unionByName, found)


def impacts(reached: DataFrame, most: int = MOST_IMPACTS) -> DataFrame:
    """start, impacts (the smallest reached ids, so many at most), more (how many others): what a finding shows of its dependents."""
    w = Window.partitionBy("start")
    d = reached.withColumn("_n", F.row_number().over(w.orderBy("reached"))).withColumn("_all", F.count("*").over(w)).where(F.col("_n") <= most)
    d = d.groupBy("start").agg(F.sort_array(F.collect_list("reached")).alias("impacts"), F.max("_all").alias("_all"))
    return d.select("start", "impacts", F.greatest(F.col("_all") - most, F.lit(0)).alias("more"))
