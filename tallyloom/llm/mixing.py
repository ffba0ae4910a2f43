"""Mixing sources to target weights by entropy balancing.

Words are tilted as little as possible so that constraints hold: of all rates r of documents with the wanted sums
sum(size r) for each source, and with the corpus's mean logarithm of a word's document's size, those that minimise
sum(size (r log r - r)). The minimum has the form r = exp(multiplier of the source + tilt x log size), cut off at the most
repeats that are allowed; multipliers and tilt minimise a convex dual. Newton iterations find them: Spark sums gradient and
curvature over the documents, source by source, and the step for the tilt comes from what is left of the curvature once
each source's own is taken out, so any number of sources works. Sources come first: where the moment can't be kept, their
sums still are. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import discard, fresh_name, kept

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one rounding group holds, about; values that constraints over several columns may have in all; and sources
#: up to which their rates are broadcast.
GROUP_ROWS, MOST_VALUES, BROADCAST_SOURCES = 2_000, 4_000, 100_000
#: Newton rounds for multipliers and tilt together and for multipliers alone, at most; how near sums must come, relatively; and
#: the longest step of each.
ROUNDS, LAST_ROUNDS, CLOSE, STEP = 12, 40, 1e-7, 1.0
#: Fixed by the query: weights of sources in code point order, and the most times that a source is repeated.
WEIGHTS, MOST_REPEATS = (5.0, 2.0, 1.0), 3.0


def told(cells: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """cells (source, size, items; a row for each source) with target and groups, however many sources there are.

    Weights repeat over the sources by code point, null last; what exceeds most times a size is shared anew by weight.
    Words for each unit of weight only grow from round to round, so they alone tell which sources are at their most.
    The driver sees sums for each weight, and a row for each partition.
    """
    spark, size = cells.sparkSession, F.col("size")
    lined = kept(cells.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "lined")  # partition << 33 | row
    lined = lined.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    starts, n = [], 0
    for r in sorted(lined.groupBy("_part").count().collect()):
        starts.append((r[0], n))
        n += r[1]
    place = (F.col("_start") + F.col("_row")) % len(weights)
    lined = lined.join(F.broadcast(spark.createDataFrame(starts, "_part long, _start long")), "_part")
    lined = lined.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    unit, past, before = 0.0, F.lit(False), -1
    while True:
        sums = lined.groupBy("weight").agg(F.count_if(past).alias("past"), F.count_if(~past).alias("free"), F.sum("size").alias("words"), F.coalesce(F.sum(F.when(past, size)), F.lit(0)).alias("held")).orderBy("weight").collect()
        now, free = sum(r.past for r in sums), sum(r.weight * r.free for r in sums)
        if now == before or not free:
            break
        unit, before = (sum(r.words for r in sums) - most * sum(r.held for r in sums)) / free, now
        past = F.col("weight") * F.lit(unit) > F.lit(float(most)) * size
    target = F.when(past, F.lit(float(most)) * size).otherwise(F.col("weight") * F.lit(unit))
    out = lined.withColumn("target", target).withColumn("groups", F.ceil(F.col("items") / GROUP_ROWS).cast("int"))
    return out.select(F.col("source").alias("s"), size.alias("source_size"), "target", "groups"), n


def whole(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms: in whole 2^-20."""
    return F.sum((x * F.lit(float(1 << 20))).cast("decimal(38,0)")).cast("double") / float(1 << 20)


def tilted(sizes: DataFrame, sources: DataFrame, n: int, most: float) -> tuple[DataFrame, float, float]:
    """sources with multiplier (null: all rates are most, or there are no words), the tilt, and the mean log size it is about.

    sizes: source, size (of a document), words (of all that size); documents of a source and size have the same rate, so their
    sum stands for them. The driver sees one row of sums a round.
    """
    near = lambda df: F.broadcast(df) if n <= BROADCAST_SOURCES else df
    sizes = sizes.where("size > 0").withColumn("log", F.log(F.col("size").cast("double")))
    told = sizes.agg(whole(F.col("words").cast("double")).alias("words"), whole(F.col("words") * F.col("log")).alias("moment")).first()
    total = told.words or 0.0
    mean = told.moment / total if total else 0.0
    free = (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    own = kept(sources.withColumn("multiplier", F.when(free, F.log(F.col("target") / F.col("source_size")))), "multipliers")
    if not total:
        return own, 0.0, mean
    tables, tilt, z = [own], 0.0, F.col("log") - F.lit(mean)
    for n_round in range(ROUNDS + LAST_ROUNDS):
        both = n_round < ROUNDS
        u = F.col("multiplier") + F.lit(tilt) * z
        rate = F.coalesce(F.least(F.exp(F.least(u, F.lit(50.0))), F.lit(most)), F.lit(most))
        slope = F.when(u < F.lit(float(np.log(most))), rate).otherwise(0.0)
        d = sizes.join(near(own.select("s", "multiplier")), sizes["source"].eqNullSafe(F.col("s")))
        w = F.col("words")
        sums = d.groupBy("source").agg(whole(w * rate).alias("g"), whole(w * rate * z).alias("m"), whole(w * slope).alias("a"), whole(w * slope * z).alias("b"), whole(w * slope * z * z).alias("c"))
        now = own.join(sums, own["s"].eqNullSafe(sums["source"]), "left").withColumn("gap", F.when(F.col("multiplier").isNotNull(), F.col("g") - F.col("target")))
        now = kept(now.select("s", "source_size", "target", "groups", "multiplier", "gap", "m", "a", "b", "c"), "sums")
        steep = F.col("a") > F.lit(1e-9)
        seen = now.agg(F.max(F.abs("gap") / F.greatest("target", F.lit(1.0))).alias("gap"), whole(F.col("m")).alias("m"), whole(F.when(steep, F.col("b") * F.col("gap") / F.col("a"))).alias("bg"), whole(F.when(steep, F.col("c") - F.col("b") * F.col("b") / F.col("a"))).alias("left")).first()
        settled = (seen.gap or 0.0) <= CLOSE
        step = 0.0
        if both and seen.left and seen.left > 1e-9 * total:
            step = float(np.clip(-(seen.m - (seen.bg or 0.0)) / seen.left, -STEP, STEP))
        if settled and (abs(seen.m) <= CLOSE * total or abs(step) < 1e-9 or not both):
            tables.append(now)
            break
        move = F.when(steep, -(F.col("gap") + F.col("b") * F.lit(step)) / F.col("a")).otherwise(F.signum(-F.col("gap")))
        tilt += step
        own = kept(now.select("s", "source_size", "target", "groups", (F.col("multiplier") + F.greatest(F.lit(-STEP), F.least(F.lit(STEP), move))).alias("multiplier")), "multipliers")
        tables += [now, own]
    discard(*[t for t in tables if t is not own])
    return own, tilt, mean


def balance(cells: DataFrame, columns: list[str], targets: dict[str, dict], most: float, *, rounds: int = 60, close: float = 1e-9) -> dict[str, dict]:
    """Multipliers by column and value. cells: documents' sizes summed by the constrained columns (size).

    Documents of a cell have the same rate, so its sum stands for them all. The driver sees one number for each value
    and for each pair of values, of which MOST_VALUES bounds the number.
    """
    place = {(c, v): i for i, (c, v) in enumerate((c, v) for c in columns for v in targets[c])}
    if len(place) > MOST_VALUES:
        raise ValueError(f"constraints have {len(place)} values; at most {MOST_VALUES} are balanced")
    want = np.array([targets[c][v] for c, v in place])
    lam, spark = np.zeros(len(place)), cells.sparkSession
    scale = max(want.max(initial=0), 1.0)

    def sums(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the rates give each value, and the curvature between values; where rates are cut off, that of a cell just below."""
        df, z = cells, F.lit(0.0)
        for k, c in enumerate(columns):
            own = spark.createDataFrame([(v, float(lam[i]), i) for (n, v), i in place.items() if n == c], f"v{k} string, l{k} double, i{k} int")
            df = df.join(F.broadcast(own), df[c].eqNullSafe(own[f"v{k}"]))
            z = z + F.col(f"l{k}")
        raw = F.exp(F.least(z, F.lit(50.0)))
        df = df.withColumn("mass", F.col("size") * F.least(raw, F.lit(most)))
        g, h = np.zeros(len(lam)), np.zeros((len(lam), len(lam)))
        pairs = F.explode(F.array(*[F.struct(F.col(f"i{a}").alias("a"), F.col(f"i{b}").alias("b")) for a in range(len(columns)) for b in range(len(columns))]))
        for r in df.select(pairs.alias("p"), "mass").groupBy("p.a", "p.b").agg(F.sum("mass").alias("m")).collect():
            h[r.a, r.b] += r.m
            if r.a == r.b:
                g[r.a] += r.m
        return g, h

    for _ in range(rounds):
        g, h = sums(lam)
        gap = g - want
        if np.abs(gap).max(initial=0) <= close * scale:
            break
        h[np.diag_indices_from(h)] += 1e-9 * max(h.max(initial=0), 1e-9)
        lam = np.clip(lam - np.clip(np.linalg.lstsq(h, gap, rcond=1e-12)[0], -2, 2), -40, math.log(most) + 40)
    return {c: {v: float(lam[i]) for (n, v), i in place.items() if n == c} for c in columns}


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """id, source, size (words), rows (equal ones), source_size, target, copies, for each distinct document.

    Equal rows (same id, source and size) are rounded together and get the same copies. No document gets more than
    most copies. Within a source, in groups by hash, the larger documents are rounded first, each so that the words
    taken so far come nearest to the words wanted so far: the smallest ones make up for what the large ones left. The same rows
    give the same copies, wherever they lie. A null source is one of its own; a null or empty text has size 0.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    items = kept(narrow.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "items")
    sizes = kept(items.groupBy("source", "size").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("items")), "sizes")
    cells = kept(sizes.groupBy("source").agg(F.sum("words").alias("size"), F.sum("items").alias("items")), "cells")
    by_source, n = told(cells, weights, most)
    by_source, tilt, mean = tilted(sizes, by_source, n, most)
    by_source = F.broadcast(by_source) if n <= BROADCAST_SOURCES else by_source
    rate = F.coalesce(F.least(F.exp(F.least(F.col("multiplier") + F.lit(tilt) * (F.log(F.col("size").cast("double")) - F.lit(mean)), F.lit(50.0))), F.lit(float(most))), F.lit(float(most)))
    own = items.join(by_source, items["source"].eqNullSafe(by_source["s"])).drop("s").withColumn("rate", F.when((F.col("size") > 0) & (F.col("target") > 0), rate).otherwise(0.0))
    order = F.xxhash64("id", "size")
    own = own.withColumn("group", F.pmod(order, F.col("groups"))).withColumn("order", order)

    def rounded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("order", "ascending"), ("id", "ascending")])
        rate = rows["rate"].to_numpy()
        low = np.floor(rate + 1e-9)
        part = np.clip(rate - low, 0, 1)
        words = (rows["size"].to_numpy() * rows["rows"].to_numpy()).astype(float)
        copies, due = low.astype(np.int64), 0.0
        for i, (w, f) in enumerate(zip(words.tolist(), part.tolist(), strict=True)):
            due += w * f
            if f > 1e-9 and w and due >= w / 2:
                copies[i] += 1
                due -= w
        return rows.append_column("copies", pa.array(copies)).select(["id", "source", "size", "rows", "source_size", "target", "copies"])

    return own.groupBy("source", "group").applyInArrow(rounded, "id long, source string, size long, rows long, source_size long, target double, copies long")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    each = mixed(docs, **options).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, other columns as they were."""
    n = mixed(docs, doc_id=doc_id, text=text, source=source, **options)
    n = n.where("copies > 0").select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    size, copy = fresh_name(docs, "_size_of"), fresh_name(docs, "_copy")
    d = docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")).alias("d")
    out = d.join(n.alias("n"), F.col(f"d.{doc_id}").cast("long").eqNullSafe(F.col("n._id")) & F.col(f"d.{source}").cast("string").eqNullSafe(F.col("n._source")) & (F.col(f"d.{size}") == F.col("n._size")))
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n._copies"))).alias(copy)).drop(copy)
