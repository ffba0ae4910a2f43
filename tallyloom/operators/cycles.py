"""Circular references: the strongly connected sets of a graph of any size and depth, in memory that grows with its edges.

Vertices are numbered in order and cut into blocks of neighbours; cells that refer to each other are mostly near each other. A
task gets the edges within its block and which of its vertices have edges to others. It takes out every other vertex that needs
no more edges around it than it had: its predecessors then lead to its successors, so who reaches whom among the rest stays as
it was. What is left makes the next, smaller graph, down to one that a task holds; a graph that doesn't shrink is solved by
colours instead. On the way back each block, told which of its vertices share a set, finds the sets of those it had taken out.
A chain or a ring of n vertices takes about log(n) / log(BLOCK) rounds.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.stored import discarded, numbered, stored

#: Vertices of a block (so edges within it are its square at most), and edges of a graph that one task solves.
BLOCK, ALONE = 1 << 11, 1 << 16
#: A round that leaves more of the edges than this is the last one.
SHRINKS = 0.8


def neighbours(t: pa.Table) -> tuple[dict[int, set[int]], dict[int, set[int]], set[int]]:
    """Successors and predecessors within a block, and the vertices with edges to others: those of rows without an end."""
    after, before, kept = defaultdict(set), defaultdict(set), set()
    for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist(), strict=True):
        if v is None:
            kept.add(u)
        else:
            after[u].add(v)
            before[v].add(u)
    return after, before, kept


def reduced(t: pa.Table) -> pa.Table:
    """The edges among the vertices that stay."""
    after, before, kept = neighbours(t)
    waiting = sorted({*after, *before} - kept, reverse=True)
    queued = set(waiting)
    while waiting:
        x = waiting.pop()
        queued.discard(x)
        ins, outs = before[x], after[x]
        if len(ins) * len(outs) > len(ins) + len(outs):
            continue
        for p in ins:
            after[p].discard(x)
            after[p] |= outs - {p}
        for s in outs:
            before[s].discard(x)
            before[s] |= ins - {s}
        del before[x], after[x]
        again = sorted(y for y in (ins | outs) - kept if y not in queued)
        waiting += again
        queued.update(again)
    edges = [(u, v) for u, vs in after.items() for v in vs]
    return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})


def strong_sets(after: dict[int, set[int]]) -> Iterator[list[int]]:
    """The strongly connected sets of two vertices or more, by one depth-first walk with a stack of its own."""
    order, low, on, stack = {}, {}, set(), []
    for start in list(after):
        if start in order:
            continue
        walk = [(start, iter(after[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while walk:
            x, rest = walk[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = len(order)
                    stack.append(y)
                    on.add(y)
                    walk.append((y, iter(after.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], order[y])
            else:
                walk.pop()
                if walk:
                    up = walk[-1][0]
                    low[up] = min(low[up], low[x])
                if low[x] == order[x]:
                    found = []
                    while True:
                        y = stack.pop()
                        on.discard(y)
                        found.append(y)
                        if y == x:
                            break
                    if len(found) > 1:
                        yield found


def labelled(t: pa.Table, known: pa.Table | None) -> pa.Table:
    """v and label of the vertices on cycles; known: those of the vertices that stayed, which hold beyond the block too."""
    after = neighbours(t)[0]
    label = dict(zip(known["v"].to_pylist(), known["label"].to_pylist(), strict=True)) if known is not None else {}
    rings = defaultdict(list)
    for v, x in label.items():
        rings[x].append(v)
    for members in rings.values():
        for u, v in zip(members, members[1:] + members[:1], strict=True):
            if u != v:
                after[u].add(v)
    for found in strong_sets(after):
        name = next((label[v] for v in found if v in label), min(found))
        label.update(dict.fromkeys(found, name))
    return pa.table({"v": pa.array(list(label), pa.int64()), "label": pa.array(list(label.values()), pa.int64())})


def by_colours(g: DataFrame) -> DataFrame:
    """v and label of the vertices on cycles of a graph of any size: the largest number that leads to a vertex is its colour, and what leads back to that number within its colour is its set."""
    out = g.select(F.col("u").alias("v"), F.col("v").alias("label")).limit(0)
    while g.head(1):
        c = stored(g.select(F.col("u").alias("v")).union(g.select("v")).distinct().withColumn("c", F.col("v")))
        while True:
            better = g.join(c, g["u"] == c["v"]).groupBy(g["v"].alias("v")).agg(F.max("c").alias("m"))
            new = stored(c.join(better, "v", "left").select("v", F.greatest("c", "m").alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("_new")))
            going = bool(new.where("_new").head(1))
            discarded(c)
            c = new
            if not going:
                break
        cu, cv = c.select(F.col("v").alias("u"), "c"), c.select("v", F.col("c").alias("d"))
        same = stored(g.join(cu, "u").join(cv, "v").where("c = d").select("u", "v", "c"))
        have = front = stored(same.select(F.col("c").alias("v"), F.col("c").alias("label")).distinct())
        while front.head(1):
            step = same.join(front, ["v"]).select(F.col("u").alias("v"), "label").distinct()
            front = stored(step.join(have, "v", "left_anti"))
            have = stored(have.unionByName(front))
        many = have.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        out = out.unionByName(have.join(many, "label", "left_semi"))
        left = same.join(have.select(F.col("v").alias("u")), "u", "left_anti").join(have.select("v"), "v", "left_anti").select("u", "v")
        left = left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        g = stored(left.select("u", "v"))
    return out


def strong(g: DataFrame, block: int = BLOCK, alone: int = ALONE) -> DataFrame:
    """v and label of the vertices on cycles of stored edges (u, v) between numbers, none to itself and each once; equal labels are one set."""
    levels, n = [], g.count()
    size = block.bit_length() - 1
    while n > alone:
        if levels:
            place = numbered(g.select("u").union(g.select(F.col("v").alias("u"))), "u").select("u", F.shiftright("n", size).alias("block"))
        else:
            place = g.select("u").union(g.select(F.col("v").alias("u"))).distinct().select("u", F.shiftright("u", size).alias("block"))
        place = stored(place, "blocks")
        e = g.join(place.withColumnRenamed("block", "bu"), "u").join(place.select(F.col("u").alias("v"), F.col("block").alias("bv")), "v") if levels else g.select("u", "v", F.shiftright("u", size).alias("bu"), F.shiftright("v", size).alias("bv"))
        crossing = e.where("bu <> bv")
        none = F.lit(None).cast("long").alias("v")
        marks = crossing.select(F.col("bu").alias("block"), "u", none).union(crossing.select(F.col("bv").alias("block"), F.col("v").alias("u"), none)).distinct()
        rows = stored(e.where("bu = bv").select(F.col("bu").alias("block"), "u", "v").unionByName(marks), "block-edges")
        left = rows.groupBy("block").applyInArrow(reduced, "u long, v long")
        g = stored(left.unionByName(crossing.select("u", "v")), "edges")
        levels.append((rows, place))
        before, n = n, g.count()
        if n > SHRINKS * before:
            break
    labels = stored(g.select((F.col("u") * 0).alias("block"), "u", "v").groupBy("block").applyInArrow(lambda t: labelled(t, None), "v long, label long") if n <= alone else by_colours(g), "labels")
    for rows, place in reversed(levels):
        known = labels.join(place.withColumnRenamed("u", "v"), "v").select("block", "v", "label")
        new = stored(rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(labelled, "v long, label long"), "labels")
        discarded(labels, rows, place)
        labels = new
    return labels


def cycles(edges: DataFrame, block: int = BLOCK, alone: int = ALONE) -> DataFrame:
    """id and cycle (its smallest id) of each id that reaches itself over edges (a, b): sets of ids that reach each other, and single ones by their own edge.

    Edges with a null end count for nothing; edges may repeat; ids are of any type that can be ordered.
    """
    e = stored(edges.select("a", "b").where("a is not null and b is not null").distinct(), "references")
    ids = numbered(e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))))
    at = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
    labels = strong(stored(e.where("a <> b").join(at("a", "u"), "a").join(at("b", "v"), "b").select("u", "v"), "edges"), block, alone)
    first = labels.groupBy("label").agg(F.min("v").alias("first"))
    found = labels.join(first, "label").join(at("id", "v"), "v").join(at("cycle", "first"), "first").select("id", "cycle")
    own = e.where("a = b").select(F.col("a").alias("id"))
    return found.unionByName(own.join(found, "id", "left_anti").select("id", F.col("id").alias("cycle")))


# Cells that a finding names, hex digits of its key.
SAMPLE, DIGITS = 8, 12


def findings(cells: DataFrame, cycle: str, order: list[str], shown: Column) -> DataFrame:
    """A row for each cycle: cells, location (the first cell), element (the first cells, and how many more), event_key (a digest of all of them in order).

    A cycle's cells are sorted and pass by one at a time; none is held.
    """
    d = cells.select(F.col(cycle).alias("_cycle"), shown.alias("_shown"), *order).repartition("_cycle").sortWithinPartitions("_cycle", *order).select("_cycle", "_shown")
    kind = dict(d.dtypes)["_cycle"]

    def sum_up(batches):
        name, h, n, sample = None, None, 0, []

        def row() -> pa.RecordBatch:
            h.update(b"]")
            more = f"; +{n - len(sample)} more cells" if n > len(sample) else ""
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([sample[0]]), pa.array(["; ".join(sample) + more]), pa.array(["excel-cycle:" + h.hexdigest()[:DIGITS]])], names=["cycle", "cells", "location", "element", "event_key"])

        for b in batches:
            for c, s in zip(b.column("_cycle").to_pylist(), b.column("_shown").to_pylist(), strict=True):
                if h is None or c != name:
                    if h is not None:
                        yield row()
                    name, h, n, sample = c, hashlib.sha256(b"["), 0, []
                else:
                    h.update(b",")
                h.update(json.dumps(s).encode())
                n += 1
                if n <= SAMPLE:
                    sample.append(s)
        if h is not None:
            yield row()

    return d.mapInArrow(sum_up, f"cycle {kind}, cells long, location string, element string, event_key string")
