"""Alignment of two cycles: which rows, columns, sheets or objects of one are those of the other.

All operators take a baseline and a current DataFrame and give pairs with an event. Keys may be null; nulls are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import periods
from tallyloom.operators.graph import shared
from tallyloom.operators.stored import discarded, stored

# The share of baseline keys that must match, and the axis size from which a fallback is called unsure.
LEAST_MATCHED, SURE_SIZE = 0.5, 4


def null_safe(columns: list[str], a: str = "a", b: str = "b") -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def with_occurrence(df: DataFrame, key: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Numbers rows with equal keys in order, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def keyed(base: DataFrame, current: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Full outer join on (key, occurrence): a struct column base and one current, and event paired, deleted or inserted."""
    b = with_occurrence(base, key, order)
    c = with_occurrence(current, key, order)
    j = b.alias("a").join(c.alias("b"), null_safe([*key, "occurrence"]), "full_outer")
    side = lambda s: F.when(F.col(f"{s}.occurrence").isNotNull(), F.struct(F.col(f"{s}.*")))
    out = j.select(side("a").alias("base"), side("b").alias("current"))
    return out.withColumn("event", F.when(F.col("base").isNull(), "inserted").when(F.col("current").isNull(), "deleted").otherwise("paired"))


def with_growth(aligned: DataFrame, base: DataFrame, period: Column, axis: list[str] | None = None, of: str = "period") -> DataFrame:
    """Turns inserted into growth where the row's period follows the latest of the baseline (of its kind, and axis)."""
    axis = axis or []
    latest = base.select(*axis, period.alias("_p")).where("_p is not null").groupBy(*axis, "_p.kind").agg(F.max(F.struct("_p.k1", "_p.k2", "_p.k3")).alias("_latest"))
    p = F.col(f"current.{of}")
    j = aligned.withColumn("_kind", p["kind"]).alias("x").join(F.broadcast(latest.alias("l")) if not axis else latest.alias("l"), (F.col("x._kind") == F.col("l.kind")) & (F.lit(True) if not axis else null_safe_to_current(axis)), "left")
    latest_period = F.struct(F.col("l.kind"), F.col("l._latest.k1"), F.col("l._latest.k2"), F.col("l._latest.k3"))
    grows = (F.col("event") == "inserted") & F.coalesce(periods.is_after(p, latest_period), F.lit(False))
    return j.select("x.base", "x.current", F.when(grows, "growth").otherwise(F.col("event")).alias("event"))


def presence(base: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """key and event (paired, deleted, inserted) of the distinct keys of both: what keyed() gives where no key repeats, in one shuffle of keys and without a sort."""
    d = base.select(*key, F.lit(True).alias("_b"), F.lit(False).alias("_c")).unionByName(current.select(*key, F.lit(False).alias("_b"), F.lit(True).alias("_c")))
    d = d.groupBy(*key).agg(F.max("_b").alias("_b"), F.max("_c").alias("_c"))
    return d.select(*key, F.when(~F.col("_b"), "inserted").when(~F.col("_c"), "deleted").otherwise("paired").alias("event"))


def grown(events: DataFrame, axis: list[str], period: str = "period") -> DataFrame:
    """events with inserted turned into growth where the period follows the latest of the baseline (of its kind, and axis): with_growth() for presence()."""
    p = F.col(period)
    latest = F.max(F.when(F.col("event") != "inserted", periods.sort_key(p))).over(Window.partitionBy(*axis, p["kind"]))
    d = events.withColumn("_latest", latest)
    last = F.when(F.col("_latest").isNotNull(), F.struct(p["kind"].alias("kind"), *[F.col(f"_latest.{k}").alias(k) for k in ("k1", "k2", "k3")]))
    grows = (F.col("event") == "inserted") & F.coalesce(periods.is_after(p, last), F.lit(False))
    return d.withColumn("event", F.when(grows, "growth").otherwise(F.col("event"))).drop("_latest")


def null_safe_to_current(axis: list[str]) -> Column:
    out = F.lit(True)
    for c in axis:
        out = out & F.col(f"x.current.{c}").eqNullSafe(F.col(f"l.{c}"))
    return out


def positional(base: DataFrame, current: DataFrame, axis: list[str], order: list[str]) -> DataFrame:
    """Rows of each axis joined by place: beyond the shorter side they are deleted or inserted."""
    return keyed(base, current, axis, order)


def trust(aligned: DataFrame, axis: list[Column]) -> DataFrame:
    """Of each axis: pairs, deleted, inserted, growth, whether enough keys match, else whether a positional fallback is unsure."""
    n = lambda e: F.count_if(F.col("event") == e)
    t = aligned.groupBy(*axis).agg(n("paired").alias("paired"), n("deleted").alias("deleted"), n("inserted").alias("inserted"), n("growth").alias("growth"))
    base, current = F.col("paired") + F.col("deleted"), F.col("paired") + F.col("inserted") + F.col("growth")
    by_keys = (base == 0) | (F.col("paired") >= LEAST_MATCHED * base)
    return t.withColumn("method", F.when(by_keys, "keys").otherwise("positional")).withColumn("low_confidence", ~by_keys & (base >= SURE_SIZE) & (current >= SURE_SIZE))


def identity(base: DataFrame, current: DataFrame, key: list[str], order: list[str], duplicates: str = "skip") -> DataFrame:
    """Joins by an identity rule. Rows with a blank key part take no part; keys unique on both sides pair 1:1.

    Others are ambiguous: skip leaves them out (event skipped), occurrence pairs them in order.
    """
    if duplicates not in ("skip", "occurrence"):
        raise ValueError(duplicates)
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    b, c = base.where(whole), current.where(whole)
    out = keyed(b, c, key, order)
    if duplicates == "skip":
        many = b.groupBy(*key).count().where("count > 1").select(*key).unionByName(c.groupBy(*key).count().where("count > 1").select(*key)).distinct()
        own = [F.coalesce(F.col(f"base.{k}"), F.col(f"current.{k}")).alias(k) for k in key]
        out = out.select("base", "current", "event", F.struct(*own).alias("_k"))
        cond = F.lit(True)
        for k in key:
            cond = cond & (F.col(f"o._k.{k}") == F.col(f"m.{k}"))
        out = out.alias("o").join(many.alias("m"), cond, "left").select("o.base", "o.current", F.when(F.col(f"m.{key[0]}").isNotNull(), "skipped").otherwise(F.col("o.event")).alias("event"))
    return out


def unique_cascade(base: DataFrame, current: DataFrame, passes: list[tuple], id_: str) -> DataFrame:
    """Pairs objects by passes of ever weaker keys: a pass pairs keys that occur once on each side among what is left.

    A pass is its name and key, and for one that pairs equal keys in order instead, the column that orders them. Gives
    base_id, current_id and the pass's name. Null keys pair with nothing.
    """
    found = None
    for name, key, *order in passes:
        if order:
            one = lambda df, key=key, o=order: df.dropna(subset=key).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*o, id_))).select(*key, "_n", F.col(id_).alias("_id"))
        else:
            one = lambda df, key=key: df.dropna(subset=key).groupBy(*key).agg(F.min(id_).alias("_id"), F.count("*").alias("_n")).where("_n = 1")
        hits = one(base).withColumnRenamed("_id", "base_id").join(one(current).withColumnRenamed("_id", "current_id"), [*key, "_n"]).select("base_id", "current_id", F.lit(name).alias("pass"))
        hits = shared(hits)  # each pass reads what the ones before left twice
        base = base.join(hits.select(F.col("base_id").alias(id_)), id_, "left_anti")
        current = current.join(hits.select(F.col("current_id").alias(id_)), id_, "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return found


#: After so many rounds the pairs that are left are written anew.
AGAIN = 4


def mutual_best(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Of scored candidate pairs those that are each other's best, without a tie on either side.

    They leave with all their pairs, and what is left is matched again until a round finds none.
    A side's best are grouped before they are shuffled, and pairs leave by joins with what was found; the pairs themselves stay.
    """
    same = F.count("*").over(Window.partitionBy(a, b, score))  # equal rows are a tie
    left, columns = stored(scored.withColumn("_same", same), "pairs"), scored.columns
    found, rounds = left.select(*columns).limit(0), 0

    def single(d: DataFrame, x: str, y: str) -> DataFrame:
        best = d.where(F.col(score).isNotNull()).groupBy(x).agg(F.max(F.struct(F.col(score).alias("s"), F.col(y).alias("y"), "_same")).alias("_high"), F.min(F.struct((-F.col(score)).alias("s"), F.col(y).alias("y"))).alias("_low"))
        return best.where("_high._same = 1 and _high.y <=> _low.y").select(x, F.col("_high.y").alias(y))

    while True:
        pairs = single(left, a, b).join(single(left, b, a), [a, b])
        out = stored(left.join(pairs, [a, b], "left_semi").select(*columns), "best")
        if not out.head(1):
            return found
        found, rounds = found.unionByName(out) if rounds else out, rounds + 1
        left = left.join(out.select(a), a, "left_anti").join(out.select(b), b, "left_anti")
        if rounds % AGAIN == 0:
            left = stored(left, "pairs")


def greedy(scored: DataFrame, group: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs of each group (a deck, a sheet), best score first, ties by ids; scores under the least, and pairs without a group or an id, don't pair.

    A pair that is the best of both its ids is what taking pairs one by one would come to before any other of theirs. All such
    pairs are taken at once, their ids leave, and the rest goes on, so a group can be of any size. Equal rows count once.
    """
    left = stored(scored.where(F.col(score) >= least).dropna(subset=[group, a, b]).distinct(), "candidates")
    found = left.limit(0)
    while left.head(1):
        best = lambda side, d=left: d.groupBy(group, side).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(a).alias("_a"), F.col(b).alias("_b"))).alias("_k")).select(group, F.col("_k._a").alias(a), F.col("_k._b").alias(b))
        taken = stored(left.join(best(a), [group, a, b], "left_semi").join(best(b), [group, a, b], "left_semi"), "taken")
        rest = stored(left.join(taken.select(group, a), [group, a], "left_anti").join(taken.select(group, b), [group, b], "left_anti"), "candidates")
        discarded(left)
        found, left = found.unionByName(taken), rest
    return found


def reordered(pairs: DataFrame, group: str, base: str, current: str) -> DataFrame:
    """Pairs that have moved: those outside a longest increasing run of current places along the baseline."""
    import bisect

    def moved(pdf):
        pdf = pdf.sort_values(base).reset_index(drop=True)
        tails, at, back = [], [], []
        for i, x in enumerate(pdf[current]):
            k = bisect.bisect_left(tails, x)
            back.append(at[k - 1] if k else None)
            tails[k : k + 1], at[k : k + 1] = [x], [i]
        keep, i = set(), at[-1] if at else None
        while i is not None:
            keep.add(i)
            i = back[i]
        return pdf[[i not in keep for i in range(len(pdf))]]

    return pairs.groupBy(group).applyInPandas(moved, pairs.schema)
