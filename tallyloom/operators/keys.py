"""Which columns identify rows: screening of columns and of combinations, and how keys of two cycles overlap."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.stored import stored

# What a key must cover, how unique it must be, how far both cycles' keys must overlap.
COVERAGE, UNIQUE, OVERLAP = 0.95, 0.995, 0.90
# Rows that place would pair wrongly, and findings that a key must avoid, before it is suggested.
DISPLACED, PROJECTED = 0.20, 10_000


def screen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: rows, filled, distinct values, and whether it can be part of a key. One pass unpivots, then two counts."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.name", "x.v")
    n = long.groupBy("name", "v").agg(F.count("*").alias("n"))
    filled = F.col("v").isNotNull() & (F.trim("v") != "")
    return n.groupBy("name").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"), F.count_if(filled).alias("distinct_values"))


def combined(df: DataFrame, columns: list[str], size: int = 3) -> DataFrame:
    """Of each combination of up to size columns: whole rows, distinct keys, and whether they make a key. All combinations are counted as grouping sets, in one shuffle of values."""
    sets = [c for k in range(1, size + 1) for c in combinations(columns, k)]
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}  # set in the grouping id where a column is left out
    mask = {c: sum(b for x, b in bit.items() if x not in c) for c in sets}
    n = df.groupingSets([[F.col(x) for x in c] for c in sets], *columns).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    key = F.create_map(*(x for c in sets for x in (F.lit(mask[c]).cast("long"), F.lit("+".join(c)))))[F.col("_id")]
    whole = F.lit(True)
    for c in columns:
        whole = whole & (F.col("_id").bitwiseAND(bit[c]) != 0) | whole & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    n = n.select(key.alias("key"), F.when(whole, 1).alias("v"), "n")
    d = n.groupBy("key").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("whole"), F.count("v").alias("distinct_keys"))
    return d.withColumn("is_key", (F.col("whole") >= COVERAGE * F.col("rows")) & (F.col("distinct_keys") >= UNIQUE * F.col("whole")))


def overlap(base: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of both, common ones, and their share of all."""
    a, b = base.select(*key).dropna().distinct().withColumn("_a", F.lit(1)), current.select(*key).dropna().distinct().withColumn("_b", F.lit(1))
    d = a.join(b, key, "full_outer").agg(F.count("_a").alias("baseline_keys"), F.count("_b").alias("current_keys"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count("*").alias("all_keys"))
    return d.withColumn("overlap", F.col("common") / F.greatest(F.col("all_keys"), F.lit(1))).drop("all_keys")


# Numbers that a sequence has at least, digits that its steps are rounded to.
SEQUENCE, STEP_DIGITS = 3, 9


def sequences(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """name and is_sequence of each column: whether its numbers, in order, have one step that isn't zero. Such a column only repeats places."""
    long = df.select(F.col(order).alias("_o"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("_o", "x.name", "x.v").where("v is not null")
    # Steps add up to the whole way only if they are all alike: least, greatest and number of distinct places decide without one task for each column.
    w = Window.partitionBy("name", F.floor(F.col("_o") / 4096)).orderBy("_o")
    steps = long.withColumn("_d", F.round(F.col("v") - F.lag("v").over(w), STEP_DIGITS)).withColumn("_block", F.floor(F.col("_o") / 4096))
    inner = steps.where("_d is not null").groupBy("name").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi"))
    edge = long.withColumn("_block", F.floor(F.col("_o") / 4096)).groupBy("name", "_block").agg(F.min_by("v", "_o").alias("first"), F.max_by("v", "_o").alias("last"))
    over = edge.withColumn("_d", F.round(F.col("first") - F.lag("last").over(Window.partitionBy("name").orderBy("_block")), STEP_DIGITS)).where("_d is not null").groupBy("name").agg(F.min("_d").alias("lo2"), F.max("_d").alias("hi2"))
    n = long.groupBy("name").agg(F.count("*").alias("n"))
    j = n.join(inner, "name", "left").join(over, "name", "left")
    lo, hi = F.least("lo", "lo2"), F.greatest("hi", "hi2")
    return j.select("name", F.coalesce((F.col("n") >= SEQUENCE) & (lo == hi) & (lo != 0), F.lit(False)).alias("is_sequence"))


# Keys compared by place and by key, and what makes a suggestion: share of wrong pairs that the key avoids, and how many.
SAMPLE, REDUCTION, AVOIDED = 500, 0.50, 10_000
#: Relative error of the sketches of distinct keys; combinations that fall short by more than five times that are out.
SKETCH = 0.02


def component(c: str) -> Column:
    """A column's part of a key: its text without case and outer spaces; null if blank."""
    t = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(t != "", t)


def discovered(base: DataFrame, current: DataFrame, columns: list[str], row: str, size: int = 3) -> DataFrame:
    """Smallest combinations of up to size columns that identify the rows of two cycles: key, coverage, uniqueness, overlap, displaced, reduction, projected, suggested.

    row: the place of each row, numbers from 0. Level by level: one pass over a side counts whole rows and sketches distinct
    keys of all combinations at once, without a row for each; a combination with too many blanks, and all that hold it, is out;
    only combinations whose sketch may reach the bound are counted exactly; what holds a key isn't looked at. coverage and
    uniqueness are the lesser of both sides', overlap is that of keys that occur once, displaced the share of common ones at
    another place. reduction and projected compare the other columns of about SAMPLE common keys by place and by key.
    """
    sides = [d.select(F.col(row).cast("long").alias("_row"), *(component(c).alias(c) for c in columns)) for d in (base, current)]
    level, found, blank = [(c,) for c in columns], [], set()
    for k in range(1, size + 1):
        if not level:
            break
        alive = dict.fromkeys(level, True)
        for d in sides:
            whole = {c: " and ".join(f"`{x}` is not null" for x in c) for c in level}
            told = d.agg(F.count("*").alias("n"), *[x for i, c in enumerate(level) for x in (F.count_if(F.expr(whole[c])).alias(f"w{i}"), F.approx_count_distinct(F.when(F.expr(whole[c]), F.xxhash64(*c)), SKETCH).alias(f"d{i}"))]).first()
            for i, c in enumerate(level):
                if told[f"w{i}"] < COVERAGE * told["n"] or not told["n"]:
                    blank.add(c)
                elif told[f"d{i}"] < UNIQUE * (1 - 5 * SKETCH) * told[f"w{i}"]:
                    alive[c] = False
        exact = [c for c in level if c not in blank and alive[c]]
        keys = []
        if exact:
            measured_ = stored(measured(*sides, exact), "keys")
            found.append(measured_)
            keys = [tuple(r.key.split("+")) for r in measured_.select("key").collect()]  # as many as combinations at most
        open_ = {c for c in level if c not in blank and c not in keys}
        level = [c for c in combinations(columns, k + 1) if all(x in open_ for x in combinations(c, k))]
    if not found:
        return measured(*sides, [])
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


def measured(base: DataFrame, current: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """Exact measures of those combinations that are keys of both sides (_row and the columns).

    Both sides' keys meet in one shuffle of hashes; of the columns only the rows of the sampled keys are read again.
    """
    spark = base.sparkSession
    columns = base.columns[1:]
    n = [max(d.count(), 1) for d in (base, current)]

    def listed(d: DataFrame, here: str) -> DataFrame:
        """A row for each whole key: the place of its combination, two hashes, and its own row on its side."""
        rows = [F.when(F.expr(" and ".join(f"`{x}` is not null" for x in c)), F.struct(F.lit(i).alias("k"), F.xxhash64(*c).alias("x"), F.xxhash64(F.lit(1), *reversed(c)).alias("y"))) for i, c in enumerate(keys)]
        empty = F.array().cast("array<struct<k:int,x:bigint,y:bigint>>")
        own = d.select("_row", F.explode(F.array(*rows) if rows else empty).alias("_e")).where("_e is not null")
        return own.select("_e.*", *[(F.col("_row") if s == here else F.lit(None).cast("long")).alias(f"r{s}") for s in "ab"])

    # A key that occurs once on a side has its row there as the least; of others only the number counts.
    groups = listed(base, "a").unionByName(listed(current, "b")).groupBy("k", "x", "y").agg(*[f(f"r{s}").alias(f"{c}{s}") for s in "ab" for f, c in ((F.count, "n"), (F.min, "r"))])
    groups = stored(groups.select("k", "y", "na", "nb", *[F.when((F.col("na") == 1) & (F.col("nb") == 1), F.col(r)).alias(r) for r in ("ra", "rb")]), "keys-met")
    pair = F.col("ra").isNotNull()
    per = [x for s in "ab" for x in (F.sum(f"n{s}").alias(f"whole_{s}"), F.count_if(F.col(f"n{s}") == 1).alias(f"once_{s}"))]
    m = groups.groupBy("k").agg(*per, F.count_if(pair).alias("common"), F.count_if(pair & (F.col("ra") != F.col("rb"))).alias("moved")).where("whole_a > 0 and whole_b > 0")
    m = m.select("k", F.least(F.col("whole_a") / n[0], F.col("whole_b") / n[1]).alias("coverage"), F.least(F.col("once_a") / F.col("whole_a"), F.col("once_b") / F.col("whole_b")).alias("uniqueness"), (F.col("common") / F.greatest(F.col("once_a") + F.col("once_b") - F.col("common"), F.lit(1))).alias("overlap"), (F.col("moved") / F.greatest("common", F.lit(1))).alias("displaced"), "common")
    m = stored(m.where((F.col("coverage") >= COVERAGE) & (F.col("uniqueness") >= UNIQUE)), "keys-told")
    # About SAMPLE to twice as many common keys of each combination: so few that they are sent to where the rows are.
    every = F.greatest(F.floor(F.col("common") / SAMPLE), F.lit(1))
    some = stored(groups.where(pair).join(F.broadcast(m.select("k", "common")), "k").where(F.pmod("y", every) == 0).select("k", "ra", "rb"), "keys-sampled")

    def values(d: DataFrame, places: DataFrame, r: str, v: str) -> DataFrame:
        return d.join(F.broadcast(places.withColumnRenamed(places.columns[0], "_row").distinct()), "_row").select(F.col("_row").alias(r), F.array(*columns).alias(v))

    other = spark.createDataFrame([(i, "+".join(c), [x not in c for x in columns]) for i, c in enumerate(keys)] or [(0, "", [])], "k int, key string, other array<boolean>")
    j = some.join(values(base, some.select("ra"), "ra", "v"), "ra").join(values(current, some.select("rb"), "rb", "w"), "rb").join(values(current, some.select("ra"), "ra", "p"), "ra", "left").join(F.broadcast(other), "k")
    differ = lambda x, y: F.size(F.filter(F.zip_with(F.zip_with(x, y, lambda s, t: ~s.eqNullSafe(t)), "other", lambda d, o: d & o), lambda d: d))
    s = j.groupBy("k").agg(F.count("*").alias("sampled"), F.sum(differ("v", "w")).alias("by_key"), F.sum(F.when(F.col("p").isNotNull(), differ("v", "p")).otherwise(0)).alias("by_place"))
    m = m.join(s, "k", "left").fillna(0, ["sampled", "by_key", "by_place"]).join(F.broadcast(other.select("k", "key")), "k")
    reduction = F.when(F.col("by_place") == 0, 0.0).otherwise(F.greatest(1 - F.col("by_key") / F.col("by_place"), F.lit(0.0)))
    projected = F.when(F.col("by_place") == 0, 0).otherwise(F.round(F.col("by_place") * F.col("common") / F.greatest("sampled", F.lit(1))))
    m = m.withColumn("reduction", reduction).withColumn("projected", projected.cast("long"))
    good = (F.col("overlap") >= OVERLAP) & (F.col("displaced") >= DISPLACED) & (F.col("projected") >= PROJECTED) & ((F.col("reduction") >= REDUCTION) | (F.round(F.col("projected") * F.col("reduction")) >= AVOIDED))
    return m.select("key", "coverage", "uniqueness", "overlap", "displaced", "reduction", "projected", good.alias("suggested"))


def header_rows(cells: DataFrame, depth: int = 10) -> DataFrame:
    """sheet and header_row: of a sheet's first rows the one with the most distinct texts, no number, and data below; of equals the first."""
    top = cells.where(F.col("row") <= depth).groupBy("sheet", "row").agg(F.countDistinct(F.when(F.col("vtype") == "text", F.col("value"))).alias("texts"), F.count_if(F.col("vtype") != "text").alias("others"))
    last = cells.groupBy("sheet").agg(F.max("row").alias("bottom"))
    good = top.where("others = 0 and texts > 0").join(last, "sheet").where("row < bottom")
    return good.groupBy("sheet").agg(F.max(F.struct("texts", (-F.col("row")).alias("up"))).alias("m")).select("sheet", (-F.col("m.up")).alias("header_row"))


def evaluated(candidates: DataFrame) -> DataFrame:
    """Candidate keys (sheet, key, coverage, uniqueness, overlap, displaced, projected) with whether one is suggested, best first by rank.

    displaced: share of rows that place alone would pair wrongly; projected: findings that the key would avoid.
    """
    ok = (F.col("coverage") >= COVERAGE) & (F.col("uniqueness") >= UNIQUE) & (F.col("overlap") >= OVERLAP) & (F.col("displaced") >= DISPLACED) & (F.col("projected") >= PROJECTED)
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy(ok.desc(), F.col("overlap").desc(), F.col("uniqueness").desc(), "key"))
    return candidates.withColumn("suggested", ok).withColumn("rank", rank)
