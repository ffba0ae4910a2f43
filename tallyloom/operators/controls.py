"""Declared controls: required, unique, bounds, tie-out, and blanks that availability rules allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a required range's second axis that one list holds, about.
SHARE = 4096


def required(populated: DataFrame, rows: DataFrame, columns: DataFrame, on: list[str], and_: list[str]) -> DataFrame:
    """Coordinates of the grid rows x columns without a populated cell.

    A row that has all positions needs no grid: only rows with fewer are completed, each from its own share of the positions,
    which are dealt to as many parts as a position list of SHARE values needs.
    """
    axis = columns.select(*and_).distinct()
    own = populated.select(*on, *and_).distinct().join(F.broadcast(axis) if axis.count() <= SHARE else axis, and_, "left_semi")
    every = axis.count()
    short = rows.select(*on).distinct().join(own.groupBy(*on).agg(F.count("*").alias("_n")), on, "left").where(F.coalesce("_n", F.lit(0)) < every).select(*on)
    parts = max(1, -(-every // SHARE))
    lists = axis.groupBy(F.pmod(F.hash(*and_), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct(*and_)).alias("_list"))
    grid = short.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(lists, "_part").select(*on, F.explode("_list").alias("_p"))
    return grid.select(*on, *[F.col(f"_p.{c}").alias(c) for c in and_]).join(own, [*on, *and_], "left_anti")


def duplicates(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows after the first of each composite key, with the first one's place; keys all of whose parts are null or empty don't count.

    The first is found by a partial aggregate, so a hot key doesn't gather in one task.
    """
    some = F.lit(False)
    for k in key:
        some = some | (F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    df = df.where(some)
    first = df.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}"))
    return df.alias("d").join(first.alias("f"), cond).where(F.col(f"d.{order}") > F.col("f.first")).select("d.*", "f.first")


def out_of_bounds(df: DataFrame, value: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose number lies below low or above high, with the bound that is broken."""
    v = F.col(value)
    below = F.lit(False) if low is None else v < low
    above = F.lit(False) if high is None else v > high
    return df.where(below | above).withColumn("bound", F.when(below, "min").otherwise("max"))


def tie_out(members: DataFrame, targets: DataFrame, key: list[str], value: str, target: str, absolute: float, relative: float, sign: Column | None = None) -> DataFrame:
    """Signed sums of members against one target of each key: total, target, status ok, mismatch or invalid.

    invalid: a member isn't a number, or there is no target or no member.
    """
    signed = F.col(value) * (F.lit(1) if sign is None else sign)
    total = members.groupBy(*key).agg(F.sum(signed).alias("total"), F.count_if(F.col(value).isNull()).alias("_bad"))
    j = total.withColumn("_has", F.lit(True)).join(targets.select(*key, F.col(target).alias("target")), key, "full_outer")
    delta = F.abs(F.col("total") - F.col("target"))
    near = (delta <= absolute) | ((F.col("target") != 0) & (delta <= relative * F.abs(F.col("target"))))
    bad = F.col("_has").isNull() | (F.col("_bad") > 0) | F.col("target").isNull()
    return j.select(*key, "total", "target", F.when(bad, "invalid").when(near, "ok").otherwise("mismatch").alias("status"))


def prerequisites(base: DataFrame, current: DataFrame, selector: str, value: str) -> DataFrame:
    """Selectors whose values must be equal on both sides before a run: selector and reason; no row means go."""
    j = base.select(selector, F.col(value).alias("b")).withColumn("_b", F.lit(1)).join(current.select(selector, F.col(value).alias("c")).withColumn("_c", F.lit(1)), selector, "full_outer")
    reason = F.when(F.col("_b").isNull(), "missing_in_baseline").when(F.col("_c").isNull(), "missing_in_current").when(F.col("b").isNull() | F.col("c").isNull(), "blank").when(F.col("b") != F.col("c"), "different")
    return j.select(selector, reason.alias("reason")).where("reason is not null")


def allowed_blanks(blanks: DataFrame, rules: list[tuple[int, int, int, int, tuple[int, int, int]]], row: str, col: str, period: str) -> DataFrame:
    """Blanks with column allowed: every rule whose rectangle (rows, then columns) holds the cell lets periods after its own be blank, and one does."""
    after = [F.when(F.col(row).between(a, b) & F.col(col).between(c, d), F.struct(F.col(f"{period}.k1"), F.col(f"{period}.k2"), F.col(f"{period}.k3")) > F.struct(*map(F.lit, last))) for a, b, c, d, last in rules]
    hits = F.array_compact(F.array(*after)) if after else F.array().cast("array<boolean>")
    return blanks.withColumn("allowed", (F.size(hits) > 0) & F.forall(hits, lambda x: x))


def blank_keys(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """Rows with a blank part of an identity key, which stop a run: place and the blank parts."""
    blanks = F.array_compact(F.array(*[F.when(F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == ""), F.lit(k)) for k in key]))
    return df.select(F.col(place), blanks.alias("blank")).where(F.size("blank") > 0)


def governing(targets: DataFrame, periods_: DataFrame) -> DataFrame:
    """target and the period that governs it. targets: target, box; periods_: box, row, col, period of declared period cells.

    One period cell governs a whole target; a line of them as long as the target governs row by row or column by column.
    """
    t = targets.select("target", *[F.col(c).alias(f"t_{c}") for c in ("min_row", "max_row", "min_col", "max_col")], "group")
    j = t.join(periods_, "group")
    rows, cols = F.col("t_max_row") - F.col("t_min_row"), F.col("t_max_col") - F.col("t_min_col")
    single = (F.col("min_row") == F.col("max_row")) & (F.col("min_col") == F.col("max_col"))
    down = ~single & (F.col("min_col") == F.col("max_col")) & (F.col("max_row") - F.col("min_row") == rows)
    across = ~single & (F.col("min_row") == F.col("max_row")) & (F.col("max_col") - F.col("min_col") == cols)
    at_row = F.when(down, F.col("t_min_row") + F.col("row") - F.col("min_row"))
    at_col = F.when(across, F.col("t_min_col") + F.col("col") - F.col("min_col"))
    return j.where(single | down | across).select("target", at_row.alias("row"), at_col.alias("col"), "period")
