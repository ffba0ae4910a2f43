"""Parts of an axis that compare by their own rules: preamble, body and footer, confirmed columns, and which rule governs a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.align import keyed, null_safe
from tallyloom.operators.graph import contained
from tallyloom.operators.stored import numbered, stored

BOX = ("min_row", "max_row", "min_col", "max_col")


def governing(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """regions (id, sheet, box) with rule: the first by place of the rules (rule, sheet, row, col of the anchor, place) whose anchor lies in the region, null if none does.

    Anchors outlast a region's growth, which moves its ends.
    """
    hit = contained(rules.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "rule", "place"), regions.select("id", "sheet", *BOX))
    first = hit.groupBy("id").agg(F.min(F.struct("place", "rule")).alias("_r")).select("id", F.col("_r.rule").alias("rule"))
    return regions.join(first, "id", "left")


def key_part(value: Column, vtype: Column, *, exact: bool = False, trim: bool = False) -> Column:
    """A part of an identity key: text without case and outer spaces, or exact (trim: without outer spaces) and told from other types; null if blank."""
    blank = value.isNull() | ((vtype == "text") & (F.trim(value) == ""))
    text = (F.trim(value) if trim else value) if exact else F.lower(F.trim(value))
    return F.when(~blank, F.concat_ws(":", F.when(vtype == "text", "text").otherwise(vtype if exact else F.lit("value")), F.when(vtype == "text", text).otherwise(value)))


def in_order(d: DataFrame, axis: list[str], order: str, name: str) -> DataFrame:
    """d with the place of each row within its axis, from 0, by a range sort over all axes."""
    place = F.struct(*axis, order)
    n = numbered(d.select(place.alias("_place")), "_place")
    j = d.withColumn("_place", place).join(n, "_place")
    first = j.groupBy(*axis).agg(F.min("n").alias("_first")).select(*(F.col(c).alias(f"_{c}") for c in axis), "_first")
    cond = F.lit(True)
    for c in axis:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.join(first, cond).withColumn(name, F.col("n") - F.col("_first")).drop("_place", "n", "_first", *(f"_{c}" for c in axis))


def identified(base: DataFrame, current: DataFrame, axis: list[str], key: list[str], order: str, duplicates: str = "skip") -> DataFrame:
    """Rows of each axis joined by an identity rule: axis, base and current (their order values), event.

    Rows with a null key part take no part. Keys that occur once on both sides pair. Of the others: skip leaves those that occur
    more often out (event skipped), occurrence pairs them in order, position pairs all that is left in order whatever its key.
    """
    if duplicates not in ("skip", "occurrence", "position"):
        raise ValueError(duplicates)
    whole = " and ".join(f"`{c}` is not null" for c in key)
    b, c = (d.where(whole).select(*axis, *key, order) for d in (base, current))
    if duplicates == "occurrence":
        j = keyed(b, c, [*axis, *key], [order])
        return j.select(*(F.coalesce(f"base.{x}", f"current.{x}").alias(x) for x in axis), F.col(f"base.{order}").alias("base"), F.col(f"current.{order}").alias("current"), "event")
    one = lambda d, s: d.groupBy(*axis, *key).agg(F.count("*").alias(f"n_{s}"), F.min(order).alias(s))
    j = stored(one(b, "base").alias("a").join(one(c, "current").alias("b"), null_safe([*axis, *key]), "full_outer").select(*(F.coalesce(f"a.{x}", f"b.{x}").alias(x) for x in (*axis, *key)), "base", "n_base", "current", "n_current"), "identity")
    paired = j.where("n_base = 1 and n_current = 1").select(*axis, "base", "current", F.lit("paired").alias("event"))
    if duplicates == "skip":
        many = (F.coalesce("n_base", F.lit(0)) > 1) | (F.coalesce("n_current", F.lit(0)) > 1)
        alone = j.where(~many & (F.col("n_base").isNull() | F.col("n_current").isNull())).select(*axis, "base", "current", F.when(F.col("n_current").isNull(), "deleted").otherwise("inserted").alias("event"))
        told = j.where(many).select(*axis, *key)
        side = lambda d, s: d.alias("a").join(told.alias("b"), null_safe([*axis, *key]), "left_semi").select(*axis, *(F.col(order).alias(n) if n == s else F.lit(None).cast(d.schema[order].dataType).alias(n) for n in ("base", "current")), F.lit("skipped").alias("event"))
        return paired.unionByName(alone).unionByName(side(b, "base")).unionByName(side(c, "current"))
    rest = lambda d, s: in_order(d.alias("a").join(paired.select(*axis, F.col(s).alias(order)).alias("b"), null_safe([*axis, order]), "left_anti"), axis, order, "_n")
    x, y = rest(b, "base").alias("a"), rest(c, "current").alias("b")
    left = x.join(y, null_safe([*axis, "_n"]), "full_outer").select(*(F.coalesce(f"a.{z}", f"b.{z}").alias(z) for z in axis), F.col(f"a.{order}").alias("base"), F.col(f"b.{order}").alias("current"))
    return paired.unionByName(left.withColumn("event", F.when(F.col("base").isNull(), "inserted").when(F.col("current").isNull(), "deleted").otherwise("paired")))


def segmented(base: DataFrame, current: DataFrame, axis: list[str], key: list[str], order: str, header: str, footer: str, duplicates: str = "skip") -> DataFrame:
    """Rows of each axis by segment: axis, segment (preamble, body, footer), base and current (their order values), event.

    header and footer: columns with the last row of the preamble and the first of the footer on that side (null: there is none).
    A preamble is matched from its end, so what was added shows at the top; a footer from its start; the body by identity.
    """
    def cut(d: DataFrame) -> DataFrame:
        top, bottom = F.coalesce(F.col(order) <= F.col(header), F.lit(False)), F.coalesce(F.col(order) >= F.col(footer), F.lit(False))
        return d.withColumn("_segment", F.when(top, "preamble").when(bottom, "footer").otherwise("body")).withColumn("_at", F.when(top, F.col(header) - F.col(order)).when(bottom, F.col(order) - F.col(footer)))

    b, c = cut(base), cut(current)
    on = [*axis, "_segment", "_at"]
    ends = lambda d: d.where("_segment <> 'body'").select(*on, order)
    x, y = ends(b).alias("a"), ends(c).alias("b")
    j = x.join(y, null_safe(on), "full_outer").select(*(F.coalesce(f"a.{z}", f"b.{z}").alias(z) for z in (*axis, "_segment")), F.col(f"a.{order}").alias("base"), F.col(f"b.{order}").alias("current"))
    j = j.withColumn("event", F.when(F.col("base").isNull(), "inserted").when(F.col("current").isNull(), "deleted").otherwise("paired"))
    body = identified(b.where("_segment = 'body'"), c.where("_segment = 'body'"), axis, key, order, duplicates).withColumn("_segment", F.lit("body"))
    return j.unionByName(body).select(*axis, F.col("_segment").alias("segment"), "base", "current", "event")


def confirmed_columns(base: DataFrame, current: DataFrame, mapping: DataFrame, region: str) -> DataFrame:
    """Columns (region, col) of each region paired by a confirmed mapping (region, base, current), the others by place among what is left: region, base, current, event, moved.

    A mapping to a column that isn't in the region counts for nothing.
    """
    m = mapping.select(region, "base", "current").distinct().join(base.select(region, F.col("col").alias("base")), [region, "base"], "left_semi").join(current.select(region, F.col("col").alias("current")), [region, "current"], "left_semi")
    w = Window.partitionBy(region).orderBy("col")  # a sheet has few thousand columns at most
    rest = lambda d, s: d.join(m.select(region, F.col(s).alias("col")), [region, "col"], "left_anti").withColumn("_n", F.row_number().over(w)).select(region, "_n", F.col("col").alias(s))
    left = rest(base, "base").join(rest(current, "current"), [region, "_n"], "full_outer").select(region, "base", "current", F.lit(False).alias("moved"))
    out = m.withColumn("moved", F.lit(True)).unionByName(left)
    return out.withColumn("event", F.when(F.col("base").isNull(), "inserted").when(F.col("current").isNull(), "deleted").otherwise("paired"))
