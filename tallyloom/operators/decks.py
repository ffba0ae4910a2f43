"""Decks: tables and charts of matched slides, checks of a single deck, and what its claims are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import periods, similarity
from tallyloom.operators import align
from tallyloom.operators.stored import stored


def table_changes(base: DataFrame, current: DataFrame, tables: list[str]) -> DataFrame:
    """Cells of matched tables (tables, row, col, text, period of the text) by place: ppt_table_changed, row and column added or removed.

    Within the rectangle that both have, cells compare by place; rows and columns beyond it are one finding each. A column
    that came is expected if its header (row 0) is a later period than the baseline's latest header.
    """
    size = lambda df, s: df.groupBy(*tables).agg((F.max("row") + 1).alias(f"rows_{s}"), (F.max("col") + 1).alias(f"cols_{s}"))
    sizes = size(base, "b").join(size(current, "c"), tables)
    key = [*tables, "row", "col"]
    j = base.select(*key, F.col("text").alias("before")).join(current.select(*key, F.col("text").alias("after")), key, "full_outer").join(sizes, tables)
    shared_part = (F.col("row") < F.least("rows_b", "rows_c")) & (F.col("col") < F.least("cols_b", "cols_c"))
    none = F.lit(None)
    changed = j.where(shared_part & ~F.coalesce("before", F.lit("")).eqNullSafe(F.coalesce("after", F.lit("")))).select(*key, F.lit("ppt_table_changed").alias("finding_class"), none.cast("string").alias("expected_reason"))
    latest = base.where("row = 0 and period is not null").groupBy(*tables, "period.kind").agg(F.max(F.struct("period.k1", "period.k2", "period.k3")).alias("last"))
    head = current.where("row = 0").select(*tables, "col", "period", F.col("period.kind").alias("kind")).join(latest, [*tables, "kind"])
    later = head.where(periods.is_after(F.col("period"), F.struct("kind", "last.k1", "last.k2", "last.k3"))).select(*tables, "col").withColumn("_later", F.lit(True))
    out = changed
    for what, had, has in (("row", "rows_b", "rows_c"), ("column", "cols_b", "cols_c")):
        spread = lambda lo, hi: sizes.where(F.col(hi) > F.col(lo)).select(*tables, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("col" if what == "column" else "row"))  # noqa: E731, B023
        for event, lo, hi in (("added", had, has), ("removed", has, had)):
            d = spread(lo, hi)
            reason = none.cast("string")
            if (what, event) == ("column", "added"):
                d = d.join(later, [*tables, "col"], "left")
                reason = F.when(F.col("_later"), "cadence_extension")
            other = none.cast("int")
            out = out.unionByName(d.select(*tables, (other if what == "column" else F.col("row").cast("int")).alias("row"), (F.col("col").cast("int") if what == "column" else other).alias("col"), F.lit(f"ppt_table_{what}_{event}").alias("finding_class"), reason.alias("expected_reason")))
    return out


def category_changes(base: DataFrame, current: DataFrame, series: list[str]) -> DataFrame:
    """Points of matched charts' series (series, label, place, value, period): added, removed or changed values by label and occurrence.

    A chart whose categories rolled on (the first went, as many later periods came) doesn't report those that went, and what
    came is expected; else a point that came is expected if it is later than the baseline's latest of its kind.
    """
    occurrence = F.row_number().over(Window.partitionBy(*series, "label").orderBy("place"))
    b, c = base.withColumn("_n", occurrence), current.withColumn("_n", occurrence)
    key = [*series, "label", "_n"]
    j = b.select(*key, F.col("value").alias("before"), F.lit(1).alias("_b")).join(c.select(*key, F.col("value").alias("after"), "period", F.lit(1).alias("_c")), key, "full_outer")
    event = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    d = j.withColumn("event", event)
    lists = lambda df, n: df.groupBy(*series).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias(n))  # noqa: E731  # a chart's labels
    both = lists(base, "was").join(lists(current, "now"), series)
    common = F.size(F.array_intersect("was", "now"))
    rolled = (F.size("was") == F.size("now")) & (common > 0) & (F.col("was") != F.col("now")) & (F.slice("was", F.size("was") - common + 1, common) == F.slice("now", F.lit(1), common))
    d = d.join(both.select(*series, rolled.alias("rolled")), series, "left")
    latest = base.where("period is not null").groupBy(*series, F.col("period.kind").alias("kind")).agg(F.max(F.struct("period.k1", "period.k2", "period.k3")).alias("last"))
    d = d.withColumn("kind", F.col("period.kind")).join(latest, [*series, "kind"], "left")
    later = F.col("last").isNotNull() & F.coalesce(periods.is_after(F.col("period"), F.struct("kind", "last.k1", "last.k2", "last.k3")), F.lit(False))
    keep = F.col("event").isNotNull() & ~((F.col("event") == "removed") & F.coalesce("rolled", F.lit(False)))
    reason = F.when((F.col("event") == "added") & F.coalesce("rolled", F.lit(False)), "rolling_window").when((F.col("event") == "added") & later, "cadence_extension")
    return d.where(keep).select(*series, "label", (F.col("_n") - 1).alias("occurrence"), "event", reason.alias("expected_reason"))


def duplicate_titles(slides: DataFrame) -> DataFrame:
    """Titles, in any case, of two slides or more: title, slides."""
    return slides.where(F.trim("title") != "").groupBy(F.lower(F.trim("title")).alias("title")).agg(F.count("*").alias("slides")).where("slides > 1")


def missing_slides(slides: DataFrame, required: DataFrame) -> DataFrame:
    """Required titles (title) that no slide has, in any case."""
    have = slides.where(F.trim("title") != "").select(F.lower(F.trim("title")).alias("_t")).distinct()
    return required.withColumn("_t", F.lower("title")).join(have, "_t", "left_anti").select("title")


def draft_tokens(texts: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """texts with each unfinished token that they hold as a word of its own, in any case: column token."""
    import re

    def holds(t: str) -> Column:
        return F.when(F.col(text).rlike(r"(?iU)(?<!\w)" + re.escape(t) + r"(?!\w)"), F.lit(t))

    return texts.withColumn("token", F.explode(F.array_compact(F.array(*[holds(t) for t in tokens if t]))))


def blank_cells(cells: DataFrame, tables: list[str]) -> DataFrame:
    """Blank cells right of the first column of tables' rows below the header that hold anything: tables, row, col. cells: every one, also blank ones."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    rows = cells.where("row > 0").groupBy(*tables, "row").agg(F.count_if(~blank).alias("filled"))
    return cells.where(blank & (F.col("row") > 0) & (F.col("col") > 0)).join(rows.where("filled > 0").select(*tables, "row"), [*tables, "row"], "left_semi").select(*tables, "row", "col")


def media_changes(base: DataFrame, current: DataFrame, slide: str) -> DataFrame:
    """Pictures of matched slides (slide, digest): added or removed ones as a multiset, with how many. Equal pictures can't be told apart."""
    n = lambda df, c: df.groupBy(slide, "digest").agg(F.count("*").alias(c))
    j = n(base, "b").join(n(current, "c"), [slide, "digest"], "full_outer").withColumn("d", F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return j.where("d <> 0").select(slide, "digest", F.when(F.col("d") > 0, "added").otherwise("removed").alias("event"), F.abs("d").alias("pictures"))


def claim_population(claims: DataFrame) -> DataFrame:
    """What claims (figure, period, unit, anchor, ordinal; null: unknown) can be compared by: all, identified, without a period, without an anchor."""
    known = F.col("period").isNotNull() & F.col("anchor").isNotNull()
    return claims.agg(F.count("*").alias("claims"), F.count_if(known).alias("identified"), F.count_if(F.col("period").isNull()).alias("without_period"), F.count_if(F.col("anchor").isNull()).alias("without_anchor"))


# The least likeness of two slides that pair.
LEAST_LIKENESS = 55.0


def matched_slides(base: DataFrame, current: DataFrame, deck: str, pins: DataFrame | None = None, least: float = LEAST_LIKENESS) -> DataFrame:
    """Slides of two cycles of each deck paired one to one: deck, a and b (places), score (null if pinned).

    Slides: deck, index, title, body. pins (deck, base, current: titles) win; the first slide of a title counts. The others
    pair by likeness of titles, bodies and places, best first, ties by places.
    """
    sizes = base.groupBy(deck).agg(F.count("*").alias("_m")).join(current.groupBy(deck).agg(F.count("*").alias("_n")), deck, "full_outer").select(deck, F.greatest("_m", "_n", F.lit(1)).alias("_size"))
    side = lambda df, i: df.select(deck, F.col("index").alias(i), F.coalesce("title", F.lit("")).alias(f"_title_{i}"), F.coalesce("body", F.lit("")).alias(f"_body_{i}"))
    x, y = side(base, "a"), side(current, "b")
    pinned = None
    if pins is not None:
        first = lambda df, i: df.groupBy(deck, F.col(f"_title_{i}").alias("base" if i == "a" else "current")).agg(F.min(i).alias(i))
        p = pins.select(deck, "base", "current").distinct().join(first(x, "a"), [deck, "base"]).join(first(y, "b"), [deck, "current"])
        pinned = stored(p.groupBy(deck, "a").agg(F.min("b").alias("b")).groupBy(deck, "b").agg(F.min("a").alias("a")).select(deck, "a", "b", F.lit(None).cast("double").alias("score")))
        x, y = x.join(pinned, [deck, "a"], "left_anti"), y.join(pinned, [deck, "b"], "left_anti")
    place = 100.0 * (1 - F.abs(F.col("a") - F.col("b")) / F.col("_size"))
    score = similarity.slide_score(similarity.indel(F.col("_title_a"), F.col("_title_b")), similarity.token_set(F.col("_body_a"), F.col("_body_b")), place)
    found = align.greedy(x.join(y, deck).join(sizes, deck).select(deck, "a", "b", score.alias("score")), deck, "a", "b", "score", least)
    return found if pinned is None else pinned.unionByName(found)
