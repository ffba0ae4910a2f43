"""Pseudonyms and buckets that keep structure and hide content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(seed: int, *parts: Column | str | int) -> Column:
    """SHA-256 of the seed and the parts, joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"), 256)


def pseudonym(text: Column, seed: int, *place: Column | str | int) -> Column:
    """TXT_ and six hexadecimal digits that depend on the seed, the text and where it stands: hashing a dictionary doesn't find it without the seed."""
    return F.when(text.isNotNull(), F.concat(F.lit("TXT_"), F.substring(digest(seed, text, *place), 1, 6)))


# The least factor of a scrambled number, and how far above it factors reach.
LEAST_FACTOR, FACTOR_SPAN = 0.85, 0.30


def factor(seed: int, *place: Column | str | int) -> Column:
    """A factor for each place, evenly spread."""
    return LEAST_FACTOR + F.conv(F.substring(digest(seed, *place), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64 * FACTOR_SPAN


def scrambled(x: Column, seed: int, *place: Column | str | int, whole: bool = False) -> Column:
    """A number near x by the factor of its place: never x itself unless that is 0; whole numbers (whole) stay whole, others have six decimals."""
    y = x.cast("double") * factor(seed, *place)
    away = F.when(x > 0, 1).otherwise(-1)
    if whole:
        r = F.bround(y, 0).cast("long")
        return F.when((r == x) & (x != 0), r + away).otherwise(r)
    r = F.bround(y, 6)
    return F.when((r == x) & (x != 0), x + away * F.greatest(F.abs(x) * 1e-6, F.lit(1e-6))).otherwise(r)


# The lengths up to which texts are told apart.
LENGTHS = ((0, "0"), (20, "1-20"), (80, "21-80"), (200, "81-200"))


def length_bucket(text: Column) -> Column:
    """How long a text is; none if it is null."""
    n = F.length(text)
    out = F.lit("201+")
    for most, name in reversed(LENGTHS):
        out = F.when(n <= most, name).otherwise(out)
    return F.when(n.isNull(), "none").otherwise(out)


def kind(text: Column) -> Column:
    """What a cell's text is: blank, number, date, error, text."""
    t = F.trim(text)
    return F.when(text.isNull() | (t == ""), "blank").when(t.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(t.isin("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"), "error").otherwise("text")


# Of a text, what may stay when it is hidden: periods and figures.
KEEPS = r"(?i)(?:\b\d{4}-\d{2}(?:-\d{2})?\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-_ ]?'?\d{2,4}\b|\bQ[1-4]\b|[$€£₹]?\d[\d,.]*\s*(?:%|bn|mn|k|m|b)?)"


def redacted(text: Column, seed: int, *place: Column | str | int) -> Column:
    """text with pseudonyms for all but its periods and figures, joined by spaces; each piece's depends on the seed and the place too."""
    marked = F.regexp_replace(text, KEEPS, "\u0001$0\u0001")
    pieces = F.split(marked, "\u0001")
    hidden = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.trim(x)).when(F.trim(x) == "", F.lit("")).otherwise(pseudonym(F.trim(x), seed, *place, "segment", i)))
    return F.array_join(F.filter(hidden, lambda x: x != ""), " ")


def leaks(text: Column, originals: Column) -> Column:
    """Which of the original words are still readable in a hidden text."""
    return F.filter(originals, lambda w: F.instr(F.lower(text), F.lower(w)) > 0)


def duplicates(files: DataFrame) -> DataFrame:
    """Files (path, content) whose bytes are those of another: digest and the paths."""
    n = files.groupBy(F.sha2("content", 256).alias("digest")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return n.where(F.size("paths") > 1)


def projected_volume(base: DataFrame, current: DataFrame) -> DataFrame:
    """The most findings that each sheet (sheet, part_digest, cells) of two cycles can give: nothing if its part is the same byte by byte."""
    a, b = base.alias("a"), current.alias("b")
    j = a.join(b, F.col("a.sheet") == F.col("b.sheet"), "full_outer")
    state = F.when(F.col("a.sheet").isNull(), "added").when(F.col("b.sheet").isNull(), "removed").when(F.col("a.part_digest") == F.col("b.part_digest"), "identical").otherwise("changed")
    most = F.when(state == "identical", F.lit(0)).otherwise(F.greatest(F.coalesce("a.cells", F.lit(0)), F.coalesce("b.cells", F.lit(0))))
    return j.select(F.coalesce("a.sheet", "b.sheet").alias("sheet"), state.alias("state"), most.cast("long").alias("most_findings"))
