"""Period labels as columns: parsing, order, distance, cadence.

A period is struct<kind, k1, k2, k3, label>: kind month, week, quarter or date; (k1, k2, k3) sorts within a kind:
(year, month, 0), (year, 0, week), (year, quarter, 0), (year, month, day). A label without a year has year 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label patterns and month names that count as periods.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-_ ]?'?(\d{2,4})$"
ISO_MONTH = r"^(\d{4})-(\d{2})$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
WEEK = r"(?i)^(?:CW|WK|W)[-_ ]?(\d{1,2})(?:[-_ ]?'?(\d{2,4}))?$"
ISO_WEEK = r"(?i)^(\d{4})[-_ ]?(?:CW|WK|W)[-_ ]?(\d{1,2})$"
QUARTER = r"(?i)^Q([1-4])(?:[-_ ]?(?:FY)?[-_ ]?'?(\d{2,4}))?$"
# A week without a year rolls over from this week on, up to that one.
ROLL_FROM, ROLL_TO = 40, 13
# The median gap in days up to which dates are weekly, monthly, quarterly.
CADENCES = ((10, "week"), (45, "month"), (120, "quarter"))
# Trailing periods that count as recent, by kind.
RECENT = {"week": 8, "month": 2, "quarter": 1}

TYPE = "struct<kind:string,k1:int,k2:int,k3:int,label:string>"


#: What each pattern's groups are, as kind, k1, k2, k3 between separators that no label has.
SEP = "\u0001"
FORMS = (
    (MONTH_NAME, "month", "$2", "$1", "0"), (ISO_DATE, "date", "$1", "$2", "$3"), (ISO_MONTH, "month", "$1", "$2", "0"),
    (ISO_WEEK, "week", "$1", "0", "$2"), (WEEK, "week", "$2", "0", "$1"), (QUARTER, "quarter", "$2", "$1", "0"),
)


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def parse_period(value: Column) -> Column:
    """The period that a text names, null if none; anything around it rules it out.

    Each pattern rewrites a label that it matches as its parts; what no pattern matches is no period.
    """

    def rewritten(t: Column) -> Column:
        x = F.when(F.instr(t, SEP) == 0, t)
        for pattern, *parts in FORMS:
            x = F.regexp_replace(x, pattern, SEP + SEP.join(parts))
        return F.struct(t.alias("t"), F.split(x, SEP).alias("p"))

    def made(x: Column) -> Column:
        p = x["p"]
        year, month = F.get(p, 2), F.get(p, 3)
        y = F.when(year == "", 0).otherwise(year.try_cast("int"))
        k1 = F.when((year != "") & (y < 100), y + 2000).otherwise(y)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month))
        period = F.struct(F.get(p, 1).alias("kind"), k1.cast("int").alias("k1"), F.when(named > 0, named).otherwise(month.try_cast("int")).cast("int").alias("k2"), F.get(p, 4).try_cast("int").alias("k3"), x["t"].alias("label"))
        return F.when(F.size(p) == 5, period)

    return bound(bound(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), rewritten), made)


def with_period(df: DataFrame, label: str, name: str) -> DataFrame:
    """df with the period of each label, parsed in place: the rows are read once and stay where they are."""
    return df.withColumn(name, parse_period(F.col(label).cast("string")))


def date_period(value: Column) -> Column:
    """The period of a date or timestamp."""
    made = F.struct(F.lit("date").alias("kind"), F.year(value).alias("k1"), F.month(value).alias("k2"), F.dayofmonth(value).alias("k3"), F.date_format(value, "yyyy-MM-dd").alias("label"))
    return F.when(value.isNotNull(), made)


def sort_key(period: Column) -> Column:
    return F.struct(period["k1"], period["k2"], period["k3"])


def is_after(current: Column, previous: Column) -> Column:
    """Whether one period follows another of its kind; weeks without a year may roll over at the turn of the year."""
    rolls = (previous["k3"] >= ROLL_FROM) & (current["k3"] <= ROLL_TO)
    backwards = (current["kind"] == "week") & (current["k1"] == 0) & (previous["k1"] == 0) & (current["k3"] < previous["k3"])
    return (current["kind"] == previous["kind"]) & F.when(backwards, rolls).otherwise(sort_key(current) > sort_key(previous))


def distance(current: Column, previous: Column) -> Column:
    """Steps between two periods of a kind: months, quarters, or weeks (years of 53 weeks); null for dates or different kinds."""
    years = current["k1"] - previous["k1"]
    weeks = F.when((current["k1"] == 0) & (previous["k1"] == 0) & (current["k3"] < previous["k3"]), current["k3"] + 53 - previous["k3"]).otherwise(years * 53 + current["k3"] - previous["k3"])
    return F.when(current["kind"] != previous["kind"], None).when(current["kind"] == "month", years * 12 + current["k2"] - previous["k2"]).when(current["kind"] == "quarter", years * 4 + current["k2"] - previous["k2"]).when(current["kind"] == "week", weeks)


def cadence(median_gap: Column) -> Column:
    """Of dates with this median gap in days; null if sparser than quarterly."""
    out = F.lit(None).cast("string")
    for days, kind in reversed(CADENCES):
        out = F.when(median_gap <= days, kind).otherwise(out)
    return out


# What names a period within a text, without what anchors it there.
IN_TEXT = r"(?i)(?<![\w])(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-_ ]?'?\d{2,4}|\d{4}-\d{2}-\d{2}|\d{4}-\d{2}|\d{4}[-_ ]?(?:CW|WK|W)[-_ ]?\d{1,2}|(?:CW|WK|W)[-_ ]?\d{1,2}(?:[-_ ]?'?\d{2,4})?|Q[1-4](?:[-_ ]?(?:FY)?[-_ ]?'?\d{2,4})?)(?![\w])"


def in_text(text: Column) -> Column:
    """The periods that a text names, in order."""
    found = F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0))
    return F.filter(F.transform(found, parse_period), lambda p: p.isNotNull())
