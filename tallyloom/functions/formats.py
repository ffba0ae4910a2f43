"""Number formats: what a cell's format shows of its value. Parsed once for each distinct format, then joined."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = re.compile(r"(?P<before>[^0#?.,%E]*)(?P<digits>[0#?,]*[0#?]|)(?P<point>\.(?P<decimals>[0#?]+))?(?P<scale>,*)(?P<exponent>E[+-]0+)?(?P<after>[^0#?.,E]*)", re.IGNORECASE)
RULE = "struct<decimals:int,percent:boolean,thousands:int,grouped:boolean,scientific:boolean>"
RULE_TYPE = pa.struct([("decimals", pa.int32()), ("percent", pa.bool_()), ("thousands", pa.int32()), ("grouped", pa.bool_()), ("scientific", pa.bool_())])
#: Decimals that a format may show; a double has no more.
MOST_DECIMALS = 17


def first_section(fmt: str) -> str:
    """A format up to its first semicolon outside quotes, escapes and brackets, without what those hide."""
    out, i = [], 0
    while i < len(fmt) and fmt[i] != ";":
        c = fmt[i]
        if c == '"':
            i = fmt.find('"', i + 1) if '"' in fmt[i + 1 :] else len(fmt)
        elif c in "\\_*":
            i += 1
        elif c == "[":
            i = fmt.find("]", i) if "]" in fmt[i:] else len(fmt)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def parse(fmt: str | None) -> dict | None:
    """decimals, percent, thousands (how often the value is divided by 1000), grouped, scientific; null for formats that aren't plain numbers."""
    if fmt is None:
        return None
    own = first_section(fmt).strip()
    if own.lower() in ("", "general", "@") or re.search(r"[dmyhs]", own, re.IGNORECASE):
        return None
    m = KNOWN.fullmatch(own)
    if not m or not (m["digits"] or m["decimals"]) or not re.fullmatch(r"[\s$€£₹()+\-/%]*", m["before"] + m["after"]):
        return None
    return {"decimals": len(m["decimals"] or ""), "percent": "%" in m["before"] + m["after"], "thousands": len(m["scale"]), "grouped": "," in m["digits"], "scientific": bool(m["exponent"])}


def with_rule(cells: DataFrame, fmt: str, name: str) -> DataFrame:
    """cells with the rule of each format; Python sees each distinct format once."""

    @F.arrow_udf(RULE)
    def rule(formats: pa.Array) -> pa.Array:
        return pa.array([parse(f) for f in formats.to_pylist()], RULE_TYPE)

    known = cells.select(F.col(fmt).alias("_f")).where("_f is not null").distinct().withColumn(name, rule(F.col("_f")))
    return cells.join(known, cells[fmt] == known["_f"], "left").drop("_f")


def shown(value: Column, rule: Column) -> Column:
    """What the rule shows, without grouping: the number rounded half away from zero to its decimals; null for scientific or no rule.

    An exact decimal is rounded, so that 1.005 with two decimals is 1.01 everywhere.
    """
    x = value * F.when(rule["percent"], 100).otherwise(1) / F.pow(F.lit(1000.0), rule["thousands"])
    out = F.lit(None).cast("string")
    for d in range(MOST_DECIMALS, -1, -1):
        out = F.when(rule["decimals"] == d, F.format_string(f"%.{d}f", x)).otherwise(out)
    return F.when(rule.isNull() | rule["scientific"] | value.isNull() | F.isnan(value), None).otherwise(out)
