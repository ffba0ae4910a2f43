"""Numbers as cells and figures show them: tolerance, representation noise, magnitude, figures in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Changes of at most so many units in the last place are noise; so are changes that display alike and are
# relatively or absolutely this small; a change of this ratio is anomalous.
NOISE_ULPS, NOISE_RELATIVE, NOISE_FLOOR, ANOMALOUS_RATIO = 4, 1e-6, 1e-9, 10.0
# What figures in text look like, their scales, and the numeric tokens that a line's skeleton blanks.
FIGURE = r"(?i)(?<![\w.,-])(\()?\s*([$€£₹])?\s*(-)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|bn|mn|k|m|b)?(\))?(?![\w%])"
SCALES = {"k": 1e3, "m": 1e6, "mn": 1e6, "b": 1e9, "bn": 1e9}
NUMERIC_TOKEN = r"[-+]?[\d.,]+\s*%?"


def finite(x: Column) -> Column:
    """x, or null if it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def matches(base: Column, current: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Whether two numbers agree within an absolute or a relative (to base) tolerance."""
    delta = F.abs(current - base)
    return (delta == 0) | (delta <= absolute) | ((base != 0) & (delta <= relative * F.abs(base)))


def ulp(x: Column) -> Column:
    """The distance from |x| to the next larger double."""
    return F.call_function("reflect", F.lit("java.lang.Math"), F.lit("ulp"), x.cast("double")).cast("double")


def within_ulps(base: Column, current: Column, n: int = NOISE_ULPS) -> Column:
    return F.abs(current - base) <= n * ulp(F.greatest(F.abs(base), F.abs(current)))


def shown(x: Column, decimals: int) -> Column:
    """x as a format with so many decimals shows it, exactly rounded half up from its decimal form."""
    return F.format_string(f"%.{decimals}f", x)


def is_noise(base: Column, current: Column, decimals: int | None = None) -> Column:
    """Whether a changed pair differs in representation only. decimals: of the number format, if it has a known one."""
    delta, scale = F.abs(current - base), F.greatest(F.abs(base), F.abs(current))
    alike = F.lit(False) if decimals is None else (shown(base, decimals) == shown(current, decimals)) & ((delta <= NOISE_RELATIVE * scale) | (scale <= NOISE_FLOOR))
    return (base != current) & (within_ulps(base, current) | alike)


def materiality(base: Column, current: Column, accepted: Column, decimals: int | None = None) -> Column:
    """noise, within_tolerance or material; null unless both are finite numbers that differ."""
    b, c = finite(base), finite(current)
    return F.when(b.isNull() | c.isNull() | (b == c), None).when(is_noise(b, c, decimals), "noise").when(accepted, "within_tolerance").otherwise("material")


def is_anomalous(base: Column, current: Column) -> Column:
    """Whether a change meets or leaves zero, changes sign, or is of ANOMALOUS_RATIO or more."""
    b, c = finite(base), finite(current)
    low, high = F.least(F.abs(b), F.abs(c)), F.greatest(F.abs(b), F.abs(c))
    return F.coalesce((b != c) & ((low == 0) | ((b < 0) != (c < 0)) | (high >= ANOMALOUS_RATIO * low)), F.lit(False))


def figures(text: Column) -> Column:
    """The figures of a text in order: array of struct<raw, mantissa, scale, percent, decimals, negative, currency, value>."""

    def part(raw: Column, i: int) -> Column:
        return F.regexp_extract(raw, FIGURE, i)

    def figure(raw: Column) -> Column:
        number = F.replace(part(raw, 4), F.lit(","), F.lit(""))
        suffix = F.lower(part(raw, 5))
        scale = F.lit(1.0)
        for s, x in SCALES.items():
            scale = F.when(suffix == s, F.lit(x)).otherwise(scale)
        negative = (part(raw, 3) != "") | ((part(raw, 1) != "") & (part(raw, 6) != ""))
        signed = F.when(negative, -number.cast("double")).otherwise(number.cast("double"))
        return F.struct(
            F.trim(raw).alias("raw"), number.cast("double").alias("mantissa"), scale.alias("scale"), (suffix == "%").alias("percent"), F.length(F.regexp_extract(number, r"\.(\d+)", 1)).alias("decimals"),
            negative.alias("negative"), part(raw, 2).alias("currency"), F.when(suffix == "%", signed / 100).otherwise(signed * scale).alias("value"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0)), figure)


def skeleton(text: Column) -> Column:
    """Text with its numeric tokens blanked: equal skeletons are the same wording."""
    return F.regexp_replace(text, NUMERIC_TOKEN, "#")


def display_matches(mantissa: Column, scale: Column, percent: Column, decimals: Column, negative: Column, value: Column) -> Column:
    """Whether a value shows as the figure at the figure's precision: within half a unit of its last digit."""
    scaled = F.when(percent, value * 100).otherwise(value / scale)
    return F.abs(scaled - F.when(negative, -mantissa).otherwise(mantissa)) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9


def relative_difference(figure: Column, value: Column) -> Column:
    return F.when(figure == 0, F.abs(value)).otherwise(F.abs(value - figure) / F.abs(figure))


def evidence_tags(base: Column, current: Column, shown_base: Column | None = None, shown_current: Column | None = None) -> Column:
    """What is proved of a changed pair's representation: ulp_scale, display_equivalent. shown: what the cells' format shows."""
    b, c = finite(base), finite(current)
    alike = F.lit(None) if shown_base is None or shown_current is None else F.when(shown_base == shown_current, F.lit("display_equivalent"))
    tags = F.array_compact(F.array(F.when(within_ulps(b, c), F.lit("ulp_scale")), alike.cast("string")))
    return F.when(b.isNull() | c.isNull() | (b == c), F.array().cast("array<string>")).otherwise(tags)


def shown_like(figure: Column, value: Column) -> Column:
    """A value in a figure's style: its currency, grouping, decimals, suffix, and brackets for a minus. figure: of figures()."""
    raw = figure["raw"]
    scaled = F.when(figure["percent"], value * 100).otherwise(value / figure["scale"])
    size, out = F.abs(scaled), F.lit(None).cast("string")
    for d in range(9, -1, -1):
        plain = F.when(F.instr(raw, ",") > 0, F.format_number(size, d)).otherwise(F.format_string(f"%.{d}f", size))
        out = F.when(figure["decimals"] == d, plain).otherwise(out)
    out = F.concat(F.coalesce(figure["currency"], F.lit("")), out, F.regexp_extract(raw, r"(?i)(%|bn|mn|k|m|b)\s*\)?$", 1))
    return F.when(scaled < 0, F.when(F.startswith(raw, F.lit("(")), F.concat(F.lit("("), out, F.lit(")"))).otherwise(F.concat(F.lit("-"), out))).otherwise(out)
