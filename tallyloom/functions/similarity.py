"""How alike texts are: indel ratio, token sets, line differences. Arrow batches on candidate pairs only."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.numbers import NUMERIC_TOKEN

SKELETON = re.compile(NUMERIC_TOKEN)


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - d / (len a + len b)), where d counts insertions and deletions: twice a longest common subsequence is kept."""
    if not a and not b:
        return 100.0
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(b)) - 1  # bit-parallel: a zero bit ends a longer common subsequence
    for c in a:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & (1 << len(b)) - 1
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio among the common words and either side's words after them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(s - (x & y)))}".strip() for s in (x, y))
    if both and (one == both or two == both):
        return 100.0
    return max(indel_ratio(one, two), indel_ratio(both, one) if both else 0.0, indel_ratio(both, two) if both else 0.0)


def _pairs(f):
    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return ratio


def indel(a: Column, b: Column) -> Column:
    return _pairs(indel_ratio)(a, b)


def token_set(a: Column, b: Column) -> Column:
    return _pairs(token_set_ratio)(a, b)


def slide_score(title: Column, body: Column, position: Column) -> Column:
    """The weights of a slide's likeness: title, body, position, each of 100."""
    return 0.5 * title + 0.35 * body + 0.15 * position


def line_changes(base: str, current: str) -> list[dict]:
    """Changed lines in order; lines paired within a replaced block are a figure_refresh if only their figures differ."""
    a, b = (base or "").split("\n"), (current or "").split("\n")
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        for n in range(max(j - i, m - k)):
            x, y = (a[i + n] if i + n < j else None), (b[k + n] if k + n < m else None)
            same = x is not None and y is not None and SKELETON.sub("#", x) == SKELETON.sub("#", y)
            out.append({"base": x, "current": y, "kind": "figure_refresh" if same else "added" if x is None else "removed" if y is None else "replaced"})
    return out


CHANGES = "array<struct<base:string,current:string,kind:string>>"


def lines(base: Column, current: Column) -> Column:
    """line_changes() of two columns."""

    @F.arrow_udf(CHANGES)
    def diff(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([line_changes(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.struct([("base", pa.string()), ("current", pa.string()), ("kind", pa.string())])))

    return diff(base, current)
