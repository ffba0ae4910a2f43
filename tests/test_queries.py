"""Every registered query of the library against its SQL, and those without SQL against plain Python."""

import math
import re
from collections import defaultdict

import duckdb
import pytest

from tallyloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else int(v) if type(v).__name__ in ("int", "Decimal") else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.collect()
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)
    assert rows or name in ("recurring_findings", "error_populations")


def test_every_query_has_sql_or_a_test_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"slide_matching", "text_changes", "displayed_figures", "labelled_candidates"}


def test_displayed_figures(spark, con):
    pattern = re.compile(r"(?<![\w.,-])(\()?\s*([$€£₹])?\s*(-)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|bn|mn|k|m|b)?(\))?(?![\w%])", re.IGNORECASE | re.ASCII)
    want = defaultdict(lambda: [0, 0, 0, 0])
    for d, t in con.sql("select doc_id, text from documents").fetchall():
        for m in pattern.finditer(t or ""):
            w = want[d]
            w[0] += 1
            w[1] += m[5] == "%"
            w[2] += bool(m[3]) or bool(m[1] and m[6])
            w[3] = max(w[3], len(m[4].partition(".")[2]))
    got = {r.doc_id: [r.figures, r.percents, r.negatives, r.most_decimals] for r in catalogue.queries()["displayed_figures"](spark, DATA).collect()}
    assert got == dict(want)


def test_slide_matching(spark, con):
    from tallyloom.functions.similarity import indel_ratio, token_set_ratio

    decks = defaultdict(lambda: ([], []))
    for c, role, x in con.sql("select conv_id, role, coalesce(text, '') from conversations where role in ('user', 'assistant') order by conv_id, turn").fetchall():
        decks[c][role == "assistant"].append(x)
    want, firsts = set(), lambda x: x.split("\n")[0]
    for c, (a, b) in decks.items():
        size = max(len(a), len(b))
        score = lambda i, j: 0.5 * indel_ratio(firsts(a[i]), firsts(b[j])) + 0.35 * token_set_ratio(a[i], b[j]) + 0.15 * 100 * (1 - abs(i - j) / size)  # noqa: B023, E731
        left_a, left_b = set(range(len(a))), set(range(len(b)))
        for s, i, j in sorted((-score(i, j), i, j) for i in left_a for j in left_b):
            if -s >= 55 and i in left_a and j in left_b:
                left_a.remove(i)
                left_b.remove(j)
                want.add((c, i, j, round(-s, 6)))
    got = catalogue.queries()["slide_matching"](spark, DATA).collect()
    assert {(r.conv_id, r.a, r.b, round(r.score, 6)) for r in got} == want


def test_text_changes(spark, con):
    from tallyloom.functions.similarity import line_changes

    assert line_changes("a\nsales 10\nc", "a\nsales 12\nd\ne") == [
        {"base": "sales 10", "current": "sales 12", "kind": "figure_refresh"}, {"base": "c", "current": "d", "kind": "replaced"}, {"base": None, "current": "e", "kind": "added"},
    ]
    rows = catalogue.queries()["text_changes"](spark, DATA).collect()
    texts = {(c, t): x for c, t, x in con.sql("select conv_id, turn, coalesce(text, '') from conversations").fetchall()}
    want = defaultdict(int)
    turns = sorted(texts)
    for p, q in zip(turns, turns[1:], strict=False):
        if p[0] == q[0]:
            for c in line_changes(texts[p], texts[q]):
                want[(*q, c["kind"])] += 1
    assert {(r.conv_id, r.turn, r.kind): r.lines for r in rows} == dict(want)
