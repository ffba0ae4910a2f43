"""Pairs taken best first, against taking them one by one."""

import random

import pytest

from tallyloom.operators import align, decks


def one_by_one(rows, least):
    seen_a, seen_b, out = set(), set(), set()
    for g, a, b, s in sorted({r for r in rows if None not in r}, key=lambda r: (-r[3], r[1], r[2])):
        if s >= least and (g, a) not in seen_a and (g, b) not in seen_b:
            seen_a.add((g, a))
            seen_b.add((g, b))
            out.add((g, a, b, s))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_with_ties(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("pq"), r.randrange(12), r.randrange(12), r.choice([0.1, 0.3, 0.3, 0.5, 0.5, 0.9])) for _ in range(150)]
    rows = list({x[:3]: x for x in rows}.values()) + [(None, 1, 1, 0.9), ("p", None, 1, 0.9), ("p", 1, None, 0.9), ("p", 1, 1, None)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "g string, a long, b long, s double")
    assert {tuple(x) for x in align.greedy(df, "g", "a", "b", "s", 0.2).collect()} == one_by_one(rows, 0.2)
    assert align.greedy(df.limit(0), "g", "a", "b", "s", 0.2).count() == 0


def test_greedy_takes_a_chain_of_ever_weaker_pairs(spark):
    rows = [("g", i, i, 1 - i / 100) for i in range(12)] + [("g", i, i + 1, 1 - (i + 0.5) / 100) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, a long, b long, s double")
    assert {(x.a, x.b) for x in align.greedy(df, "g", "a", "b", "s", 0.0).collect()} == {(i, i) for i in range(12)}


def test_pinned_slides(spark):
    slides = lambda titles: spark.createDataFrame([("d", i, t, f"{t} body of the slide") for i, t in enumerate(titles)], "deck string, index long, title string, body string")
    base, current = slides(["Sales", "Costs", "Costs", "Outlook"]), slides(["Costs", "Umsatz", "Outlook", "Zzz"])
    pins = spark.createDataFrame([("d", "Sales", "Umsatz"), ("d", "Costs", "absent"), ("e", "Outlook", "Zzz")], "deck string, base string, current string")
    got = {(r.a, r.b, r.score is None) for r in decks.matched_slides(base, current, "deck", pins).collect()}
    assert got == {(0, 1, True), (1, 0, False), (3, 2, False)}
    assert {(r.a, r.b) for r in decks.matched_slides(base, current, "deck").collect()} >= {(1, 0), (3, 2)}


def best_in_rounds(rows):
    out = []
    while True:
        top = lambda i, x: [r for r in rows if r[i] == x and r[2] == max(q[2] for q in rows if q[i] == x)]
        hit = [r for r in rows if len(top(0, r[0])) == len(top(1, r[1])) == 1 and top(0, r[0])[0] == top(1, r[1])[0] == r]
        if not hit:
            return sorted(out)
        out += hit
        rows = [r for r in rows if r[0] not in {h[0] for h in hit} and r[1] not in {h[1] for h in hit}]


def test_mutual_best_over_many_rounds(spark):
    """Ties, equal rows and chains; pairs are grouped before a shuffle, none is shuffled whole after the first."""
    r = random.Random(3)
    rows = [(r.randrange(9), r.randrange(9), r.randrange(12)) for _ in range(40)]
    rows = list({x[:2]: x for x in rows}.values()) + [(i, i, 200 - 2 * i) for i in range(20, 30)] + [(i, i + 1, 199 - 2 * i) for i in range(20, 30)] + [(50, 50, 3)] * 2
    df = spark.createDataFrame(rows, "a long, b long, s long")
    got = align.mutual_best(df, "a", "b", "s")
    assert sorted(map(tuple, got.collect())) == best_in_rounds(rows) and got.columns == ["a", "b", "s"]
    assert align.mutual_best(df.limit(0), "a", "b", "s").count() == 0
    assert "Scan ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()  # files, not rows of a checkpoint
