"""Keys found level by level, against counting every combination."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from volumes import shuffled_rows

from tallyloom.operators import keys, stored


def part(v):
    t = "" if v is None else str(v).strip().lower()
    return t or None


def plain(base, current, names, size=3):
    out = {}
    for k in range(1, size + 1):
        for c in combinations(range(len(names)), k):
            if any(set(x) < set(c) for x in out):
                continue
            stats = []
            for rows in (base, current):
                ks = [tuple(part(r[i]) for i in c) for r in rows]
                n = Counter(x for x in ks if None not in x)
                stats.append((sum(n.values()) / len(rows), sum(1 for v in n.values() if v == 1) / max(sum(n.values()), 1), {x: ks.index(x) for x, v in n.items() if v == 1}))
            (ca, ua, a), (cb, ub, b) = stats
            if min(ca, cb) >= 0.95 and min(ua, ub) >= 0.995:
                both = a.keys() & b.keys()
                out[c] = ("+".join(names[i] for i in c), min(ca, cb), min(ua, ub), len(both) / len(a.keys() | b.keys()), sum(a[x] != b[x] for x in both) / max(len(both), 1))
    return sorted(out.values())


@pytest.mark.parametrize("seed", range(2))
def test_discovered(spark, seed):
    r = random.Random(seed)
    names = list("abcdef")
    row = lambda i: (f"k{i // 2}", i % 2, r.choice([None, " ", "x"]), f" S{i} ", r.randrange(3), "same")
    base = [row(i) for i in range(400)]
    current = base[:]
    r.shuffle(current)
    current = [(*x[:3], x[3].upper(), *x[4:]) for x in current[:390]]
    df = lambda rows: spark.createDataFrame([(i, *map(str, x[:2]), x[2], x[3], x[4], x[5]) for i, x in enumerate(rows)], "row long, a string, b string, c string, d string, e int, f string")
    got = keys.discovered(df(base), df(current), names, "row").collect()
    want = plain(base, current, names)
    for x, w in zip(sorted(got, key=lambda x: x.key), want, strict=True):
        assert x.key == w[0] and (x.coverage, x.uniqueness, x.overlap, x.displaced) == pytest.approx(w[1:])
    assert {w[0] for w in want} == {"d", "a+b"}
    by = {x.key: x for x in got}
    assert by["d"].reduction > 0.5 and not by["d"].suggested  # too few rows to be worth it


def test_none_and_empty(spark):
    d = spark.createDataFrame([(0, "x"), (1, "x"), (2, None)], "row long, a string")
    assert keys.discovered(d, d, ["a"], "row").count() == 0
    assert keys.discovered(d.limit(0), d, ["a"], "row").count() == 0


def test_combined_counts_values_not_texts(spark):
    """Nulls and blanks aren't whole, -0 is 0, and rows aren't turned into texts before they are shuffled."""
    d = spark.createDataFrame([("x", 1, 0.0), ("x", 1, -0.0), (" ", 2, 1.5), (None, 2, 1.5), ("y", 1, None)], "a string, b long, c double")
    out = keys.combined(d, ["a", "b", "c"])
    assert {tuple(r)[:4] for r in out.collect()} == {("a", 5, 3, 2), ("b", 5, 5, 2), ("c", 5, 4, 2), ("a+b", 5, 3, 2), ("a+c", 5, 2, 1), ("b+c", 5, 4, 2), ("a+b+c", 5, 2, 1)}
    assert "to_json" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_measures_shuffle_each_key_once(spark):
    """Both sides' keys meet in one shuffle, and only rows of sampled keys are looked up: rows aren't shuffled with their columns."""
    n = 20_000
    d = stored.stored(spark.range(n).selectExpr("id as row", "cast(id as string) as a", "cast(id % 7 as string) as b"))
    with shuffled_rows(spark) as told:
        got = keys.discovered(d, d.withColumn("row", n - 1 - d["row"]), ["a", "b"], "row").collect()
    assert [(x.key, x.coverage, x.uniqueness, x.overlap, x.displaced) for x in got] == [("a", 1.0, 1.0, 1.0, 1.0)]
    assert told[0] < 3 * n


def test_placed(spark):
    """Places of whole rows, null last, over several parts."""
    d = spark.range(5000).selectExpr("id", "case when id % 1000 > 0 then (id * 37) % 1009 end as v")
    order = (F.col("v").asc_nulls_last(), F.col("id").asc())
    want = sorted(((r.v is None, r.v or 0, r.id) for r in d.collect()))
    got = stored.placed(d, "n", *order)
    assert got.columns == ["id", "v", "n"] and [(r.v is None, r.v or 0, r.id) for r in got.orderBy("n").collect()] == want
    assert [r.n for r in got.select("n").orderBy("n").collect()] == list(range(5000))
