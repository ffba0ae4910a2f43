"""Steps whose tasks must not grow faster than their input."""

from pyspark.sql import functions as F
from volumes import shuffled_rows

from tallyloom.functions import formulas
from tallyloom.operators import celldiff, diff, graph, parts, stored


def test_few_rectangles_leave_points(spark, monkeypatch):
    """Few rectangles are sent to the points, many meet them by blocks: the same pairs, in the first case without shuffling a point."""
    points = spark.range(4000).select(F.lit(0).alias("sheet"), F.col("id").alias("row"), (F.col("id") % 5).alias("col"))
    boxes = spark.createDataFrame([(0, 0, 1 << 36, 0, 3, "open")] + [(0, i * 10, i * 10 + 4, 2, 2, f"b{i}") for i in range(60)], "sheet int, min_row long, max_row long, min_col long, max_col long, name string")
    want = {(i, "open") for i in range(4000) if i % 5 <= 3} | {(i, f"b{i // 10}") for i in range(600) if i % 5 == 2 and i % 10 <= 4}
    with shuffled_rows(spark) as told:
        got = [(x.row, x.name) for x in graph.contained(points, boxes).collect()]
    assert len(got) == len(want) and set(got) == want and told[0] < 1000
    for most in (0, 1):
        monkeypatch.setattr(graph, "MOST_SENT", most)
        got = [(x.row, x.name) for x in graph.contained(points, boxes).collect()]
        assert len(got) == len(want) and set(got) == want
    assert graph.contained(points, boxes.limit(0)).count() == 0


def test_chart_references_one_count(spark):
    """Lengths are told by least and greatest: each series' references are shuffled once, null cells count as none."""
    rows = [("c", 1, "values", "s", 3), ("c", 1, "categories", "s", 3), ("c", 2, "values", "s", 3), ("c", 2, "categories", "s", 4), ("c", 3, "values", "x", 3), ("c", 4, "values", "s", None)]
    refs = spark.createDataFrame(rows, "chart string, series int, role string, sheet string, cells int")
    out = parts.chart_references(refs, spark.createDataFrame([("s",)], "sheet string"))
    assert {tuple(x) for x in out.collect()} == {("c", 1, "valid"), ("c", 2, "mismatch"), ("c", 3, "invalid"), ("c", 4, "invalid")}
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_accepted_shuffles_what_is_taken(spark):
    """Of the changes that no band takes none is shuffled to find that out; equal changes, and such in two bands, stay as many as they are."""
    n = 6000
    d = stored.stored(spark.range(n).select((F.col("id") % (n // 2)).alias("key"), F.lit(3).alias("col"), F.lit(100.0).alias("base"), F.when(F.col("id") % 100 == 0, 101.0).otherwise(200.0).alias("current")))
    bands = spark.createDataFrame([(None, None, 1, 5, 5.0, 0.0), (0, 10**6, 3, 3, 0.0, 0.25)], "min_row long, max_row long, min_col long, max_col long, absolute double, relative double")
    with shuffled_rows(spark) as told:
        got = diff.accepted(d, bands, "key", "col", "base", "current").select("key", "accepted").collect()
    assert len(got) == n and sum(x.accepted for x in got) == n // 100 and all(x.accepted == (x.key % 100 == 0) for x in got)
    assert told[0] < n + 1000


def test_affected_shuffles_found_pairs_once(spark, monkeypatch):
    """Chains with shortcuts and a cycle against a plain search, also when rounds are merged; dependents are shown by one shuffle of them."""
    edges = [(i, i + 1) for i in range(20) if i != 9] + [(i, i + 2) for i in range(0, 18, 3)] + [(30, 31), (31, 30)]
    want = set()
    for s in {a for a, _ in edges}:
        todo = [s]
        while todo:
            x = todo.pop()
            for b in (b for a, b in edges if a == x and (s, b) not in want):
                want.add((s, b))
                todo.append(b)
    e, c = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(a,) for a, _ in edges], "id long")
    monkeypatch.setattr(graph, "MOST_PARTS", 3)
    got = [tuple(x) for x in graph.affected(c, e).collect()]
    assert len(got) == len(want) and set(got) == want
    n = 9000
    reached = stored.stored(spark.range(n).select((F.col("id") % 100).alias("start"), F.col("id").alias("reached")))
    with shuffled_rows(spark) as told:
        out = graph.impacts(reached, 3).collect()
    assert {(x.start, tuple(x.impacts), x.more) for x in out} == {(s, (s, s + 100, s + 200), 87) for s in range(100)}
    assert told[0] <= n


def test_formulas_compared_in_place(spark):
    """Copies of one formula are compared once a batch and without a shuffle, each with its own texts; others aren't taken for copies."""
    pairs = [
        ("=SUM(A{r}:A{s})", "=SUM(A{r}:A{t})"), ("=A{r}", "=A{r}+b{t}+$B$2+B{t}"), ("=A{r}", "=IFERROR('x1'!A{r},0)"), ("=A{r}", "=IFERROR(A{r},0)"), ("=A$7*A{r}", "=A$8*A{r}"),
        ('="A{r}"', '="A{s}"'), ("=#DIV/0!+A{r}", "=#DIV/1!+A{r}"), ("=A{r}", None), (None, "=A{r}"), ("=A0{r}", "=A{r}+C0{r}"), ("=A1234567{r}", "=A{r}"), ("=é1+A{r}", "=é2+A{r}"),
    ]
    rows = []
    for r in (1, 8, 9, 10, 99, 100):
        for i, pair in enumerate(pairs):
            b, c = (x and x.format(r=r, s=r + 1, t=r + 2) for x in pair)
            rows.append((i, r, b, c))
    d = stored.stored(spark.createDataFrame(rows, "i int, row long, b string, c string").withColumn("col", F.lit(3)))
    with shuffled_rows(spark) as told:
        got = formulas.with_comparison(d, "b", "c", ("row", "col"), ("row", "col"), "x").collect()
    assert told[0] == 0 and len(got) == len(rows)
    for x in got:
        if x.b is None or x.c is None:
            assert x.x is None
            continue
        own, texts = formulas.compared(x.b, x.c, (x.row, 3), (x.row, 3)), [t for k, t in formulas.tokens(x.c) if k == "ref"]
        assert x.x.asDict() == {"base": formulas.relative(x.b, x.row, 3), "current": formulas.relative(x.c, x.row, 3), "extended": own["extended"], "wrapper": own["wrapper"], "added": sorted({texts[i] for i in own["new"]})}
        assert x.i != 0 or x.x.extended
        assert x.i != 1 or x.x.added == sorted(["$B$2", f"B{x.row + 2}", f"b{x.row + 2}"])
        assert x.i not in (2, 3) or x.x.wrapper == ("IFERROR" if x.i == 3 else None)
    cells = d.select(F.lit("s").alias("id"), F.lit("s").alias("sheet"), F.col("row").alias("base_row"), F.col("i").alias("base_col"), "row", F.col("i").alias("col"), F.struct(F.lit("1").alias("value"), F.col("b").alias("formula")).alias("b"), F.when(F.col("row") < 100, F.struct(F.lit("1").alias("value"), F.col("c").alias("formula"))).alias("c"))
    with shuffled_rows(spark) as told:
        found = {(x.row, x.col): x.finding_class for x in celldiff.formula_findings(cells).collect()}
    want = {(r, i): "formula_removed" if r == 100 else "formula_hardcoded" if c is None else "formula_logic_changed" for i, r, b, c in rows if b and (r == 100 or c is None or formulas.relative(b, r, i) != formulas.relative(c, r, i))}
    assert found == want and told[0] == 0
