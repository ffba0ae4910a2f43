"""Main text of pages: the messages against all assignments, the tree against cases of the standard, the text against the pages' own template."""

import html
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import html_text as H
from tallyloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"select page_id, url, html from '{DATA}/pages.parquet' order by 1").fetchall()


def article(source):
    """The text of the tables' own pages, by their template."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside))).split())


def test_messages_give_the_marginals_of_all_assignments():
    r = np.random.default_rng(1)
    page = H.parsed("<div class=post><h1>A b</h1><p>One two. <a href=x>three</a></p></div><ul><li>x<li>y</ul>")
    f = H.Forest([page, H.parsed("<p>z")])
    weights, coupling = r.normal(size=H.FEATURES), r.normal(size=(len(H.KINDS), 2, 2))
    p, pairs = f.marginals(weights, coupling)
    n = len(f.parent)
    own = np.bincount(f.node, weights=weights[f.ids], minlength=n)
    total, want, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        y = np.array(y)
        e = np.exp((own * y).sum() + sum(coupling[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += e
        want += e * y
        for i in range(n):
            if f.parent[i] >= 0:
                both[i, y[f.parent[i]], y[i]] += e
    assert n > 10 and np.allclose(p, want / total) and np.allclose(pairs, both / total)


def texts(source):
    p = H.parsed(source)
    return [(p.tag[p.parent[i]], t) for i, t in enumerate(p.text) if t]


@pytest.mark.parametrize(("source", "want"), [
    (None, []), ("", []), ("   \n", []), ("plain", [("body", "plain")]), ("a < b &lt;c&gt; &amp;amp; &#233;&nbsp;x", [("body", "a < b <c> &amp; é x")]),
    ("<p>a<p>b<div>c</div>d", [("p", "a"), ("p", "b"), ("div", "c"), ("body", "d")]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("li", "a"), ("li", "b"), ("li", "c")]),
    ("<p>a <b>b<p>c</b> d<br>e", [("p", "a b"), ("p", "c d e")]), ("<table><tr><td>1<td>2<tr><th>3</table>x", [("td", "1"), ("td", "2"), ("th", "3"), ("body", "x")]),
    ("<script>if (a</b) '<p>no'</script ><STYLE>p</STYLE>t<textarea><p>f</textarea>", [("body", "t")]), ("<title>no<b></title><p>yes", [("p", "yes")]), ("<head><title>no</title></head><body>yes</body></html> more", [("body", "yes more")]),
    ("<!-- <p>no --><p title='>' class=\"a>b\">yes<!-- cut", [("p", "yes")]), ("<p>a</div></section>b</p>c", [("p", "ab"), ("body", "c")]), ("<p>cut<a href='x", [("p", "cut")]), ("<script>never closed <p>x", []), ("<svg><text>no</text></svg><select><option>no</select>yes", [("body", "yes")]),
    ("<h1>a<h2>b</h1>c", [("h1", "a"), ("h2", "b"), ("body", "c")]), ("<![CDATA[no]]><?php no ?></ no><p/>yes", [("p", "yes")]),
])
def test_trees(source, want):
    assert texts(source) == want


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<p>" + "word &amp; " * 100_000 + "<a b='" * 1000
    assert texts(deep) == [("div", "x")] and len(texts(long)[0][1]) > 600_000
    assert H.fitted([]).shown([H.parsed(deep), H.parsed(long)])[0] == "x"


def test_op13(spark, pages):
    got = {r.page_id: r for r in Q.op13_html_text(spark, DATA).collect()}
    assert len(got) == len(pages)
    for i, url, source in pages:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, article(source), len(article(source)))


def test_layouts_that_were_not_seen(spark, pages):
    """Fitted on some pages' layouts, tried on others' with other seeds."""
    fit, rest = pages[: len(pages) // 2], pages[len(pages) // 2 :]
    model = H.fit(H.labelled(spark.createDataFrame(fit, "page_id long, url string, html string")))
    right = wrong = 0
    for _, _, source in rest * 4:
        page = H.parsed(H.laid_out(*H.blocks(H.parsed(source)), zlib.crc32(source.encode()) + 7777 + right))
        p = H.Forest([page]).marginals(model.weights, model.coupling)[0]
        runs = [(x == "1") == (q >= 0.5) for x, q, t in zip(page.label, p, page.text, strict=True) if t]
        right += int(sum(runs))
        wrong += len(runs) - int(sum(runs))
    assert right > 500 and wrong < 0.02 * right


def test_rows_of_all_kinds(spark, pages):
    rows = [*pages, pages[0], (None, None, None), (-1, "", ""), (-2, None, "<p>"), (-3, "u", "<nav><ul><li><a href=x>menu</a></ul></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("n_chars", "_h", "label"):
        df = df.withColumn(c, F.lit("kept"))
    got = H.report(df.repartition(3)).collect()
    assert len(got) == len(rows) and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id is None or r.page_id < 0)
    assert sum(r.page_id == pages[0][0] for r in got) == 2
    assert H.report(df.limit(0)).count() == 0
    alone = H.report(spark.createDataFrame([(1, "u", "<div>kept<script>no</script></div>")], "page_id long, url string, html string")).first()
    assert alone.text == "kept"  # no labelled page
    with pytest.raises(ValueError, match="already"):
        H.with_text(df.withColumn("Text", F.lit(1)), H.fitted([]))
    assert H.with_text(df, H.fitted([]), "main").columns == [*df.columns, "main"]
