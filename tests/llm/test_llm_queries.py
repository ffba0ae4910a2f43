"""The queries over the smallest tables, against plain versions and SQL."""

import hashlib

import duckdb
import pytest

from tallyloom.llm import queries as Q
from tests.llm import plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by 1").fetchall()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_op1(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    assert rows(Q.op1_decontamination(spark, DATA)) == plain.leaks(docs, items)


def test_op2(spark, docs):
    got = {r.doc_id: r.kept_sha256 for r in Q.op2_line_dedup(spark, DATA).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in plain.kept_lines(docs)}


def test_op3(spark, docs):
    got = rows(Q.op3_ngram_jaccard(spark, DATA))
    assert got == plain.components(docs)
    assert any(d != c for d, _, c in got)


def test_op4_and_op5(spark, docs):
    from tokenizers import Tokenizer

    t, want, counts, at = Tokenizer.from_file(Q.tokenizer_path()), [], [], 0
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        counts.append((d, len((x or "").encode()), len(ids), len(ids) > 1024))
        ids = [*ids, Q.END_ID]
        want.append((d, at, len(ids), plain.crc(ids)))
        at += len(ids)
    assert rows(Q.op4_token_files(spark, DATA)) == want
    assert rows(Q.op5_token_counts(spark, DATA)) == counts


def test_op6(spark):
    got = {r.doc_id: r for r in Q.op6_quality_rules(spark, DATA.replace("0.001", "0.01")).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{DATA.replace('0.001', '0.01')}/labels.parquet'").fetchall()
    unseen = [(got[d].predicted, q) for d, q in labels if got[d].held_out]
    assert len(unseen) > 50 and sum(a == b for a, b in unseen) / len(unseen) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_op7(spark):
    got = Q.op7_mixing(spark, DATA).collect()
    again = rows(Q.op7_mixing(spark, DATA))
    assert rows(Q.op7_mixing(spark, DATA)) == again
    source = dict(duckdb.sql(f"select doc_id, source from '{DATA}/documents.parquet'").fetchall())
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0
        by.setdefault(source[r.doc_id], []).append(r)
    names = sorted(by)
    unit, over = None, set()
    while True:  # the same shares, by another order of steps
        free = [n for n in names if n not in over]
        unit = (total - sum(3 * by[n][0].source_size for n in over)) / sum((5, 2, 1)[names.index(n) % 3] for n in free)
        new = {n for n in free if (5, 2, 1)[names.index(n) % 3] * unit > 3 * by[n][0].source_size}
        if not new:
            break
        over |= new
    for n in names:
        want = 3 * by[n][0].source_size if n in over else (5, 2, 1)[names.index(n) % 3] * unit
        assert by[n][0].target == pytest.approx(want)
        assert by[n][0].source_size == sum(r["size"] for r in by[n])
        assert abs(sum(r.taken for r in by[n]) - want) <= max(r["size"] for r in by[n]) / 2 + 1


@pytest.mark.parametrize("name", ["op8_warc", "op10_url_filters"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    got = Q.queries()[name](spark, DATA)
    want = con.sql(Q.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op9(spark, docs):
    got = {r.doc_id: r for r in Q.op9_fingerprints(spark, DATA).collect()}
    down = sorted(docs, key=lambda d: -d[0])
    for (d, t), (e, u) in zip(down, [*down[1:], down[0]], strict=True):
        n = len(t) // 3
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest())
        assert (r.near_next == 1 if t == u else True) and 0 <= r.near_edited <= 1
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(0.5 < r.near_edited < 0.85 for r in long) / len(long) > 0.9
    assert sum(r.near_next < 0.2 for r in long) / len(long) > 0.9


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = Q.table(spark, DATA, "documents")
    assert len(P.STAGES) in (4, 5)
    read = docs
    for _, stage in P.STAGES[:-1]:
        before, read = read, P.kept(stage(spark, read, DATA), "t")
        assert read.columns == docs.columns and read.count() > 0
        assert not set(r.doc_id for r in read.select("doc_id").collect()) - set(r.doc_id for r in before.select("doc_id").collect())
    got = P.run(spark, DATA)
    assert got.count() == read.count()
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    left = {r.doc_id: r.text for r in read.collect()}
    assert not any(x[5] for x in plain.leaks(left.items(), items))
    assert all(d == c for d, _, c in plain.components(left.items()))
