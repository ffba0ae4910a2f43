"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, fingerprints, jaccard, line_dedup, mixing, quality_rules, token_counts, token_files, url_filters, warc
from tallyloom.llm import queries as Q
from tallyloom.llm.shared import hashed, shards_of
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, SENTENCE, "en", "a", 5), (1, SENTENCE, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "   \n\t ", "en", "b", 0), (None, SENTENCE, "en", "a", 1), (None, None, None, None, None),
    (5, LONG, "en", "c", 1), (6, LONG + " x", "en", "c", 1), (7, "a" * 200_000, None, "c", 1), (8, "Short", "en", None, 1), (9, SENTENCE.upper() + " é", "fr", "b", 3), (-(2**63), "lowest id", "en", "a", 1), (2**63 - 1, "highest <|endoftext|> id", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    for c in ("_scan", "_SCAN_", "_own", "_key", "_size_of", "_copy", "_place", "_stay", "gone", "shard", "key", "id", "class", "size", "copies", "component_id", "label", "y"):
        docs = docs.withColumn(c, F.lit("kept"))
    return docs


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def sorted_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


ITEMS = [(1, "Six SEVEN eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, None), (3, "..."), (None, SENTENCE), (4, "short"), (5, "absent words here"), (5, "short")]


def test_decontamination(spark, docs, empty):
    want = sorted(map(repr, plain.leaks([(r[0], r[1]) for r in ROWS], ITEMS)))
    assert sorted_rows(decontamination.report(docs, bench(spark, ITEMS))) == want
    assert sorted_rows(decontamination.report(docs, bench(spark, ITEMS), block_bytes=1000)) == want  # many blocks
    assert decontamination.report(empty, bench(spark, ITEMS)).count() == 0
    assert {r.n_hit for r in decontamination.report(docs, bench(spark, [])).collect()} == {0}


def test_decontamination_removes(spark, clashing):
    named = [i for i in ITEMS if i[0] is not None]
    left = decontamination.without_documents(clashing, bench(spark, named))
    assert left.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (1, 8, 9) and r[1] != SENTENCE)
    cut = {r.doc_id: r.text for r in decontamination.without_spans(clashing, bench(spark, named)).collect()}
    assert cut[1] == "one two three four five  seventeen eighteen nineteen twenty" and cut[8] == "" and cut[5] == LONG and cut[2] is None
    nameless = decontamination.without_documents(clashing, bench(spark, ITEMS))
    assert {r.text for r in nameless.collect()}.isdisjoint({SENTENCE, "Short"})


def test_line_dedup(spark, empty):
    a = "\n".join(f"line {i} " + "word " * 9 for i in range(12))
    rows = [(1, "head\n" + a + "\ntail"), (2, a), (3, "x\n" + a[: len(a) // 2]), (4, None), (5, ""), (6, "\n\n\n"), (None, a), (7, "short\nshort\nshort"), (8, ("repeat " * 60 + "\n") * 3), (9, "few words\n" * 40), (2, a), (10, "\n".join(["ten words of one line that comes again and again"] * 12)), (11, "\n".join(["ten words of one line that comes again and again"] * 7))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).repartition(3)
    order = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = dict(plain.kept_lines(order))
    got = line_dedup.without_repeats(d)
    assert got.columns == d.columns
    for r in got.collect():
        assert r.text == (None if r.doc_id == 4 else want[r.doc_id]), r
    kept = {r.doc_id: r.n_kept for r in line_dedup.report(d).collect()}
    assert (kept[10], kept[11]) == (5, 0)
    assert line_dedup.report(empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {(1, 16, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 16, 1), (None, 0, None), (5, 59_996, 5), (6, 59_997, 5), (7, 1, 7), (8, 1, 8), (9, 17, 1), (-(2**63), 1, -(2**63)), (2**63 - 1, 1, 2**63 - 1)}
    assert jaccard.near_duplicates(empty).count() == 0


def test_near_duplicates_stay(clashing):
    left = jaccard.without_near_duplicates(clashing)
    assert left.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, None, None, 5, 7, 8, -(2**63), 2**63 - 1]))


def test_near_duplicate_chains(spark):
    """Chains whose ends aren't alike, edits at every place, and a group that shares frequent shingles."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(80)]
    rows, n = [], 0
    for k in range(60):
        words = list(base)
        for j in range(k // 3):
            words[(j * 7) % 80] = f"edit{j}"
        rows.append((n := n + 1, " ".join(words)))
    for _ in range(80):
        words = [*base[:20], *(f"r{rng.integers(400)}" for _ in range(int(rng.integers(5, 60))))]
        rows.append((n := n + 1, " ".join(words)))
        if rng.random() < 0.5:
            words[int(rng.integers(len(words)))] = "changed"
            rows.append((n := n + 1, " ".join(words)))
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == plain.components(rows)


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(Q.tokenizer_path()), 0, []
    for d, x, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), plain.crc(ids)))
        at += len(ids)
    for size in (1 << 24, 50_000):
        folder = token_files.write_token_files(docs, Q.tokenizer_path(), end_id=2, shard_bytes=size)
        assert sorted(map(repr, (tuple(r) for r in token_files.read_token_files(spark, folder).collect()))) == sorted(map(repr, want))
    some = {r.doc_id: r.ids for r in token_files.read_token_files(spark, folder, ids=True).collect()}
    assert some[8] == [*t.encode("Short").ids, 2]
    folder = token_files.write_token_files(empty, Q.tokenizer_path())
    assert token_files.read_token_files(spark, folder).count() == 0


def test_range_coder():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0), np.array([65535]), np.array([2**32 - 1, 7, 7, 200_000]), np.arange(300_000)[::-1], rng.integers(0, 65536, 9000), np.full(9000, 7), np.arange(20_000) % 300, rng.zipf(1.3, 30_000) % 50_000):
        data = token_files.packed_shard([1, None], [len(ids), 0], ids.astype(np.uint32))
        keys, lengths, back = token_files.read_shard(data)
        assert keys == [1, None] and lengths.tolist() == [len(ids), 0] and (back == ids).all()
    broken = bytearray(data)
    broken[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.read_shard(bytes(broken))


def test_encoder_keeps_what_comes_again(monkeypatch):
    """When the encoder knows too many words it forgets those that came once: the others aren't asked again, and all ids are the library's."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(Q.tokenizer_path()), token_files.Encoder(Q.tokenizer_path())
    monkeypatch.setattr(token_files.Encoder, "MOST", 2000)
    asked, ask = [], e.asked
    monkeypatch.setattr(e, "asked", lambda new: asked.append(new) or ask(new))
    common = "".join(f" word{chr(97 + i % 26) * (i // 26 + 1)}" for i in range(200)) + " a\0b ñandú 字\0 x"
    for i in range(12):
        rare = "".join(f" {chr(97 + j % 26)}{chr(97 + j // 26)}q{chr(97 + i)}" + "z" * (j % 9) for j in range(500))
        for text in (common, rare):
            ids, sizes = e.encode([text, "", text[:-1]])
            want = [t.encode(x, add_special_tokens=False).ids for x in (text, "", text[:-1])]
            assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert sum(w == b" wordccc" for new in asked for w in new) == 1 and len(e.known) <= 2000 + 1000


def test_short_words_table():
    rng = np.random.default_rng(4)
    keys, table = np.unique(rng.integers(1, 1 << 62, 50_000).astype(np.uint64)), token_files.Short(4)
    rng.shuffle(keys)
    for i in range(0, 40_000, 777):
        part = keys[i : min(i + 777, 40_000)]
        table.add(part, np.arange(i, i + len(part)))
    assert (table.find(keys) == np.where(np.arange(len(keys)) < 40_000, np.arange(len(keys)), -1)).all()
    assert 2 * table.used <= len(table.keys) and len(token_files.Short().find(keys[:0])) == 0


def test_middle_words_table():
    """Keys of two columns, either of which may be equal in different words, or 0 in the second."""
    rng = np.random.default_rng(6)
    both = np.unique(rng.integers(0, 200, (30_000, 2)), axis=0).astype(np.uint64)
    rng.shuffle(both)
    keys, more, table, known = both[:, 0] + np.uint64(1), both[:, 1], token_files.Short(4, more=True), len(both) * 3 // 4
    for i in range(0, known, 777):
        part = slice(i, min(i + 777, known))
        table.add(keys[part], np.arange(len(both))[part], more[part])
    numbers = np.arange(len(both))
    assert (table.find(keys, more) == np.where(numbers < known, numbers, -1)).all() and 2 * table.used <= len(table.keys)
    some_keys, some, some_more = table.those(numbers % 3 == 0)
    assert sorted(some.tolist()) == [n for n in range(known) if n % 3 == 0] and (keys[some] == some_keys).all() and (more[some] == some_more).all()


def test_encoder_of_words_of_each_length():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(Q.tokenizer_path()), token_files.Encoder(Q.tokenizer_path())
    texts = [x * n + y for x in ("a", "\0", "é", "字", "-", " ") for n in range(1, 20) for y in ("", "b", "\0", "\0\0")]
    for _ in range(3):
        ids, sizes = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        e.thin()


def test_encoder_knows_the_words_of_a_shard():
    """16 MB of text have some 300 000 different words, of which half come again in the next: none is asked for twice."""
    e, asked = token_files.Encoder(Q.tokenizer_path()), []
    ask = e.asked
    e.asked = lambda new: asked.extend(new) or ask(new)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(f" {letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17576]}qxzv" for i in range(j, j + 16_000)) for j in range(0, 320_000, 16_000)]
    first = [e.encode([x])[0].tolist() for x in texts]
    assert len(asked) == 320_000
    assert [e.encode([x])[0].tolist() for x in texts] == first and len(asked) == 320_000


def test_token_files_bytes():
    """Files of before are read, and the same ids give the same bytes."""
    import zlib

    ids = (np.random.default_rng(8).zipf(1.3, 30_000) % 50_000).astype(np.uint32)
    ids[10_000:14_000] = ids[:4_000]
    data = token_files.packed_shard([1], np.array([len(ids)]), ids)
    assert (len(data), zlib.crc32(data)) == (32875, 1449067526)
    assert (token_files.read_shard(data)[2] == ids).all()


def test_encoder_of_any_text():
    import random

    from tokenizers import Tokenizer

    rng, t, e = random.Random(5), Tokenizer.from_file(Q.tokenizer_path()), token_files.encoder(Q.tokenizer_path())
    parts = ["'", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "a", "the", "é", "ß", "日本", "1", "23", "½", "!", "...", "<|endoftext|>", "\u3000", "\x00", "\x85", "I", "'S", "_", "😀", "\u0301", "\r\n", "x" * 150]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    for _ in range(2):
        ids, sizes = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode([])[0].tolist() == []


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    want = sorted(repr((r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 1024)) for r in ROWS)
    assert sorted_rows(token_counts.report(docs, Q.tokenizer_path())) == want
    assert token_counts.report(empty, Q.tokenizer_path()).count() == 0


def test_token_counts_of_any_text():
    import random

    from tokenizers import Tokenizer

    rng, t, c = random.Random(3), Tokenizer.from_file(Q.tokenizer_path()), token_counts.counter(Q.tokenizer_path())
    parts = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "the", "é", "ß", "日本", "1", "23", "½", "!", "...", "<|endoftext|>", "\u3000", "\x00", "\x85", "I", "'S", "_", "😀", "\u0301", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert c.count(texts).tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_quality(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 9)], "doc_id long, quality int"))
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit(SENTENCE)).otherwise(F.lit("BAD!! $$$ WORDS!!")).alias("text"))
    got = {r.doc_id: r for r in quality_rules.report(many, labels).collect()}
    assert all(r.predicted == d % 2 for d, r in got.items()) and any(r.held_out for r in got.values())
    assert {0.0 <= r.score <= 1.0 for r in quality_rules.report(docs, labels).collect()} == {True}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_rules.report(docs, none).collect()} == {0.5}
    assert quality_rules.report(empty, labels).count() == 0
    assert quality_rules.accepted(clashing, labels).columns == clashing.columns


def test_quality_scores_are_those_of_the_rules(spark):
    """Scores against a plain version of statistics and rules, long and odd texts among them."""
    texts = [None, "", " \n\t ", LONG, "a" * 200_000, SENTENCE, "BAD!! $$$ 123, ok.", "é É 日本 's\nline two", "one\n\n\n", "x\x0by\x85z"]
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.concat(F.lit(SENTENCE), F.repeat(F.lit(" word"), F.col("id").cast("int")))).otherwise(F.concat(F.lit("BAD!! $$$ WORDS!!"), F.repeat(F.lit("! 1"), F.col("id").cast("int")))).alias("text"))
    model = quality_rules.fit(many, many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert model.rules
    got = quality_rules.scored(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model, "score").orderBy("i").collect()
    assert [r.score for r in got] == pytest.approx([plain.rule_score(model, t) for t in texts], abs=1e-12)


def test_tilt(spark):
    """Multipliers and tilt against the conditions that only the minimum meets: sources' targets and the moment, with rates cut off."""
    rng = np.random.default_rng(6)
    sizes = [(s, int(n), int(n) * int(rng.integers(1, 50))) for s in ("a", "b", None) for n in rng.choice(np.arange(1, 3000), 40, replace=False)]
    of = {s: sum(w for k, _, w in sizes if k == s) for s in ("a", "b", None)}
    targets = {"a": 0.4 * of["a"], "b": 1.7 * of["b"], None: 3.0 * of[None]}
    table = spark.createDataFrame(sizes, "source string, size long, words long")
    sources = spark.createDataFrame([(s, of[s], float(targets[s]), 1) for s in of], "s string, source_size long, target double, groups int")
    found, tilt, mean = mixing.tilted(table, sources, 3, 3.0)
    lam = {r.s: r.multiplier for r in found.collect()}
    assert lam[None] is None and abs(tilt) > 1e-4
    total = sum(of.values())
    assert mean == pytest.approx(sum(w * np.log(n) for _, n, w in sizes) / total, rel=1e-9)
    rate = {(s, n): 3.0 if s is None else min(3.0, np.exp(lam[s] + tilt * (np.log(n) - mean))) for s, n, _ in sizes}
    for s in ("a", "b"):
        assert sum(w * rate[k, n] for k, n, w in sizes if k == s) == pytest.approx(targets[s], rel=1e-6)
    assert abs(sum(w * rate[k, n] * (np.log(n) - mean) for k, n, w in sizes)) < 1e-5 * total
    assert mixing.tilted(table.limit(0), sources, 3, 3.0)[1] == 0.0


def test_fingerprint_byte_by_byte():
    rng = np.random.default_rng(7)
    for t in ("", "a", "short text", SENTENCE, "a" * 1000, " ".join(f"w{rng.integers(50)}" for _ in range(600)), "é日本" * 150):
        assert fingerprints.weights(fingerprints.fingerprint(t)) == plain.print_of(t)


def test_mixing(docs, clashing, empty):
    got = mixing.report(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.report(empty).count() == 0
    out = mixing.repeated(clashing)
    assert out.columns == clashing.columns
    words = lambda t: len((t or "").encode().split())
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in got)


def test_mixing_more_sources_than_a_dense_solve_holds(spark, monkeypatch):
    sizes = {f"s{i:04}": 1 + (i * 37) % 41 for i in range(4_500)} | {"\U0001f600": 7, "\uffee": 30_000, None: 9, "none": 0}
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string").repartition(5)
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(named)}
    want, free, left = {}, set(named), float(sum(sizes.values()))
    while True:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    want |= {s: weight[s] * unit for s in free}
    for most in (mixing.BROADCAST_SOURCES, 10):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        got = mixing.mixed(docs).collect()
        assert {r.source: r.target for r in got} == pytest.approx(want, rel=1e-12) and len(got) == len(sizes)
        assert all(abs(r.copies * r["size"] - r.target) <= r["size"] and r.copies <= 3 for r in got)


def test_balance_of_two_columns(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "s string, l string, size long")
    lam = mixing.balance(cells, ["s", "l"], {"s": {"a": 350.0, "b": 300.0}, "l": {"x": 400.0, "y": 250.0}}, 3.0)
    got = {(s, x): n * min(3.0, np.exp(lam["s"][s] + lam["l"][x])) for s, x, n in (("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50))}
    assert got["a", "x"] + got["a", "y"] == pytest.approx(350, rel=1e-6) and got["a", "x"] + got["b", "x"] == pytest.approx(400, rel=1e-6)


PAGES = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, " u\r\n%", None), (4, "", ""), (None, "n", "x" * 200), (5, "e", "é" * 60), (6, "f", "é" * 60), (6, "f", "é" * 60), (7, "g", "short"), (8, "h", "short"), (None, "p", "y" * 150), (None, "q", "y" * 150)]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", F.lit(1)).repartition(3)
    for options in ({}, {"shard_bytes": 400, "roll_bytes": 300}):
        folder = warc.write_warc(pages, **options)
        rows = warc.read_warc(spark, folder).collect()
        assert len(rows) == len(PAGES)
        texts = {}
        for i, u, h in PAGES:
            texts.setdefault((i, u), []).append(h or "")
        for r in rows:
            h = texts[r.page_id, r.url][0]
            first = min((i for i, _, x in PAGES if x == h and i is not None), default=None)
            twice = sum(x == h for _, _, x in PAGES) > 1 and len(h.encode()) >= 100
            assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
            assert r.target == (h if r.record_type == "response" else None)
            if twice and r.page_id != first:
                assert (r.record_type, r.refers_to) == ("revisit", first)
        kinds = [r.record_type for r in rows if r.page_id in (6, 5)]
        assert sorted(kinds) == ["response", "revisit", "revisit"] and sorted(r.record_type for r in rows if r.url in ("p", "q")) == ["response", "revisit"]
    assert warc.read_warc(spark, warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_is_deterministic(spark):
    from pathlib import Path

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    one, two = (warc.write_warc(pages.repartition(n), shard_bytes=400) for n in (2, 7))
    read = lambda f: {p.name: p.read_bytes() for p in Path(f.removeprefix("file://")).glob("*.warc.gz")}
    assert read(one) == read(two) != {}
    assert sorted(warc.manifest(spark, one).collect()) == sorted(warc.manifest(spark, two).collect())


def test_fingerprints(docs, empty):
    got = fingerprints.against_neighbours(docs, shard_bytes=100_000).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (d, t, *_), (_, u, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e), fingerprints.containment(fingerprints.fingerprint(t), fingerprints.fingerprint(e)), fingerprints.containment(fingerprints.fingerprint(t), fingerprints.fingerprint(u))))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert fingerprints.against_neighbours(empty).count() == 0


def test_chunks_shift():
    a = (SENTENCE + " and more of it. ").encode() * 3
    data = b"".join(bytes([65 + (i * i) % 26]) + a for i in range(20))
    cut = fingerprints.chunks(data)
    assert b"".join(cut) == data and all(fingerprints.LEAST <= len(c) <= fingerprints.MOST for c in cut[:-1])
    shifted = fingerprints.chunks(b"inserted" + data)
    assert len(set(cut) & set(shifted)) > 0.8 * len(set(cut))


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "x://www.example.com/en/1?a#b", "x://example.com/en/", "x://www.example.com/en", "ftp://deep.www.EXAMPLE.com/en/q", "h://n.net/es/", "h://net/es/x", "h://net/fr/", "h://a.net?es/", "h://x.com#/", "a://b://c.com/", "h://.com/", "h://com./", "h://" + "a." * 3000 + "com/" + "p" * 5000]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("_url", F.lit("own"))
    rules = spark.createDataFrame(url_filters.RULES, "key string, verdict string")
    for r in url_filters.report(pages, rules).collect():
        u = URLS[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [k for k, _ in url_filters.RULES if (h := k.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(k[len(h) :])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, dict(url_filters.RULES).get(rule, "allow")), u
    assert url_filters.allowed(pages, rules).columns == pages.columns
    assert {r.verdict for r in url_filters.report(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.report(pages.limit(0), rules).count() == 0


def test_many_rules(spark):
    """A list of 20000 rules, in one part and in several."""
    rules = [(f"h{i}.com/", "block" if i % 3 else "allow") for i in range(0, 20_000, 2)] + [(f"x.h{i}.com/p{i % 7}", "block" if i % 5 else "allow") for i in range(10_000)]
    known = dict(rules)
    urls = [f"http://{'x.' * (i % 3)}h{i}.com/p{i % 11}/q" for i in range(3_000)]
    pages, listed = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "key string, verdict string")
    want = []
    for i in range(3_000):
        rule = f"x.h{i}.com/p{i % 7}" if i % 3 and f"p{i % 11}".startswith(f"p{i % 7}") else None
        rule = rule or (f"h{i}.com/" if i % 2 == 0 else None)
        want.append((i, rule, known.get(rule, "allow")))
    for most in (url_filters.MOST_BITS, 1 << 16):
        got = url_filters.judged(pages, listed, "j", most_bits=most).select("page_id", "j.rule", "j.verdict")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_cascade_is_exact(spark):
    listed = spark.range(300).selectExpr("concat('k', id) as key")
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    c = url_filters.cascade(listed, universe, 20_000)
    assert len(c.levels) > 2
    assert universe.where(c.holds(F.col("key"))).count() == 300


def test_shards(spark):
    d = spark.range(1000).selectExpr("id * id as k")
    cut = shards_of(d, "k", F.lit(1), 50)
    assert shards_of(d.repartition(7), "k", F.lit(1), 50) == cut
    none = np.zeros(1000, bool)
    sizes = np.bincount(cut.of_values(np.arange(1000) ** 2, none, np.zeros(1000, np.int64)))
    assert sizes.max() <= 50 and len(sizes) == cut.count < 60
    assert shards_of(spark.createDataFrame([(None,), (0,), (0,), (2**62,)], "k long"), "k", F.lit(1), 1).count >= 2
    assert shards_of(d.limit(0), "k", F.lit(1), 1).count == 1
    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7L else id end as k", "cast(id as string) as t")
    cut = shards_of(hot, "k", F.lit(1), 100)
    n = {r.s: r["count"] for r in hot.groupBy(cut.of(F.col("k"), hashed(F.col("t"))).alias("s")).count().collect()}
    assert max(n.values()) < 200 and sum(n.values()) == 3000 and max(n) < cut.count
    places = hot.select("k", cut.of(F.col("k"), hashed(F.col("t"))).alias("s")).collect()
    by = {}
    for r in places:
        by.setdefault(r.s, set()).add(-1 if r.k is None else r.k)
    spans = [(min(by[s]), max(by[s])) for s in sorted(by)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as P

    d = spark.createDataFrame(rows, SCHEMA).withColumn("_copies", F.lit("own")).withColumn("Shard", F.lit(1))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, [(1, "Short"), (None, None)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = P.kept(stage(spark, docs, str(tmp_path)), "edge")
        assert docs.columns == columns
    out = P.kept(P.STAGES[-1][1](spark, docs, str(tmp_path)), "edge")
    assert out.count() == docs.count() and 8 not in {r.doc_id for r in out.collect()}
    assert sum(r.n_tokens for r in out.collect()) == max((r.start + r.n_tokens for r in out.collect()), default=0)
