"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned for in the word windows of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import discard, fresh_name, kept

#: Of ASCII, 0-9 and a-z are parts of words, A-Z too in lower case; so is all else from U+0080 on.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

#: Bytes that the windows of one scan may take, about, in each Python worker; a larger benchmark is scanned for block by block.
BLOCK_BYTES = 64 << 20
#: What a word of a block takes (a word id, a hash, a place and an item), and what a distinct word takes besides.
PER_WORD, PER_DISTINCT = 24, 150


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of a block of items in flat arrays: all items' word ids end to end, and by length the windows' hashes in order, places, and items.

    items: id (null: an item without one) and words. An item's windows are those of size words; of fewer words, all of them are one window.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.words: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        self.flat = np.array([self.words.setdefault(w, len(self.words) + 1) for _, own in items for w in own], np.int32)
        lengths = np.array([len(own) for _, own in items], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(lengths, size)).tolist():
            some = np.flatnonzero(np.minimum(lengths, size) == n)
            if not n:
                continue
            each = lengths[some] - n + 1
            item = np.repeat(some, each)
            at = np.repeat(starts[some] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            hashes = self.rolled(self.flat, n)[at]
            order = np.lexsort((item, hashes))
            hashes, at, item = hashes[order], at[order], item[order]
            again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])))
            for k in range(n):  # a window that an item has twice is listed once
                again[1:] &= self.flat[at[1:] + k] == self.flat[at[:-1] + k]
            self.by[n] = hashes[~again], at[~again].astype(np.int32 if len(self.flat) < 1 << 31 else np.int64), item[~again].astype(np.int32)

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each window of n ids."""
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        h = np.zeros(len(x) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + x[j : j + len(h)]
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which of the words lie in an occurrence of a window, and the items of those windows."""
        get, hit, items = self.words.get, np.zeros(len(words), bool), set()
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for n, (hashes, places, owner) in self.by.items():
            if len(ids) < n:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            h = self.rolled(ids, n)[starts] if len(starts) * 4 > len(ids) else np.array([self.rolled(ids[s : s + n], n)[0] for s in starts], np.uint64)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s, a, own in zip(*(x[hashes[at] == h] for x in (starts, at, h)), strict=True):
                b = a + np.searchsorted(hashes[a:], own, side="right")
                same = (self.flat[places[a:b, None] + np.arange(n)] == ids[s : s + n]).all(axis=1)  # the hash only proposes
                if same.any():
                    hit[s : s + n] = True
                    items.update(self.items[i] for i in owner[a:b][same].tolist())
        return hit, items


def blocks(benchmark: DataFrame, size: int, item: str, text: str, block_bytes: int) -> Iterator[Windows]:
    """The benchmark in blocks of about block_bytes (an item isn't split), one at a time. It streams to the driver item by item."""
    block, words, have, none = [], set(), 0, True
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        own = words_of(r.t)
        if not own:
            continue
        if block and have + PER_WORD * len(own) + PER_DISTINCT * len(words) > block_bytes:
            yield Windows(block, size)
            block, words, have, none = [], set(), 0, False
        block.append((r.i, own))
        words.update(own)
        have += PER_WORD * len(own)
    if block or none:
        yield Windows(block, size)


#: Of a text: number of words, positions of hit words as [start, end) spans of words, items with occurring windows.
SCAN = "struct<n_words:long,spans:array<struct<start:int,stop:int>>,items:array<string>>"
SCAN_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])


def runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]


def in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


def scanner(sent: Broadcast) -> Callable:
    """The scan for one broadcast block, as a function of the text's column and that of what earlier blocks found (null: nothing)."""

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        own, out = sent.value, []
        for t, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
            words = words_of(t)
            hit, items = own.scan(words)
            if old:
                items.update(old["items"])
                for s in old["spans"]:
                    hit[s["start"] : s["stop"]] = True
            out.append({"n_words": len(words), "spans": runs(hit) if items else [], "items": in_order(items)})
        return pa.array(out, SCAN_TYPE)

    return scan


def scanned(docs: DataFrame, benchmark: DataFrame, name: str, *, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column (see SCAN) under the given name. No shuffle: a pass over the rows has one broadcast block.

    A benchmark of more than one block takes a pass for each; the rows are written to the shared folder between passes, so
    no task and no driver holds two blocks. A null or wordless text has no words and no hits; a wordless item takes no part;
    items with the same id count once, and those without an id count as one, listed as null at the end. Other columns pass through.
    """
    sc, out, before = docs.sparkSession.sparkContext, docs, None
    for own in blocks(benchmark, size, item, item_text, block_bytes):
        if before is not None:  # a further block: what the one before found is written first
            done = kept(out, "scanned")
            before.destroy()
            if out is not docs and earlier is not None:
                discard(earlier)
            out, earlier = done, done
        else:
            earlier = None
        sent = sc.broadcast(own)
        out = out.withColumn(name, scanner(sent)(F.col(text), F.col(name) if before is not None else F.lit(None).cast(SCAN)))
        before = sent
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids that there are), contaminated of each document."""
    d = docs.select("doc_id", options.get("text", "text"))
    s = F.col("_scan")
    n_hit = F.aggregate(s["spans"], F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return scanned(d, benchmark, "_scan", **options).select(
        "doc_id", s["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(s["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, whole and as they were."""
    name = fresh_name(docs, "_scan")
    return scanned(docs, benchmark, name, **options).where(F.size(F.col(name)["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs without the hit words: from the first to the last word of each hit span, what stands between them included.

    Texts are scanned again until no window is left, for what remains can join to a new one. A text without hits stays as it was.
    """
    own = {k: v for k, v in options.items() if k in ("size", "item", "item_text", "block_bytes")}
    name = fresh_name(docs, "_scan")
    columns = [F.col(f"`{c}`") for c in docs.columns]

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t, s["spans"]) if s["spans"] else t for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    clean = None
    while True:
        d = kept(scanned(docs, benchmark, name, text=text, **own), "spans")
        done = d.where(F.size(F.col(name)["spans"]) == 0).select(*columns)
        clean = done if clean is None else clean.unionByName(done)
        left = d.where(F.size(F.col(name)["spans"]) > 0)
        if not left.head(1):
            return clean
        docs = kept(left.withColumn(text, cut(F.col(text), F.col(name))).select(*columns), "cut")


def cut_spans(text: str, spans: list[dict]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))).reshape(-1, 2)
    keep, at = [], 0
    for s in spans:
        keep.append(raw[at : edges[s["start"], 0]])
        at = edges[s["stop"] - 1, 1]
    return (b"".join(keep) + raw[at:]).decode("utf-8", "surrogatepass")
