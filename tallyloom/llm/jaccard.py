"""Near duplicates as an n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Equal sets are one class and take part once. Classes are joined on the shingles of their prefixes, the rarest
ones first in the order of a count sketch over the whole corpus. Of the classes that share a prefix shingle,
first all are paired with the class of the smallest id; then only classes that are still in different
components are paired with each other, so a large group of near copies doesn't cost the square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import discard, fresh_name, kept, small_batches

#: Counters of the sketch that orders shingles; fixed, whatever the size of the corpus.
SKETCH = 1 << 20
#: Parts of the hash range whose counts the suffix filter compares.
PARTS = 64
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(32)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, words parted by ASCII white space."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + len(out)]) * MIX[j % len(MIX)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def sketch_of(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingle counts by hash over all documents (each counts a shingle once). Tasks send a row for each counter that they met."""

    def count(batches):
        own = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(own, (shingle_set(t, words) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        at = np.flatnonzero(own)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(own[at[i : i + 100_000]])], ["at", "n"])

    rows = docs.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def profiles(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """id, n, class (a digest of the set), parts (PARTS counts) and prefix (rarest shingles first) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch_of(docs, text, words))

    def profile(batches):
        counts = sent.value
        for b in batches:
            n, keys, parts, prefixes = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                parts.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS), 65535).astype(np.uint16).tobytes())
                k = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                prefixes.append(s[np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:k]].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))],
                ["id", "n", "class", "parts", "prefix"],
            )

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(profile, "id long, n long, class binary, parts binary, prefix array<long>")


def may_differ(a: str, b: str, percent: int) -> Column:
    """The suffix filter: the sets' counts in equal parts of the hash range differ by at most what similarity allows.

    A symmetric difference of more than (100 - percent) / (100 + percent) of both sizes rules a pair out; the sum of the
    parts' differences is a lower bound of it.
    """

    @F.arrow_udf("boolean")
    def near(p: pa.Array, q: pa.Array) -> pa.Array:
        if not len(p):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64) for c in (p, q))
        full = (x == 65535).any(1) | (y == 65535).any(1)
        return pa.array((np.abs(x - y).sum(1) * (100 + percent) <= (100 - percent) * (x.sum(1) + y.sum(1))) | full)

    return near(F.col(a), F.col(b))


def similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose sets are similar, each verified once on the whole sets."""
    parts = classes.select("id", "parts")
    pairs = (
        pairs.join(parts.withColumnsRenamed({"id": "a", "parts": "pa"}), "a").join(parts.withColumnsRenamed({"id": "b", "parts": "pb"}), "b")
        .where(may_differ("pa", "pb", percent)).select("a", "b")
    )
    pairs = kept(pairs, "pairs")
    spark, bits = pairs.sparkSession, 1 << 24
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p"))
    words_set = met.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[words_set["w"].to_numpy()] = words_set["v"].to_numpy()
    sent = spark.sparkContext.broadcast(filled)

    @F.arrow_udf("array<binary>")
    def sets(p: pa.Array, texts: pa.Array) -> pa.Array:
        x = p.to_numpy(zero_copy_only=False)
        met = (sent.value[x >> 6] >> (x & 63)) & 1 == 1
        return pa.array([[shingle_set(t.as_py(), words).tobytes()] if m else [] for m, t in zip(met, texts, strict=True)], pa.list_(pa.binary()))

    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")
    own = own.select("id", F.explode(sets(F.pmod(F.xxhash64("id"), F.lit(bits)), F.col("t"))).alias("s"))  # not a filter, before which Spark would call it once more
    own = own.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")

    @F.arrow_udf("boolean")
    def linked(p: pa.Array, q: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            out.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        return pa.array(out, pa.bool_())

    a, b = own.select(F.col("id").alias("a"), F.col("s").alias("sa")), own.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    out = kept(pairs.join(a, "a").join(b, "b").where(linked("sa", "sb")).select("a", "b").distinct(), "links")
    discard(pairs)
    return out


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that links reach) of each linked id, by alternating large and small stars."""

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = told(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        old, e = e, kept(small.distinct(), "edges")
        discard(old)
        after = told(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: components of documents whose word shingle sets have a Jaccard similarity of percent / 100 or more.

    A text of fewer words is one shingle; an empty or null text has none and stands alone. Rows with the same doc_id are
    one node of the links. A row without doc_id takes the component of its equals, else null, and joins no others.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, doc_id, text, words, percent)


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    d = kept(profiles(docs, doc_id, text, words, percent), "profiles")
    classes = d.where("n > 0").groupBy("class").agg(F.min("id").alias("rep"))
    reps = classes.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    c = d.where("n > 0").join(reps, "id", "left_semi")

    hits = c.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "id", F.shiftleft("n", 24).bitwiseOR(F.col("pos")).alias("at"))
    shared = hits.groupBy("token").agg(F.min(F.struct("id", "at")).alias("pivot"), F.max("id").alias("last")).where("last > pivot.id").select("token", "pivot")
    hits = kept(hits.join(shared, "token").select("token", "id", "at", "pivot"), "hits")

    def size(at: Column) -> Column:
        return F.shiftright(at, 24)

    def fits(x: Column, y: Column) -> Column:
        """Length filter, and positional filter: what can be common from the shared shingle on is enough."""
        left = lambda at: size(at) - at.bitwiseAND((1 << 24) - 1)
        return (100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))) & ((100 + percent) * F.least(left(x), left(y)) >= percent * (size(x) + size(y)))

    narrow = kept(c.select("id", "parts"), "parts")
    star = hits.where(F.col("id") != F.col("pivot.id")).where(fits(F.col("at"), F.col("pivot.at"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    links = similar(star, docs, narrow, doc_id, text, words, percent)
    part = kept(components(links), "components")

    named = hits.select("token", "id", "at").join(part, "id", "left").select("token", "id", "at", F.coalesce("component", "id").alias("part"))
    apart = named.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    rest = kept(named.join(apart, "token", "left_semi"), "rest")
    x, y = rest.select("token", F.col("id").alias("a"), F.col("at").alias("x"), F.col("part").alias("p")), rest.select("token", F.col("id").alias("b"), F.col("at").alias("y"), F.col("part").alias("q"))
    across = x.join(y, (x["token"] == y["token"]) & (F.col("p") != F.col("q")) & (F.col("a") < F.col("b")) & fits(F.col("x"), F.col("y"))).select("a", "b").distinct()
    across = across.join(star, ["a", "b"], "left_anti")
    more = similar(across, docs, narrow, doc_id, text, words, percent)
    part = kept(components(links.unionByName(more)), "components") if more.head(1) else part
    discard(narrow, hits, rest)
    d = d.select("id", "n", "class")

    named = classes.join(part.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("c"))
    out = d.select("id", "n", "class").join(named, "class", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("c", "id")).otherwise(F.col("id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each component the row with the smallest doc_id, whole and as it was; empty texts, which are like nothing, all stay.

    Of rows with the same doc_id one stays, that with the smallest text. A row without doc_id stays.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    stay = found.where(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).cast("long").alias("_stay")).distinct()
    out = docs.join(stay, docs[doc_id].cast("long") == stay["_stay"], "left_semi")
    if found.groupBy(doc_id).count().where(F.col(doc_id).isNotNull() & (F.col("count") > 1)).head(1):
        place = fresh_name(docs, "_place")
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(doc_id).orderBy(text))).where(F.col(place) == 1).drop(place)
    return out.unionByName(docs.where(F.col(doc_id).isNull()))
