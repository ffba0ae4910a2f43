"""Document fingerprints by content-defined chunking, and how much of one document another contains.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes has zeros under a mask: a stricter mask up to the
normal size, a laxer one after it, so that chunk sizes gather round it. A cut depends on nearby bytes only; after an
insertion the cuts fall into step again. The fingerprint is the set of chunk digests, each with the bytes it covers.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import shards_of

#: Bytes of a chunk: least, normal, most; and of a digest in a fingerprint.
LEAST, NORMAL, MOST, DIGEST = 16, 32, 128, 6
STRICT, LAX = np.uint32(0b111111 << 26), np.uint32(0b111 << 26)


def gears() -> np.ndarray:
    """A random-looking 32-bit number for each byte."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:4], "big") for b in range(256)], np.uint32)


GEARS = gears()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the gears of the last 32 bytes, each shifted by its distance."""
    h = GEARS[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks(data: bytes) -> list[bytes]:
    """Consecutive pieces of data, cut as the module says."""
    if not data:
        return []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    lax = np.flatnonzero((h & LAX) == 0)
    strict = lax[(h[lax] & STRICT) == 0]
    out, at, n = [], 0, len(data)
    strict_at, lax_at = strict.tolist(), lax.tolist()
    i = j = 0
    while n - at > LEAST:
        while i < len(strict_at) and strict_at[i] < at + LEAST - 1:
            i += 1
        if i < len(strict_at) and strict_at[i] < at + NORMAL:
            end = strict_at[i] + 1
        else:
            while j < len(lax_at) and lax_at[j] < at + NORMAL:
                j += 1
            end = min(lax_at[j] + 1 if j < len(lax_at) else n, at + MOST, n)
        out.append(data[at:end])
        at = end
    return [*out, data[at:]] if at < n else out


def fingerprint(text: str) -> str:
    """Base64 of the sorted digests, each followed by the bytes that its chunks cover (4 bytes); empty for an empty text."""
    covered: dict[bytes, int] = {}
    for c in chunks(text.encode("utf-8", "surrogatepass")):
        d = xxhash.xxh3_64_digest(c)[:DIGEST]
        covered[d] = covered.get(d, 0) + len(c)
    return base64.b64encode(b"".join(d + n.to_bytes(4, "big") for d, n in sorted(covered.items()))).decode()


def weights(print_: str) -> dict[bytes, int]:
    raw = base64.b64decode(print_)
    return {raw[i : i + DIGEST]: int.from_bytes(raw[i + DIGEST : i + DIGEST + 4], "big") for i in range(0, len(raw), DIGEST + 4)}


def containment(a: str, b: str) -> float:
    """The share of the first fingerprint's bytes whose chunks the second has too, 0 to 1. Two empty texts: 1."""
    x, y = weights(a), weights(b)
    if not x:
        return float(not y)
    return sum(min(n, y[d]) for d, n in x.items() if d in y) / sum(x.values())


def with_fingerprint(docs: DataFrame, name: str, *, text: str = "text") -> DataFrame:
    """docs with the fingerprint of each text (null: empty)."""

    @F.arrow_udf("string")
    def print_(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "") for t in texts.to_pylist()], pa.string())

    return docs.withColumn(name, print_(F.col(text)))


def contained(a: Column, b: Column) -> Column:
    """containment() of two columns of fingerprints."""

    @F.arrow_udf("double")
    def share(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else containment(x, y) for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.float64())

    return share(a, b)


def spliced(text: str, following: str) -> str:
    """text with its last third replaced by as much (or all) of the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def against_neighbours(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """Each document's fingerprint beside that of its text spliced with the next document's, and the likeness to both.

    The next document is that with the next smaller doc_id (rows without one come last; equal ones stand by text), after
    the last the first. Texts move once, into shards along doc_id; the first row of each shard goes to the one before too.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = shards_of(d, "id", F.octet_length("t") + 16, shard_bytes, split=False)
    shards = cut.count
    d = d.withColumn("shard", cut.of(F.col("id"), F.lit(0).cast("long")))
    heads = d.groupBy("shard").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("top")).orderBy("shard").collect()  # a row for each shard
    full = [r.shard for r in heads]
    #: The shard whose last row is followed by this shard's first: the next one above that has rows, or around.
    before = {s: full[(i + 1) % len(full)] for i, s in enumerate(full)}
    tops = docs.sparkSession.createDataFrame([(r.shard, r.top.id, before[r.shard]) for r in heads], "shard int, top long, also int")
    d = d.join(F.broadcast(tops), "shard").withColumn("to", F.when(F.col("id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("shard").alias("s"), F.lit(True).alias("own")), F.struct(F.col("also").alias("s"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("shard").alias("s"), F.lit(True).alias("own")))))
    d = d.select("id", "t", F.explode("to").alias("to")).select("id", "t", "to.s", "to.own")
    d = d.repartitionById(shards, F.col("s")).sortWithinPartitions(F.col("s"), F.col("own").desc(), F.col("id").desc_nulls_last(), F.col("t"))

    def neighbours(batches):
        def told(some: list[tuple], last: tuple | None):
            pairs = list(zip(some, [*some[1:], last] if last is not None else some[1:], strict=False))
            ids, size, edited, prints, edited_prints, near_edited, near_next = [], [], [], [], [], [], []
            after = fingerprint(pairs[0][0][1]) if pairs else ""
            for (i, t), (_, following) in pairs:
                own, after, e = after, fingerprint(following), spliced(t, following)
                p = fingerprint(e)
                ids.append(i)
                size.append(len(t))
                edited.append(hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest())
                prints.append(own)
                edited_prints.append(p)
                near_edited.append(containment(own, p))
                near_next.append(containment(own, after))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(edited), pa.array(prints), pa.array(edited_prints), pa.array(near_edited), pa.array(near_next)], OUT)

        shard, wait, closing = None, [], False
        for b in batches:
            for i, t, s, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    shard, wait, closing = s, [], False
                if not own:
                    if not closing:  # of equal ids the first by text
                        yield told(wait, (i, t))
                        wait, closing = [], True
                    continue
                wait.append((i, t))
                if len(wait) > 500:
                    yield told(wait, None)
                    wait = wait[-1:]

    return d.mapInArrow(neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
