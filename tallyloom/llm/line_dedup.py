"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line-id sequences.

Each line's id is its rank in the sorted table of distinct lines. Doubling then ranks all runs of 2, 4, 8 ... lines: the
rank of a run of 2^(k+1) lines is that of the pair of ranks of its halves in the sorted table of distinct pairs. That is
the suffix array of the lines, sorted on as many lines as a run can need; suffixes with the same rank are an interval
whose longest common prefix has that many lines. Only runs that occur twice are ranked on; most lines leave at once.
The intervals give the maximal repeated runs of at least a number of words, and their later copies are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import discard, fresh_name, kept

#: Words that a repeated run has at least.
LEAST_WORDS = 50


def ranked(pairs: DataFrame, columns: list[str], tables: list[DataFrame]) -> DataFrame:
    """Distinct rows of the columns that occur twice or more, with their rank in sorted order (from 1).

    Counted with a partial count in each task, then sorted by range; a rank is a place in a partition plus the rows of
    the partitions before it, of which the driver gets one number each. What is written is added to tables.
    """
    rows = pairs.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = kept(rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns).select(*columns, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("place")), "ranks")
    tables.append(rows)
    before, told = 0, []
    for r in rows.groupBy("part").agg(F.max("place").alias("m")).orderBy("part").collect():
        told.append((r.part, before))
        before += r.m + 1
    told = rows.sparkSession.createDataFrame(told, "part int, before long")
    return rows.join(F.broadcast(told), "part").select(*columns, (F.col("place") + F.col("before") + 1).alias("rank"))


def lines_of(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """id and hash of the text (one row for equal ones), and of each line: place, digest, lines of the shortest run of enough words that begins and that ends there (null: none)."""

    def cut(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "text", "place", "line", "ahead", "back")}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                own, lines = xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw.split(b"\n")
                total = np.cumsum([0, *(len(x.split()) for x in lines)])
                ends = np.searchsorted(total, total[:-1] + least)  # the first place with so many words more
                begins = np.searchsorted(total, total[1:] - least, side="right") - 1
                for k, x in enumerate(lines):
                    out["id"].append(i)
                    out["text"].append(own)
                    out["place"].append(k)
                    out["line"].append(xxhash.xxh3_128_digest(x))
                    out["ahead"].append(int(ends[k]) - k if ends[k] <= len(lines) else None)
                    out["back"].append(k + 1 - int(begins[k]) if begins[k] >= 0 else None)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("text", pa.int64()), ("place", pa.int32()), ("line", pa.binary()), ("ahead", pa.int32()), ("back", pa.int32())]))

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(cut, "id long, text long, place int, line binary, ahead int, back int")


def later_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """id, text (its hash), place of each line to delete.

    A line goes if it lies in a run of at least so many words that occurred before: in a document of smaller id (without an
    id: after all others; then by the text's hash), or earlier in its own, where both don't overlap. So the first copy stays
    whole: of a line that repeats without end as many stay as make one run. Runs don't cross documents. Rows with equal id and
    text are one document.
    """
    lines = kept(lines_of(docs, doc_id, text, least).dropDuplicates(["id", "text", "place"]), "lines")
    tables, k = [lines], 0
    level = lines.join(ranked(lines, ["line"], tables), "line").select("id", "text", "place", F.col("rank"))
    levels = [kept(level, "level")]
    runs = lines.select("id", "text", "place", F.col("ahead").alias("n")).where("n is not null").unionByName(lines.select("id", "text", (F.col("place") - F.col("back") + 1).alias("place"), F.col("back").alias("n")).where("n is not null")).distinct()
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text") == F.col(f"{b}.text"))

    def joined(left: DataFrame, right: DataFrame, shift) -> DataFrame:
        return left.alias("a").join(right.alias("b"), same("a", "b") & (F.col("a.place") + shift == F.col("b.place")))

    runs = kept(joined(runs, levels[0], F.lit(0)).select("a.*"), "runs")  # a repeated run's lines are repeated ones
    most = runs.agg(F.max("n")).first()[0] or 1
    while 2 ** (k + 1) <= most:
        pairs = kept(joined(levels[k], levels[k], F.lit(2**k)).select("a.id", "a.text", "a.place", F.col("a.rank").alias("x"), F.col("b.rank").alias("y")), "pairs")
        r = ranked(pairs, ["x", "y"], tables)
        levels.append(kept(pairs.join(r, ["x", "y"]).select("id", "text", "place", "rank"), "level"))
        tables.append(pairs)
        k += 1
    found = None
    for j, lv in enumerate(levels):  # a run of n lines is two runs of 2^j lines that overlap
        own = runs.where((F.col("n") >= 2**j) & (F.col("n") < 2 ** (j + 1)))
        one = joined(own, lv, F.lit(0)).select("a.id", "a.text", "a.place", "a.n", F.col("b.rank").alias("x"))
        two = joined(one, lv, F.col("a.n") - 2**j).select("a.id", "a.text", "a.place", "a.n", "a.x", F.col("b.rank").alias("y"))
        found = two if found is None else found.unionByName(two)
    found = kept(found, "found")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "text", "place")
    first = found.groupBy("n", "x", "y").agg(F.min(at).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    apart = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text") == F.col("first.text")) & (F.col("place") < F.col("first.place") + F.col("n")))
    out = found.join(first, ["n", "x", "y"]).where(apart).select("id", "text", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place")).distinct()
    out = kept(out, "later")
    discard(*levels, *tables, runs, found)
    return out


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs whose texts have lost the lines of later_copies(); other texts, null ones too, and other columns stay as they were."""
    gone = later_copies(docs, doc_id=doc_id, text=text, least=least).groupBy("id", "text").agg(F.collect_set("place").alias("gone"))  # at most a document's lines
    own, key = fresh_name(docs, "_own"), fresh_name(docs, "_key")

    @F.arrow_udf("long")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts.to_pylist()], pa.int64())

    d = docs.withColumn(own, digest(F.col(text))).withColumn(key, F.col(doc_id).cast("long")).alias("d")
    d = d.join(gone.alias("g"), F.col(f"d.{key}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{own}") == F.col("g.text")), "left")
    lines = F.split(F.col(f"d.{text}"), "\n")
    cut = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    return d.select(*[F.when(F.col("g.gone").isNotNull(), cut).otherwise(F.col(f"d.`{c}`")).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def report(docs: DataFrame, *, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_sha256 (of the text that is left; null: empty) of each document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").alias("whole"))
    d = without_repeats(d.withColumn("whole", F.size(F.split("whole", "\n"))), least=least)
    return d.select("doc_id", F.greatest(F.coalesce("whole", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
