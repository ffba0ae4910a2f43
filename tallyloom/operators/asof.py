"""As-of joins over ranges: each row with the last (or next) one of its key on the other side, however many rows a key has.

Both sides are sorted by key and place over all tasks. A task passes over its rows once and carries the last right row on; what
it ends with goes to the tasks after it, one row each. A key that fills many tasks is no different from any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tallyloom.operators.stored import stored


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has other keys than the one before."""
    n = len(columns[0])
    out = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        out |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return out


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str | None = None, *, tie: str | None = None, strict: bool = False, following: bool = False) -> DataFrame:
    """left with the columns of the last row of right (its keys left out) whose place is at or before left's; null where there is none.

    strict: before alone. following: the next row instead, at or after. tie: of right rows of one key and place the one with the
    greatest (following: the smallest) value counts; without it any. Rows of left without a key or place find nothing; those of
    right are left out. Columns of right must not be columns of left. Keys are of simple types.
    """
    right_at = right_at or at
    theirs = [c for c in right.columns if c not in keys]
    if clash := {c.lower() for c in theirs} & {c.lower() for c in left.columns}:
        raise ValueError(f"both sides have {sorted(clash)}")
    whole = lambda d, p: d.where(" and ".join(f"`{c}` is not null" for c in (*keys, p)))
    lone = left.where(" or ".join(f"`{c}` is null" for c in (*keys, at)))
    kind_l, kind_r = StructType(left.schema.fields), StructType([StructField(c, right.schema[c].dataType, True) for c in theirs])
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    first = 0 if strict else 1  # among equal places, a strict join has left rows first
    none = lambda kind: F.lit(None).cast(kind)
    tied = F.col(tie) if tie else F.lit(None)
    a = whole(left, at).select(*key, F.col(at).alias("_at"), F.lit(first).alias("_side"), none(right.schema[tie].dataType if tie else "int").alias("_tie"), F.struct(*(F.col(c) for c in left.columns)).alias("_l"), none(kind_r).alias("_r"))
    b = whole(right, right_at).select(*key, F.col(right_at).alias("_at"), F.lit(1 - first).alias("_side"), tied.cast(right.schema[tie].dataType if tie else "int").alias("_tie"), none(kind_l).alias("_l"), F.struct(*(F.col(c) for c in theirs)).alias("_r"))
    names = [f"_k{i}" for i in range(len(keys))]
    down = (lambda c: F.col(c).desc()) if following else F.col
    order = [*names, down("_at"), F.col("_side"), down("_tie")]
    n = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = a.unionByName(b).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*names, "_l", "_r")
    schema = StructType([*both.schema.fields, StructField("_part", IntegerType()), StructField("_open", BooleanType())])

    def carry(batches):
        part, held, last, opening = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, r = [batch.column(c) for c in names], batch.column("_r")
            here = [c[:1] for c in columns]
            new = np.concatenate(([last is not None and bool(changes([pa.concat_arrays([x, y]) for x, y in zip(last, here, strict=True)])[0])], changes(columns)))
            is_right = r.is_valid().to_numpy(zero_copy_only=False)
            place = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(new, place, -1))  # where the row's key began; -1: before this batch
            latest = np.maximum.accumulate(np.where(is_right, place, -1))
            found = np.where(latest >= np.maximum(begun, 0), latest, -1)
            # index 0 is what was carried into this batch, or null
            pool = pa.concat_arrays([held if held is not None else pa.nulls(1, r.type), r])
            index = np.where(found >= 0, found + 1, 0)
            none_carried = (found < 0) & (begun >= 0)
            taken = pool.take(pa.array(index, mask=none_carried))
            left_rows = ~is_right
            still = opening & ~np.logical_or.accumulate(new)
            open_ = still & (found < 0) & (held is None or not held.is_valid()[0].as_py())
            opening = opening and not new.any()
            end = batch.num_rows - 1
            if begun[end] >= 0 or found[end] >= 0:
                held = r[int(found[end]) : int(found[end]) + 1] if found[end] >= 0 else None
            last = [c[end:] for c in columns]
            mask = pa.array(left_rows)
            out = [*(c.filter(mask) for c in columns), batch.column("_l").filter(mask), taken.filter(mask), pa.array(np.full(int(left_rows.sum()), part, np.int32)), pa.array(open_[left_rows])]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "_l", "_r", "_part", "_open"])
        if last is not None:  # what goes on to the tasks after this one: its last key, and that key's last right row, if any
            tail = held if held is not None else pa.nulls(1, r.type)
            yield pa.RecordBatch.from_arrays([*last, pa.nulls(1, batch.column("_l").type), tail, pa.array([part], pa.int32()), pa.array([opening])], names=[*names, "_l", "_r", "_part", "_open"])

    rows = stored(both.mapInArrow(carry, schema), "asof")
    # A task whose rows are all of one key without a right row passes on what it was given: such tails are skipped.
    tails = rows.where("_l is null").select("_part", *(F.col(c).alias(f"{c}_") for c in names), F.col("_r").alias("_tail"), F.col("_open").alias("_through"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    given = F.last(F.when(~(F.col("_through") & F.col("_tail").isNull()), F.struct(*(f"{c}_" for c in names), "_tail")), ignorenulls=True).over(w)
    carried = tails.select("_part", given.alias("_given"))
    j = rows.where("_l is not null").join(F.broadcast(carried), "_part", "left")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_given.{c}_"))
    j = j.withColumn("_r", F.when(F.col("_open") & same, F.col("_given._tail")).otherwise(F.col("_r")))
    out = j.select("_l.*", *(F.col(f"_r.`{c}`").alias(c) for c in theirs))
    return out.unionByName(lone.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in theirs)))


def labels(cells: DataFrame) -> DataFrame:
    """cells (sheet, row, col, value, vtype) with row_label and column_label: the nearest text to the left in its row and above in its column, null if none."""
    texts = cells.where("vtype = 'text' and value is not null")
    left = texts.select("sheet", "row", F.col("col").alias("_at"), F.col("value").alias("row_label"))
    above = texts.select("sheet", "col", F.col("row").alias("_at"), F.col("value").alias("column_label"))
    d = asof(cells, left, ["sheet", "row"], "col", "_at", strict=True).drop("_at")
    return asof(d, above, ["sheet", "col"], "row", "_at", strict=True).drop("_at")
