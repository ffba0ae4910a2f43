"""A manifest that proves single rows: a hash tree over the rows of each group, and one over the groups' roots.

Rows get places within their group by a range sort and the counts of its parts, so no group has to fit a task. Trees are cut
into aligned blocks of 2**BLOCK nodes. A task holds the digests of one block and walks along its leaves: at each of the
stacked heights it has the subtree that the current path crosses and grows the next one, two steps a leaf, until it is needed
(fractal traversal), so what it keeps of inner nodes is a few subtrees, not the tree. Roots of blocks are the nodes of the next
round, and their paths are appended to those of the rows below.

Defined results: rows without a key come first in their group; rows without a group are a group of their own, the first one;
equal rows are leaves of their own, one after the other; an empty table has no rows; other columns are left as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyloom.llm.shared import discard, kept

#: Levels of a block, and of each subtree that is stacked in it.
BLOCK, SUBTREE = 10, 5
#: Rows of a table of counts or groups that may be broadcast; beyond it is joined by its key.
SMALL = 100_000

#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: str | None, right: str | None) -> str | None:
    """The digest over a run of two nodes, or of one where the row of nodes ends; none beyond."""
    return None if left is None else digest(left + (right or ""))


class Growth:
    """A subtree that grows by single steps from the leaves below it; it keeps its own levels and a stack of finished nodes."""

    def __init__(self, leaves: list[str], low: int, top: int, at: int):
        self.leaves, self.low, self.top = leaves, low, top
        self.next, self.end = at << top, (at + 1) << top
        self.stack: list[tuple[int, int, str | None]] = []
        self.nodes: dict[tuple[int, int], str | None] = {}

    @property
    def grown(self) -> bool:
        return self.next == self.end and len(self.stack) == 1

    def step(self) -> None:
        """One leaf, or one inner node."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            right, left = s.pop(), s.pop()
            node = (left[0] + 1, left[1] >> 1, parent(left[2], right[2]))
        elif self.next < self.end:
            node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        else:
            return
        s.append(node)
        if node[0] >= self.low:
            self.nodes[node[:2]] = node[2]


def grown(g: Growth) -> Growth:
    while not g.grown:
        g.step()
    return g


def walk(leaves: list[str], height: int, subtree: int = SUBTREE) -> tuple[str, Iterator[list[str | None]]]:
    """The root of a tree of that height over leaves, and for each leaf its siblings, from the lowest level up, None where there is none."""
    cuts = [*range(0, height, subtree), height]
    spans = list(zip(cuts, cuts[1:], strict=False)) or [(0, 0)]
    exist = [grown(Growth(leaves, low, top, 0)) for low, top in spans]

    def paths() -> Iterator[list[str | None]]:
        desired = [Growth(leaves, low, top, 1) for low, top in spans[:-1]]
        of = [min(k // subtree, len(spans) - 1) for k in range(height)]
        for j in range(len(leaves)):
            yield [exist[of[k]].nodes[k, (j >> k) ^ 1] for k in range(height)]
            for i, (low, top) in enumerate(spans[:-1]):
                desired[i].step()
                desired[i].step()
                if (j + 1) & ((1 << top) - 1) == 0:
                    exist[i] = desired[i]
                    desired[i] = Growth(leaves, low, top, ((j + 1) >> top) + 1)

    return exist[-1].nodes[height, 0], paths()


def height_of(n: int, block: int) -> int:
    """Levels of a block in a tree of n nodes: up to the block's root, or to the tree's where that is lower."""
    return block if n > 1 << block else (n - 1).bit_length()


def positions(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df (its column tree not null) with _idx, the place of each row in its tree, and _n, the rows of the tree."""
    cols = [tree, *order, "_tie"]
    runs = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*cols).sortWithinPartitions(*cols).drop("_tie")

    def number(batches):
        part, last, i = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for t in b.column(tree).to_pylist():
                i = i + 1 if t == last else 0
                last = t
                places.append(i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "_part", "_at"])

    numbered = kept(runs.mapInArrow(number, StructType([*runs.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])), "merkle-leaves")
    per = numbered.groupBy(tree, "_part").agg(F.count("*").alias("_rows"))  # one row for each part, and one more for each further tree in it
    w = Window.partitionBy(tree)
    per = kept(per.select(tree, "_part", (F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(w).alias("_n")), "merkle-counts")
    out = numbered.join(small(per), [tree, "_part"]).withColumn("_idx", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")
    out.kept_tables = (numbered, per)
    return out


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, which are counted; joined by key otherwise."""
    return F.broadcast(df) if df.count() <= SMALL else df


def roots(nodes: DataFrame, tree: str, leaf: str, block: int) -> DataFrame:
    """The roots of the blocks of nodes (tree, _idx, _n, leaf), which are the nodes of the next round."""

    def root(t: pa.Table) -> pa.Table:
        t = t.sort_by("_idx")
        n, at = t["_n"][0].as_py(), t["_idx"][0].as_py() >> block
        row = t[leaf].to_pylist()
        for _ in range(height_of(n, block)):
            row = [parent(row[i], row[i + 1] if i + 1 < len(row) else None) for i in range(0, len(row), 2)]
        return pa.table({tree: t[tree][:1], "_idx": [at], "_n": [-(-n >> block)], leaf: row}, schema=pa.schema([(tree, pa.string()), ("_idx", pa.int64()), ("_n", pa.int64()), (leaf, pa.string())]))

    own = nodes.select(tree, "_idx", "_n", leaf)
    return own.groupBy(tree, F.shiftright("_idx", block).alias("_block")).applyInArrow(root, f"{tree} string, _idx long, _n long, {leaf} string")


PATH = (("siblings", "string"), ("sides", "string"), ("root", "string"))


def paths(nodes: DataFrame, upper: DataFrame, tree: str, leaf: str, block: int) -> DataFrame:
    """nodes with siblings (digests one after the other, from below), sides (l, r or - for each level: where the sibling is, if any) and root.

    upper: those columns for the root of each block (tree, _idx).
    """
    fields = [f for f in nodes.schema.fields if f.name not in ("_idx", "_n")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} {t}" for c, t in PATH)])

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_idx")
        n, first = left["_n"][0].as_py(), left["_idx"][0].as_py() & ((1 << block) - 1)
        above = {c: right[c][0].as_py() for c, _ in PATH}
        siblings, sides = [], []
        for j, path in enumerate(walk(left[leaf].to_pylist(), height_of(n, block))[1], first):
            siblings.append("".join(s for s in path if s) + above["siblings"])
            sides.append("".join("-" if s is None else "lr"[1 - (j >> k & 1)] for k, s in enumerate(path)) + above["sides"])
        out = left.select(names)
        for c, values in zip((c for c, _ in PATH), (siblings, sides, [above["root"]] * len(sides)), strict=True):
            out = out.append_column(c, pa.array(values, pa.string()))
        return out

    at = nodes.groupBy(F.col(tree), F.shiftright("_idx", block).alias("_block"))
    return at.cogroup(upper.select(F.col(tree), F.col("_idx").alias("_block"), *(c for c, _ in PATH)).groupBy(tree, "_block")).applyInArrow(follow, schema)


def upper_paths(nodes: DataFrame, most: int, tree: str, leaf: str, block: int) -> DataFrame:
    """The paths of the roots of the blocks of nodes; most: nodes of the largest tree."""
    tops = kept(roots(nodes, tree, leaf, block), "merkle-roots")
    most = -(-most >> block)
    if most <= 1:
        return tops.select(tree, "_idx", F.lit("").alias("siblings"), F.lit("").alias("sides"), F.col(leaf).alias("root"))
    above = upper_paths(tops, most, tree, leaf, block)
    return paths(tops.withColumn("_own", F.col("_idx")), above, tree, leaf, block).withColumnRenamed("_own", "_idx")


def with_proofs(df: DataFrame, tree: str, order: list[str], leaf: str, block: int = BLOCK) -> DataFrame:
    """df with siblings, sides, subroot and root: what proves that its leaf (lower-case hex) is in the tree of its group, and that in the whole.

    tree: the group (text, null first in the order of groups); order: columns by which a group's rows are ordered, ties by leaf.
    """
    out = df.columns
    rows = positions(df.withColumn("_tree", F.coalesce(F.concat(F.lit("="), tree), F.lit(""))), "_tree", [*order, leaf])
    most = rows.agg(F.max("_n")).first()[0] or 0
    upper = kept(upper_paths(rows, most, "_tree", leaf, block), "merkle-upper")
    groups = upper.where("_idx = 0").select(F.lit("").alias("_all"), F.col("_tree"), F.col("root").alias("subroot"))
    above = positions(groups, "_all", ["_tree"])
    most = above.agg(F.max("_n")).first()[0] or 0
    tops = kept(paths(above, upper_paths(above, most, "_all", "subroot", block), "_all", "subroot", block).select("_tree", *(F.col(c).alias(f"_{c}") for c, _ in PATH)), "merkle-groups")
    joined = kept(upper.join(small(tops), "_tree").select("_tree", "_idx", F.concat("siblings", "_siblings").alias("siblings"), F.concat("sides", "_sides").alias("sides"), F.concat("root", "_root").alias("root")), "merkle-paths")
    discard(upper, tops, *above.kept_tables)
    width = 64  # hex digits of a digest; root has the group's and then the whole's
    return paths(rows, joined, "_tree", leaf, block).select(*out, "siblings", "sides", F.substring("root", 1, width).alias("subroot"), F.substring("root", width + 1, width).alias("root"))


def folded(leaf: pa.Array, siblings: pa.Array, sides: pa.Array) -> pa.Array:
    """The root that a leaf and its siblings lead to."""
    out = []
    for cur, path, where in zip(leaf.to_pylist(), siblings.to_pylist(), sides.to_pylist(), strict=True):
        at = 0
        for side in where:
            if side == "-":
                cur = digest(cur)
                continue
            sibling = path[at : at + 64]
            at += 64
            cur = digest(sibling + cur if side == "l" else cur + sibling)
        out.append(cur)
    return pa.array(out, pa.string())


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and the value, or a hyphen for null."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a seventh of the documents is checked after tampering."""
    own = {c: F.col(c) for c in FIELDS}
    changed = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_of(own).alias("leaf"), F.when(tampered, leaf_of(changed)).alias("other"))
    proved = with_proofs(leaves, "lang", ["doc_id"], "leaf", block)
    out = proved.withColumn("folded_root", F.arrow_udf(folded, "string")(F.coalesce("other", "leaf"), "siblings", "sides"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
