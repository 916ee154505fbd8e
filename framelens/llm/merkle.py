"""Merkle manifest of a table, stored in blocks laid out after van Emde Boas.

Rows become leaves; the leaves of a group (a language) ascend by id, and every run of ``ARITY``
consecutive nodes becomes their hash until one is left, the group's subroot. Subroots, ordered by
group, are the leaves of one more tree, whose root stands for the whole table.

A tree is cut into aligned blocks of ``HEIGHT`` levels: one stored row holds the nodes of a block
in one byte string. Inside a block the tree is split at half of its height, the top part stored
before the bottom subtrees from left to right, each of them split in the same way, so a walk from
a leaf to the root stays within few neighbouring stretches whatever the size of a cache line or
page. ``addresses`` does that arithmetic, for building as well as for finding siblings. The roots
of the blocks of a group are the leaves of its next level of blocks, so a billion rows need three
levels. No task sees more than one block, and nothing but counts of levels reaches the driver.

Proofs go the other way: a block hands every block below it the siblings from its root upwards,
and the lowest blocks emit one row per leaf.

Defined results: null fields hash as ``-``; null groups and null ids come first; rows of equal id
are ordered by their leaf, repeated rows are leaves like others; a null id is never tampered
with; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm import common

ARITY = 8
HEIGHT = 4
BLOCK = ARITY**HEIGHT
STEPS = "array<struct<place: int, others: string>>"


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth of a full tree of ``levels`` levels, where its nodes are stored."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    bottom = levels - top
    head, tail = addresses(top), addresses(bottom)
    starts = sum(map(len, head)) + np.arange(ARITY**top, dtype=np.int64) * sum(map(len, tail))
    return (*head, *((starts[:, None] + depth[None, :]).ravel() for depth in tail))


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def levels_needed(n: int) -> int:
    """Rounds of merging until one of ``n`` nodes is left."""
    rounds = 0
    while n > 1:
        n, rounds = -(-n // ARITY), rounds + 1
    return rounds


def counts(n: int, height: int) -> list[int]:
    """Nodes at each depth of a block with ``n`` leaves; depth 0 is its root."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


class Block:
    """Nodes of an aligned subtree, read and written through their addresses."""

    def __init__(self, nodes: np.ndarray, n: int, height: int):
        self.nodes, self.height, self.counts, self.at = nodes, height, counts(n, height), addresses(height + 1)

    @classmethod
    def build(cls, leaves: np.ndarray, height: int) -> Block:
        sizes, at = counts(len(leaves), height), addresses(height + 1)
        used = max(int(places[:size].max()) for places, size in zip(at, sizes)) + 1
        own = cls(np.zeros((used, 32), np.uint8), len(leaves), height)
        own.nodes[at[height][: len(leaves)]] = leaves
        for depth in range(height, 0, -1):
            runs = own.runs(depth)
            above = b"".join([hashlib.sha256(run.encode()).digest() for run in runs])
            own.nodes[at[depth - 1][: len(runs)]] = np.frombuffer(above, np.uint8).reshape(-1, 32)
        return own

    def texts(self, depth: int) -> str:
        """Hex digests of all nodes at a depth, left to right."""
        return self.nodes[self.at[depth][: self.counts[depth]]].tobytes().hex()

    def runs(self, depth: int) -> list[str]:
        text, width = self.texts(depth), 64 * ARITY
        return [text[i : i + width] for i in range(0, len(text), width)]

    def steps(self) -> list[list[tuple[int, str]]]:
        """For every leaf: its place in its run and the siblings there, level by level up to the block's root."""
        found: list[list[tuple[int, str]]] = [[]]
        for depth in range(1, self.height + 1):
            own = []
            for i, run in enumerate(self.runs(depth)):
                for place in range(len(run) // 64):
                    own.append([(place, run[: 64 * place] + run[64 * place + 64 :]), *found[i]])
            found = own
        return found


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings on its way lead to."""
    for place, others in steps:
        leaf = digest(others[: 64 * place], leaf, others[64 * place :])
    return leaf


def leaves(docs: DataFrame, id: str, group: str, fields: list[str], tampered: str) -> DataFrame:
    """Stored ``id``, ``grp``, ``leaf`` and ``changed``: the leaf with ``tampered`` lower-cased (A-Z),
    where 3 divides the CRC-32 of the id; elsewhere null."""
    which = fields.index(tampered)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(group).cast("string").alias("grp"),
                       *[F.col(c).cast("string").cast("binary").alias(f"f{i}") for i, c in enumerate(fields)])

    def packed(value: bytes | None) -> bytes:
        return b"-" if value is None else b"%d:%s" % (len(value), value)

    def hashed(batches):
        for batch in batches:
            plain, changed, ids = [], [], batch.column(0).to_pylist()
            for at in range(batch.num_rows):
                parts = [packed(batch.column(i + 2)[at].as_py()) for i in range(len(fields))]
                plain.append(hashlib.sha256(b"".join(parts)).digest())
                if ids[at] is None or zlib.crc32(str(ids[at]).encode()) % 3:
                    changed.append(None)
                else:
                    lowered = batch.column(which + 2)[at].as_py()
                    parts[which] = packed(None if lowered is None else lowered.lower())
                    changed.append(hashlib.sha256(b"".join(parts)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.binary()), pa.array(changed, pa.binary())],
                                             names=["id", "grp", "leaf", "changed"])

    return common.stored(rows.mapInArrow(hashed, "id long, grp string, leaf binary, changed binary"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``pos`` (place within its group, by ``order``) and ``total`` (rows of the group) for stored
    rows, and the largest total.

    Rows are range-partitioned, so a group of any size is spread; a row's place is its place in
    its partition plus the rows of its group in the partitions before.
    """
    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("seq", F.monotonically_increasing_id())
    ordered = common.stored(ordered).withColumn("part", F.shiftright("seq", 33))
    parts = ordered.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("grp")
    parts, n_parts = common.stored_counted(parts.select("grp", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                                                        F.sum("n").over(everywhere).alias("total")))
    most = parts.agg(F.max("total")).first()[0] or 0
    found = common.join_checked(ordered, parts, ["grp", "part"], "inner", n_parts)
    return found.withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "shift"), most


def _blocks(rows: DataFrame, id_type: str) -> DataFrame:
    """Stored blocks of rows with ``grp``, ``pos``, ``total``, ``leaf``, ``id`` and ``changed``."""
    arrow_id = pa.int64() if id_type == "long" else pa.string()

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, total = table.num_rows, table["total"][0].as_py()
        height = HEIGHT if total > BLOCK else levels_needed(total)
        raw = np.frombuffer(b"".join(table["leaf"].to_pylist()), np.uint8).reshape(n, 32)
        block = Block.build(raw, height)
        row = {"grp": [table["grp"][0].as_py()], "block": [table["pos"][0].as_py() // BLOCK], "total": [total], "n": [n], "height": [height],
               "root": [block.nodes[0].tobytes()], "nodes": [block.nodes.tobytes()], "ids": [table["id"].to_pylist()], "changed": [table["changed"].to_pylist()]}
        return pa.table(row, schema=pa.schema([("grp", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("n", pa.int32()), ("height", pa.int32()),
                                               ("root", pa.binary()), ("nodes", pa.binary()), ("ids", pa.list_(arrow_id)), ("changed", pa.list_(pa.binary()))]))

    keyed = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    shape = f"grp string, block long, total long, n int, height int, root binary, nodes binary, ids array<{id_type}>, changed array<binary>"
    return common.stored(keyed.groupBy("grp", "block").applyInArrow(built, shape))


@dataclass(frozen=True)
class Forest:
    """Stored blocks of all groups, lowest level first, and one ``root`` per group."""

    levels: list[DataFrame]
    roots: DataFrame


def forest(rows: DataFrame, order: list[str], id_type: str = "long") -> Forest:
    """Trees of all groups of rows with ``grp``, ``leaf``, ``id`` and ``changed``."""
    own, most = numbered(rows, order)
    levels = [_blocks(own, id_type)]
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = levels[-1].where(F.col("total") > BLOCK).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("root").alias("leaf"),
            F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("binary").alias("changed"))
        levels.append(_blocks(up, id_type))
    tops = [level.where(F.col("total") <= BLOCK).select("grp", "root") for level in levels]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return Forest(levels, roots)


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    out = None
    for k in keys:
        one = left[k].eqNullSafe(right[f"_{k}"])
        out = one if out is None else out & one
    return out


def _with_above(level: DataFrame, above: DataFrame) -> DataFrame:
    keyed = above.withColumnsRenamed({"grp": "_grp", "block": "_block"})
    return level.join(keyed, _same(level, keyed, ["grp", "block"]), "inner").drop("_grp", "_block")


def lowest(trees: Forest, tops: DataFrame) -> DataFrame:
    """The lowest blocks with ``above`` (steps from the block's root to the root of all), ``subroot`` and ``root_of_all``.

    ``tops`` has these per group.
    """
    above = None
    for k in range(len(trees.levels) - 1, -1, -1):
        level = trees.levels[k]
        ends = level.where(F.col("total") <= BLOCK).select("grp", "block").distinct()
        keyed = tops.withColumnRenamed("grp", "_grp")
        own = ends.join(keyed, ends["grp"].eqNullSafe(keyed["_grp"]), "inner").select("grp", "block", "above", "subroot", "root_of_all")
        above = own if above is None else own.unionByName(above)
        if not k:
            return _with_above(level, above)

        def handed(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    block = Block(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["n"], row["height"])
                    upward = [(s["place"], s["others"]) for s in row["above"]]
                    steps = [[{"place": p, "others": o} for p, o in [*x, *upward]] for x in block.steps()]
                    size = row["n"]
                    first = row["block"] * BLOCK
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["grp"]] * size, pa.string()), pa.array(range(first, first + size), pa.int64()),
                         pa.array(steps, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))),
                         pa.array([row["subroot"]] * size, pa.string()), pa.array([row["root_of_all"]] * size, pa.string())],
                        names=["grp", "block", "above", "subroot", "root_of_all"])

        # Blocks of a group that ends at a lower level are not among these, so keys stay unique.
        joined = _with_above(level, above).select("grp", "block", "n", "height", "nodes", "above", "subroot", "root_of_all")
        above = common.stored(joined.mapInArrow(handed, f"grp string, block long, above {STEPS}, subroot string, root_of_all string"))
    return above


def proofs(blocks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per leaf: ``id``, ``leaf``, ``subroot``, ``root``, ``steps``-derived digest of the
    proof, the root folded from the changed (else original) leaf, and whether it is the root."""
    arrow_id = pa.int64() if id_type == "long" else pa.string()

    def rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["n"], row["height"])
                upward = [(s["place"], s["others"]) for s in row["above"]]
                text, size = block.texts(block.height), row["n"]
                found = [text[64 * i : 64 * i + 64] for i in range(size)]
                sums, folded = [], []
                for leaf, changed, own in zip(found, row["changed"], block.steps()):
                    steps = [*own, *upward]
                    sums.append(digest(*[others for _, others in steps]))
                    folded.append(fold(leaf if changed is None else changed.hex(), steps))
                root = row["root_of_all"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], arrow_id), pa.array(found), pa.array([row["subroot"]] * size), pa.array([root] * size),
                     pa.array(sums), pa.array(folded), pa.array([x == root for x in folded])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    own = blocks.select("n", "height", "nodes", "ids", "changed", "above", "subroot", "root_of_all")
    return own.mapInArrow(rows, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, id: str, group: str, fields: list[str], tampered: str) -> DataFrame:
    """Leaf, roots and proof of every row, and its check after tampering."""
    trees = forest(leaves(docs, id, group, fields, tampered), ["id", "leaf"])
    subroots = common.stored(trees.roots.select(F.lit("").alias("grp"), F.col("root").alias("leaf"), F.col("grp").alias("id"),
                                                F.lit(None).cast("binary").alias("changed")))
    whole = forest(subroots, ["id"], "string")
    root = whole.roots.select("grp", F.array().cast(STEPS).alias("above"), F.lower(F.hex("root")).alias("subroot"), F.lower(F.hex("root")).alias("root_of_all"))
    tops = common.stored(_group_steps(lowest(whole, root)))
    return proofs(lowest(trees, tops))


def _group_steps(blocks: DataFrame) -> DataFrame:
    """Per group: its subroot, the steps from there to the root of all, and that root."""

    def rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["n"], row["height"])
                upward = [(s["place"], s["others"]) for s in row["above"]]
                text, size = block.texts(block.height), row["n"]
                steps = [[{"place": p, "others": o} for p, o in [*x, *upward]] for x in block.steps()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.string()), pa.array(steps, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))),
                     pa.array([text[64 * i : 64 * i + 64] for i in range(size)]), pa.array([row["root_of_all"]] * size)],
                    names=["grp", "above", "subroot", "root_of_all"])

    own = blocks.select("n", "height", "nodes", "ids", "above", "root_of_all")
    return own.mapInArrow(rows, f"grp string, above {STEPS}, subroot string, root_of_all string")
