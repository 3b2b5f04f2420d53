"""Merkle manifest of a dataset: rows are leaves, trees of 16 children stand over the leaves of
each source, one tree stands over the sources' roots.

SHA-256 reads its input from left to right, so a parent keeps a copy of its hash state before
each child's slot. To fold a changed child, the matching state is resumed with the replacement
and the siblings to the right only; what stands to the left is not hashed again.

Spark places the leaves (range sort, places from counts) and groups them in blocks of 16 x 16
consecutive ones. A block gives its root to the table of the next two levels, which is 1/256 as
long, and so on up to one node; on the way down each block gets the runs on its path to the
root (at most 16 digests a level). A hash state cannot leave its process, so a task that folds
a block builds the states of the parents above it once, for all of the block's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import maybe_broadcast, stored

FANOUT = 16
#: Nodes that one row of a block table holds: two levels of the tree.
BLOCK = FANOUT**2
#: Largest number of paths (some kilobytes each) that are broadcast.
BROADCAST_PATHS = 2_000

_PATH = "array<struct<slot:int,run:array<string>>>"


class Parent:
    """A run of children (hex digests), its digest, and the hash state before each slot."""

    __slots__ = ("digest", "run", "_before")

    def __init__(self, children: list[bytes]):
        state, self._before = sha256(), []
        for child in children:
            self._before.append(state.copy())
            state.update(child)
        self.run = b"".join(children)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in ``slot``."""
        state = self._before[slot].copy()
        state.update(child)
        state.update(self.run[64 * slot + 64 :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.run[: 64 * slot] + self.run[64 * slot + 64 :]


def levels_over(nodes: list[bytes], n: int) -> list[list[Parent]]:
    """The parents over a block's nodes, level by level. ``n`` is the number of nodes on the
    tree's level: if all are in this block, up to the root, else two levels (even over one)."""
    out: list[list[Parent]] = []
    while (len(out) < 2) if n > BLOCK else len(nodes) > 1:
        out.append([Parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
        nodes = [p.digest for p in out[-1]]
    return out


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (hex) of the columns: each ``-`` if null, else its UTF-8 length, ``:``, value."""
    return F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256)


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``key``) plus ``at``, the place within the key by ``order``, and ``n``, the
    rows of the key. A range sort spreads a key over many tasks; only counts per task and key
    meet in a window, at most one row a task for each key."""
    by = [F.col(c).asc_nulls_first() for c in ["key", *order]]
    there = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    there = stored(there.withColumn("_n", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("_part", F.shiftright("_n", 33))
    starts = there.groupBy("key", "_part").agg(F.min("_n").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("n", F.sum("_rows").over(whole)).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    starts = stored(starts, f"{name}-starts")
    there = there.join(maybe_broadcast(starts, starts.count()), ["key", "_part"])
    return there.withColumn("at", F.col("_n") - F.col("_low") + F.col("_before")).drop("_n", "_part", "_low", "_rows", "_before")


def _blocks(nodes: DataFrame, carry: list[str], name: str) -> DataFrame:
    """(key, block, n, members): the nodes of each 256 places, in order."""
    grouped = nodes.groupBy("key", F.floor(F.col("at") / BLOCK).alias("block"))
    return stored(grouped.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *carry))).alias("members")), name)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as dicts, one at a time: a row holds a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _digests(members: list[dict]) -> list[bytes]:
    return [m["node"].encode() for m in members]


def _roots(blocks: DataFrame) -> DataFrame:
    """The next table of nodes: each block's root, under its block's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for row in _rows(batch.select(["n", "members"])):
                nodes = _digests(row["members"])
                parents = levels_over(nodes, row["n"])
                tops.append((parents[-1][0].digest if parents else nodes[0]).decode())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], pa.array(tops, pa.string()), batch["n"]], names=["key", "at", "node", "n"])

    tops = blocks.mapInArrow(work, "key string, at long, node string, n long")
    return tops.withColumn("n", F.ceil(F.col("n") / BLOCK).cast("long"))


def _paths(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """For each node: ``root`` and ``path``, the runs and slots from it up to the root of its
    key. ``most`` is the largest ``n``; each round takes 1/256 of the nodes of the one before."""
    blocks = _blocks(nodes, ["node"], f"{name}-blocks")
    if most > BLOCK:
        upper = _paths(stored(_roots(blocks), f"{name}-nodes"), -(-most // BLOCK), name)
        upper = upper.withColumnRenamed("at", "block")
        blocks = blocks.join(maybe_broadcast(upper, upper.count(), BROADCAST_PATHS), ["key", "block"])
    else:
        blocks = blocks.withColumn("root", F.lit(None).cast("string")).withColumn("path", F.array().cast(_PATH))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                nodes = _digests(row["members"])
                parents = levels_over(nodes, row["n"])
                root = row["root"] or (parents[-1][0].digest if parents else nodes[0]).decode()
                runs = [[[p.run[i : i + 64].decode() for i in range(0, len(p.run), 64)] for p in level] for level in parents]
                paths = []
                for at in range(len(nodes)):
                    path = []
                    for level in runs:
                        path.append({"slot": at % FANOUT, "run": level[at // FANOUT]})
                        at //= FANOUT
                    paths.append(path + row["path"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]] * len(nodes), pa.string()),
                        pa.array([m["at"] for m in row["members"]], pa.int64()),
                        pa.array([root] * len(nodes), pa.string()),
                        pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))),
                    ],
                    names=["key", "at", "root", "path"],
                )

    return stored(blocks.mapInArrow(work, f"key string, at long, root string, path {_PATH}"), f"{name}-paths")


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    key_col: str = "source",
    presented: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``leaf``, ``subroot`` (of its key), ``root`` (of
    the dataset), ``proof_sha256`` (digest of the siblings from leaf to root), ``folded_root``
    and ``verified``.

    A leaf hashes ``columns`` in order. The leaves of a key ascend by id; keys ascend as UTF-8
    bytes, null first. ``presented`` has other values for some columns, of the rows ``where``
    holds: such a row's leaf is hashed from them, and ``folded_root`` is what it gives with the
    siblings of the manifest. Other rows are folded from their own leaf. ``verified`` says
    whether the folded root is the root.

    A null key is a key of its own; a null id stands first; a null ``where`` is false. Rows with
    one id are ordered by leaf, so results do not depend on the order of the input; equal rows
    are leaves of their own. A key with one row has its leaf for subroot, a dataset with one key
    has the subroot for root. An empty table gives no rows. Other columns are not read.

    Scale: texts are read once and hashed in the JVM; everything else moves digests. No task
    holds more than its part of the sorted leaves and one block of 256; a key with a third of
    the rows is as many blocks as its rows need.
    """
    cols = {c: F.col(c) for c in columns}
    changed = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    other = leaf_hash([(presented or {}).get(c, cols[c]) for c in columns])
    leaves = stored(
        docs.select(
            F.coalesce(F.concat(F.lit("+"), F.col(key_col).cast("string")), F.lit("")).alias("key"),
            F.col(id_col).alias("id"),
            leaf_hash(list(cols.values())).alias("node"),
            F.when(changed, other).alias("other"),
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "leaves",
    )
    placed = stored(_placed(leaves, ["id", "node", "other", "_tie"], "leaves"), "leaves-placed")
    blocks = _blocks(placed, ["id", "node", "other"], "leaf-blocks")
    tops = stored(_roots(blocks), "leaf-nodes")
    paths = _paths(tops, _most(tops), "source")

    subroots = stored(_placed(paths.filter("at = 0").select(F.col("key").alias("source"), F.col("root").alias("node"), F.lit("").alias("key")), ["source"], "sources"), "sources")
    above = _paths(subroots, _most(subroots), "sources").select("at", F.col("root").alias("_root"), F.col("path").alias("_above"))
    above = subroots.select("at", F.col("source").alias("key")).join(above, "at").drop("at")
    above = stored(above, "sources-above")
    paths = paths.withColumnRenamed("at", "block").withColumnRenamed("root", "subroot")
    paths = paths.join(maybe_broadcast(above, above.count(), BROADCAST_PATHS), "key")
    paths = stored(paths.select("key", "block", "subroot", F.col("_root").alias("root"), F.concat("path", "_above").alias("path")), "block-paths")
    whole = blocks.join(maybe_broadcast(paths, paths.count(), BROADCAST_PATHS), ["key", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["members"].values.field("id")
            ends = batch["members"].offsets.to_pylist()
            for at, row in enumerate(_rows(batch)):
                proofs, folded = _fold_block(row)
                n, root = len(folded), row["root"]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(ends[at], n),
                        pa.array([m["node"] for m in row["members"]], pa.string()),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([root] * n, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                        pa.array([f == root for f in folded], pa.bool_()),
                    ],
                    names=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(work, f"`{id_col}` {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _fold_block(row: dict) -> tuple[list[str], list[str]]:
    """Of each leaf of a block: the digest of its siblings up to the root, and the root that its
    presented leaf folds to."""
    nodes = _digests(row["members"])
    inner = levels_over(nodes, row["n"])
    outer = [(Parent([c.encode() for c in step["run"]]), step["slot"]) for step in row["path"]]
    above = b"".join(p.siblings(slot) for p, slot in outer)
    proofs, folded = [], []
    for at, member in enumerate(row["members"]):
        proof = sha256()
        now = member["other"].encode() if member["other"] else nodes[at]
        for level in inner:
            parent, slot = level[at // FANOUT], at % FANOUT
            proof.update(parent.siblings(slot))
            now = parent.fold(slot, now)
            at //= FANOUT
        proof.update(above)
        for parent, slot in outer:
            now = parent.fold(slot, now)
        proofs.append(proof.hexdigest())
        folded.append(now.decode())
    return proofs, folded
