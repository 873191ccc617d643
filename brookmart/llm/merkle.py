"""A Merkle manifest of a table: one digest for all rows, a proof for each.

H is the lower-case hex SHA-256 of its inputs in a row, digests as hex text. A leaf is H of
the row's fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value. In
every group the leaves stand in key order; while several nodes are left, every ``fan``
consecutive ones (the last run may be shorter, down to one) become their H. What is left is
the subroot, for a group of one leaf the leaf itself. The subroots, in group order, make the
root the same way.

Nodes are cut into blocks of ``fan ** BLOCK_LEVELS`` by position, so that a group of any size
is many small tasks; block digests are the nodes of the next tier. Going up stores each
tier's digests, going down gives every block the siblings on its way to the root. A tree of a
block holds SHA-256 midstates: a parent keeps a copy of its hash state before each child
slot, with the children left of it absorbed. Folding a changed leaf resumes the state of its
slot with the replacement and the right siblings only, and goes on to the root; the states
above the block are made once per block and shared by its rows.

Positions come from a range partitioning by (group, key, leaf): rows are numbered within
their partition and group, and partition counts are added up. Null groups come first, then
by UTF-8 bytes; null keys come first in a group; equal keys are ordered by leaf, and equal
rows have equal leaves, so their order changes nothing. Repeated rows are leaves of their
own. An empty table gives an empty result. Fields are named by the caller; other columns are
not read. Very long texts are hashed where they are read and not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmart.llm.common import written

#: Levels that a block spans.
BLOCK_LEVELS = 10

PATH = "array<struct<left: string, right: string>>"


def leaf_digest(values: list[Column]) -> Column:
    """H of the values' texts with their lengths."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


class Block:
    """The tree above some consecutive nodes, ``levels`` high, with its midstates.

    ``states[i][p][s]`` is the hash state of parent ``p`` on level ``i`` + 1 before child slot
    ``s``; ``nodes[i]`` are the digests of level ``i``.
    """

    def __init__(self, digests: list[str], levels: int, fan: int):
        self.fan, self.nodes, self.states = fan, [digests], []
        for _ in range(levels):
            below, above, kept = self.nodes[-1], [], []
            for first in range(0, len(below), fan):
                state, slots = hashlib.sha256(), []
                for digest in below[first:first + fan]:
                    slots.append(state.copy())
                    state.update(digest.encode())
                above.append(state.hexdigest())
                kept.append(slots)
            self.nodes.append(above)
            self.states.append(kept)

    @property
    def top(self) -> str:
        return self.nodes[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Digests left and right of node ``at`` and of its ancestors, level by level."""
        out = []
        for below in self.nodes[:-1]:
            first = at - at % self.fan
            out.append(("".join(below[first:at]), "".join(below[at + 1:first + self.fan])))
            at //= self.fan
        return out

    def fold(self, at: int, digest: str, siblings: list[tuple[str, str]]) -> str:
        """The top with ``digest`` instead of node ``at``: resumed states, right siblings only."""
        for kept, (_, right) in zip(self.states, siblings, strict=True):
            state = kept[at // self.fan][at % self.fan].copy()
            state.update(digest.encode())
            state.update(right.encode())
            digest = state.hexdigest()
            at //= self.fan
        return digest


class Way:
    """From a block's top to the root: a state per level with the left siblings absorbed."""

    def __init__(self, path: list[dict]):
        self.proof = "".join(x["left"] + x["right"] for x in path)
        self.steps = [(hashlib.sha256(x["left"].encode()), x["right"].encode()) for x in path]

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest.encode())
            state.update(right)
            digest = state.hexdigest()
        return digest


def levels_of(n: int, fan: int, most: int = BLOCK_LEVELS) -> int:
    """Levels a block goes up where its tier has ``n`` nodes in the group."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fan), levels + 1
    return levels


def placed(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (``g``, ``key``, ``digest``, more) with ``pos`` in their group and the group's size ``n``.

    ``nodes`` must be stored: the range partitioning samples them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count = None, 0
        for batch in batches:
            local = []
            for g in batch.column("g").to_pylist():
                group, count = (g, count + 1) if g == group else (g, 0)
                local.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])

    order = [F.col(c).asc_nulls_first() for c in ("g", "key", "digest", "tie")]
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    ranked = written(dealt.mapInArrow(run, fields + ", local long"), name)
    # One row for each partition and group in it.
    sizes = ranked.groupBy("g", "part").agg(F.count("*").alias("size"))
    w = Window.partitionBy("g")
    offsets = sizes.select("g", "part", (F.sum("size").over(w.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(w).alias("n"))
    return ranked.join(offsets, ["g", "part"]).withColumn("pos", F.col("local") + F.col("before")).drop("part", "local", "before")


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def _raised(nodes: DataFrame, fan: int, most: int) -> DataFrame:
    """The next tier: ``g``, ``pos``, ``n``, ``digest`` of every block of ``nodes``."""

    def run(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        n = group.column("n")[0].as_py()
        top = Block(group.column("digest").to_pylist(), levels_of(n, fan, most), fan).top
        row = {"g": group.column("g")[0].as_py(), "pos": group.column("block")[0].as_py(), "n": -(-n // fan**most), "digest": top}
        return pa.Table.from_pylist([row], pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    size = fan**most
    return _blocked(nodes, size).select("g", "block", "pos", "n", "digest").groupBy("g", "block").applyInArrow(run, "g string, pos long, n long, digest string")


def _lowered(nodes: DataFrame, ways: DataFrame, fan: int, most: int) -> DataFrame:
    """``ways`` to the root of ``nodes``' blocks (``g``, ``block``, ``path``) handed on to the nodes (``g``, ``block`` = pos)."""

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = _sorted(own)
        tree = Block(own.column("digest").to_pylist(), levels_of(own.column("n")[0].as_py(), fan, most), fan)
        rest = above.column("path")[0].as_py()
        rows = [
            {"g": g, "block": pos, "path": [{"left": a, "right": b} for a, b in tree.siblings(i)] + rest}
            for i, (g, pos) in enumerate(zip(own.column("g").to_pylist(), own.column("pos").to_pylist(), strict=True))
        ]
        sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.Table.from_pylist(rows, pa.schema([("g", pa.string()), ("block", pa.int64()), ("path", sides)]))

    left = _blocked(nodes, fan**most).select("g", "block", "pos", "n", "digest").groupBy("g", "block")
    return left.cogroup(ways.groupBy("g", "block")).applyInArrow(run, f"g string, block long, path {PATH}")


def _tiers(nodes: DataFrame, fan: int, most: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tiers above them; the last holds one node for each group."""
    tiers = [nodes]
    while True:
        tiers.append(written(_raised(tiers[-1], fan, most), f"{name}-tier"))
        if (tiers[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tiers


def manifest(
    docs: DataFrame, fields: list[str], key: str, group: str, replaced: dict[str, Column] | None = None,
    fan: int = 2, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root`` and ``verified``.

    ``replaced`` gives fields of a changed row (an expression equal to the field leaves the row
    as it is); ``folded_root`` is the root with that row instead of the original one.
    ``proof`` holds the siblings' digests from leaf to root, left to right, in a row.
    """
    fresh = [(replaced or {}).get(f, F.col(f)) for f in fields]
    differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(f)) for f, v in (replaced or {}).items()], F.lit(False))
    kind = docs.schema[key].dataType.simpleString()
    leaves = docs.select(
        # No group is before every name, in bytes too.
        F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group))).alias("g"),
        F.col(key).alias("key"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.when(differs, leaf_digest(fresh)).alias("changed"),
    )
    nodes = written(placed(written(leaves, "leaves"), "ranked"), "leaves-placed")
    most = block_levels
    size = fan**most

    inner = _tiers(nodes, fan, most, "group")
    subroots = inner[-1].select("g", "digest")
    outer = _tiers(written(placed(written(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest"), "subroots"), "subroots-ranked"), "subroots-placed"), fan, most, "root")
    top = outer[-1].first()
    root = F.lit(top.digest if top else None).cast("string")

    # Down the tree of groups, then down every group.
    ways = outer[-1].select("g", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"))
    for tier in reversed(outer[1:-1]):
        ways = _lowered(tier, ways, fan, most)
    named = outer[0].select(F.col("pos").alias("block"), F.col("key").alias("name"))
    ways = _lowered(outer[0], ways, fan, most).join(named, "block").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path")
    for tier in reversed(inner[1:-1]):
        ways = _lowered(tier, ways, fan, most)
    ways = written(ways.join(subroots.withColumnRenamed("digest", "subroot"), "g").withColumn("root", root), "ways")

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = _sorted(own)
        digests = own.column("digest").to_pylist()
        tree = Block(digests, levels_of(own.column("n")[0].as_py(), fan, most), fan)
        way = Way(above.column("path")[0].as_py())
        proofs, folded = [], []
        for i, (digest, changed) in enumerate(zip(digests, own.column("changed").to_pylist(), strict=True)):
            siblings = tree.siblings(i)
            proofs.append("".join([x for pair in siblings for x in pair]) + way.proof)
            folded.append(way.fold(tree.fold(i, changed or digest, siblings)))

        def filled(name: str) -> pa.Array:
            return pa.array([above.column(name)[0].as_py()] * len(own), pa.string())

        columns = [own.column("key"), pa.array(digests, pa.string()), filled("subroot"), filled("root"), pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        return pa.Table.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof", "folded_root"])

    blocks = _blocked(nodes, size).select("g", "block", "pos", "n", "key", "digest", "changed")
    done = blocks.groupBy("g", "block").cogroup(ways.groupBy("g", "block")).applyInArrow(
        run, f"key {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    return done.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)
