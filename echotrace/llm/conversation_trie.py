"""Prefix trie of conversations: a node for every distinct sequence of first turns.

A turn is 16 bytes of SHA-256 over role and text and its number of code points, so texts don't move. Conversations are arrays of
turns; they are sorted by them over all partitions (by range, equal arrays by conv_id, so that one frequent conversation
is dealt to many partitions). In that order the conversations below a node stand together, and what two neighbours share
is their longest common prefix. A partition sweeps its rows with a stack of open nodes, one for each turn of the last row: a row
closes the nodes deeper than what it shares with the row before and opens its own. A closed node gives its numbers
to the node above it, and the nodes that close make the table.

Nodes on the path of a partition's first or last row may go on in its neighbours. They leave the sweep as they are, with what was
closed below them; one more sweep over these few rows (two paths for each partition) joins the stacks over the borders: it
pops what the next partition's first row doesn't share, adds up nodes that go on, and pushes the path of its last row.

What a sweep holds are its stack and, for open nodes, children that wait for their parent's conv_id and ids that end there, up to
MOST of each; more of them leave at once under the parent's key and are joined later, ids hashed in order in one stream for
each node, as one hash covers them all.

Defined results: rows without conv_id belong to no conversation and are left out; rows of one turn stand in the order of their digests;
null roles and texts are empty; repeated rows are turns of their own; an empty table has no node; other columns are ignored. A
conversation is one array of 30 bytes for each turn and has to fit into a row (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import broadcast_if_small, stored

#: Children, and ids, that an open node holds in a sweep.
MOST = 10_000
_NUMBERS = "depth n_convs n_children n_leaves saved size conv_id parent_conv_id".split()
#: kind: node; left or right (an open node on the path of the first or last row); end (an id that ends at a node); name (the conv_id of a node's key).
_SWEPT = ", ".join(["kind string", "part int", "key long", "parent_key long", *(f"{c} long" for c in _NUMBERS), "turn binary", "ends string"])
_FIELDS = [x.split()[0] for x in _SWEPT.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in _SWEPT.split(", "))])
_NOTHING = hashlib.sha256().hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (digest, size) in the order of turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(whole, 1, 32)).alias("digest"), F.length(text).alias("size")
        ).alias("t"),
    )
    order = F.sort_array(F.collect_list("t"))  # nulls first
    return rows.groupBy("conv_id").agg(F.transform(order, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(arrays: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id and turns: the first h turns of the group's first conversation, then the own ones after the first h; h is crc32 of the id modulo `most`.

    Of the group's first conversations at most five turns are joined.
    """
    group_of = lambda c: (c - c % group).alias("_group")
    heads = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_group"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = arrays.select("conv_id", "turns", group_of(F.col("conv_id")), h.alias("_h"))
    joined = rows.join(broadcast_if_small(heads), "_group", "left")
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", F.lit(1), F.col("_h")), own)).alias("turns"))


class _Node:
    """An open node: what was closed below it and what ends there."""

    __slots__ = ("key", "turn", "size", "n", "conv_id", "children", "leaves", "saved", "ends", "late", "left", "waiting", "named")

    def __init__(self, key: int, turn: bytes, size: int, left: bool = False):
        self.key, self.turn, self.size, self.left = key, turn, size, left
        self.n, self.conv_id, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.late, self.waiting, self.named = [], False, [], False

    def include(self, n: int, conv_id: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id

    def closed(self) -> tuple[int, int]:
        """Leaves and savings of the whole subtree."""
        return self.leaves if self.children else 1, self.saved + (self.n - 1) * self.size


class _Out:
    """Rows of the swept table, as record batches."""

    def __init__(self, part: int):
        self.part, self.rows = part, []

    def record(self, kind: str, node: _Node | None = None, **values) -> dict:
        row = dict.fromkeys(_FIELDS) | {"kind": kind, "part": self.part} | values
        if node is not None:
            row |= {"key": node.key, "size": node.size, "n_convs": node.n, "n_children": node.children, "conv_id": node.conv_id, "turn": node.turn}
        return row

    def add(self, kind: str, node: _Node | None = None, **values) -> None:
        self.rows.append(self.record(kind, node, **values))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Sweep:
    """The stack of one partition."""

    def __init__(self, part: int, most: int):
        self.out, self.most, self.keys = _Out(part), most, part << 36
        self.stack: list[_Node] = []
        self.left: list[tuple[int, _Node]] = []

    def _open(self, turn: bytes, size: int, left: bool) -> None:
        self.stack.append(_Node(self.keys, turn, size, left))
        self.keys += 1

    def _let_go(self, node: _Node) -> None:
        """Children that wait leave under the node's key."""
        node.named = True
        self.out.rows += node.waiting
        node.waiting = []

    def _let_ends_go(self, node: _Node) -> None:
        node.late = True
        for conv_id in node.ends:
            self.out.add("end", key=node.key, conv_id=conv_id)
        node.ends = []

    def _close(self) -> None:
        """Takes the deepest open node off the stack."""
        node, depth = self.stack.pop(), len(self.stack)
        if node.left:
            self._let_go(node)
            self._let_ends_go(node)
            self.left.append((depth, node))
            return
        leaves, saved = node.closed()
        above = self.stack[-1]
        above.include(node.n, node.conv_id, 1, leaves, saved)
        for row in node.waiting:
            row["parent_conv_id"] = node.conv_id
        self.out.rows += node.waiting
        if node.named:
            self.out.add("name", key=node.key, conv_id=node.conv_id)
        ends = None if node.late else _digest(node.ends)
        above.waiting.append(self.out.record("node", node, depth=depth, parent_key=above.key, n_leaves=leaves, saved=saved, ends=ends))
        if len(above.waiting) > self.most or above.named:
            self._let_go(above)

    def row(self, conv_id: int, turns: list[bytes], sizes: list[int]) -> None:
        first = not self.stack
        if first:
            self._open(b"", 0, True)
        shared, most = 0, min(len(turns), len(self.stack) - 1)
        while shared < most and self.stack[shared + 1].turn == turns[shared]:
            shared += 1
        while len(self.stack) > shared + 1:
            self._close()
        for turn, size in zip(turns[shared:], sizes[shared:], strict=True):
            self._open(turn, size, first)
        top = self.stack[-1]
        top.include(1, conv_id, 0, 0, 0)
        top.ends.append(conv_id)
        if top.late or len(top.ends) > self.most:
            self._let_ends_go(top)

    def finish(self) -> None:
        """The two open paths leave: first the nodes that only the first row's path has, then those that are still open."""
        both = sum(node.left for node in self.stack)
        # The path of the first row: what is still open of it, and what was closed of it, by depth.
        for depth, node in [*enumerate(self.stack[:both]), *reversed(self.left)]:
            self._leave("left", depth, node)
        for depth, node in enumerate(self.stack[both:], both):
            self._leave("right", depth, node)

    def _leave(self, kind: str, depth: int, node: _Node) -> None:
        self._let_go(node)
        self._let_ends_go(node)
        self.out.add(kind, node, depth=depth, n_leaves=node.leaves, saved=node.saved)


def _sweeper(most: int):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(TaskContext.get().partitionId(), most)
        for batch in batches:
            for conv_id, turns, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.row(conv_id, turns, sizes)
                if len(state.out.rows) >= 4096:
                    yield state.out.batch()
        if state.stack:
            state.finish()
            yield state.out.batch()

    return sweep


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open paths of all partitions in order, to whole nodes: kind name gives each path node's key the whole node's key and its conv_id."""
    out, stack, members, part = _Out(-1), [], [], None
    still_left = True

    def close() -> None:
        node, depth, keys = stack.pop(), len(stack), members.pop()
        leaves, saved = node.closed()
        if stack:
            stack[-1].include(node.n, node.conv_id, 1, leaves, saved)
        for key in keys:
            out.add("name", key=key, parent_key=node.key, conv_id=node.conv_id)
        out.add("node", node, depth=depth, parent_key=stack[-1].key if stack else None, n_leaves=leaves, saved=saved)

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if r["part"] != part:
                part, still_left = r["part"], True
            if r["kind"] == "left" and still_left and depth < len(stack) and stack[depth].turn == r["turn"]:
                node = stack[depth]  # it goes on
            else:
                # The first node that doesn't go on closes all from there, and so does the first one of the last row's path.
                while len(stack) > depth:
                    close()
                still_left = False
                node = _Node(r["key"], r["turn"], r["size"])
                stack.append(node)
                members.append([])
            node.include(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"])
            members[depth].append(r["key"])
        if len(out.rows) >= 4096:
            yield out.batch()
    while stack:
        close()
    if out.rows:
        yield out.batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and ends: one hash over the ids of each key, which come in order."""
    at, digest, keys, found = None, None, [], []
    for batch in batches:
        for key, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if at is not None:
                    keys.append(at)
                    found.append(digest.hexdigest())
                at, digest = key, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
    if at is not None:
        keys.append(at)
        found.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "ends"])


def prefix_trie(arrays: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node; arrays: conv_id, turns."""
    at = lambda name: F.transform("turns", lambda t: t[name])
    rows = arrays.select("conv_id", at("digest").alias("digests"), at("size").alias("sizes"))
    ranged = rows.repartitionByRange("digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    swept = stored(ranged.mapInArrow(_sweeper(most), _SWEPT), "swept")
    # Two paths for each partition: left before right, from the root on.
    paths = swept.where(F.col("kind").isin("left", "right")).repartition(1).sortWithinPartitions("part", "kind", "depth")
    stitched = stored(paths.mapInArrow(_stitch, _SWEPT), "stitched")
    whole = stitched.where("kind = 'name'").select("key", F.col("parent_key").alias("_whole"), F.col("conv_id").alias("_name"))
    names = stored(whole.unionByName(swept.where("kind = 'name'").select("key", F.col("key").alias("_whole"), F.col("conv_id").alias("_name"))), "names")
    ids = swept.where("kind = 'end'").select("key", "conv_id").join(broadcast_if_small(names.select("key", "_whole")), "key", "left")
    ids = ids.select(F.coalesce("_whole", "key").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = stored(ids.mapInArrow(_ends, "key long, ends string"), "ends")
    nodes = swept.where("kind = 'node'").unionByName(stitched.where("kind = 'node'"))
    parents = names.select(F.col("key").alias("parent_key"), "_name")
    late = ends.select("key", F.col("ends").alias("_late"))
    nodes = nodes.join(broadcast_if_small(parents), "parent_key", "left").join(broadcast_if_small(late), "key", "left")
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "_name").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", "_late", F.lit(_NOTHING)).alias("ends_sha256"),
    )
