"""The trie of all prefixes of conversations, from the sorted conversations.

A turn's role and text become a fixed number of bytes, a conversation the string of its turns'
bytes, its path. Paths are sorted and dealt into blocks by range, with the conversation's id
below, so equal and similar conversations may fill many blocks. Neighbours' longest common
prefixes (LCP) make a Cartesian tree: a node is an interval of the order, bounded on both sides by
the nearest smaller LCP, and equal LCPs in an interval are one node. Inside a block a stack finds
these bounds. Intervals that touch a block's border stay open; a block hands them on as a record,
bounded by its least LCP, with what it knows of each. Records of neighbouring blocks are merged in
rounds of bounded fan-in by the same stack, until one is left; what a round closes, it returns.
Depths between a node and the next LCP above it have the same members and are expanded at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import dropped, joined, stored, table
from tidewatch.session import ship

TURN_BYTES = 16
GROUP, MOST_BORROWED = 100, 6
FAN_IN = 32
ROWS_A_BLOCK = 1 << 16
ENDS_A_ROW = 1 << 10
ROWS_OUT = 1 << 10
NONE = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, top long, depth long, n_convs long, n_children long, n_leaves long, saved array<long>, ends string, key binary, parent_conv_id long, parent_key binary"
RECORD = "block int, first binary, first_lengths array<int>, last binary, last_lengths array<int>, item_depth array<long>, item_n array<long>, item_low array<long>, item_children array<long>, item_leaves array<long>, item_saved array<long>, item_ends array<boolean>, descending int"
ENDS = "place long, ids binary"
OUT = f"kind string, {NODE}, {RECORD}, {ENDS}"
TALLIES = ("depth", "n", "low", "children", "leaves", "saved", "ends")


def node_key(path: bytes, depth: int) -> bytes:
    """A name of the node of this prefix."""
    return hashlib.sha256(path[: depth * TURN_BYTES]).digest()


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN_BYTES
    shared, width = 0, TURN_BYTES
    while a[:width] == b[:width]:
        shared, width = width, 2 * width
    x, y = (np.frombuffer(s[shared : min(width, most)], np.uint8) for s in (a, b))
    return (shared + int(np.flatnonzero(x != y)[0])) // TURN_BYTES


@dataclass
class Node:
    """What is known of an interval whose members share depth turns; path and lengths are a member's."""

    depth: int
    path: bytes
    lengths: np.ndarray
    n: int = 0
    low: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bool = False  # conversations that end here are listed elsewhere, under the node's key
    ids: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)  # rows of children, until the least member is known

    def take(self, other: Node) -> None:
        """Add another part of the same node."""
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends |= other.ends
        self.ids += other.ids


class Stack:
    """Open intervals, the widest at the bottom. Closed nodes become rows; intervals whose left end is
    not known here become items of a record.

    merging: records come in, not conversations. whole: the order starts here, so no left end is unknown.
    """

    def __init__(self, block: int, merging: bool = False, whole: bool = False):
        self.block, self.merging, self.place = block, merging, block << 32
        self.rows: list[dict] = []
        self.items: list[Node] = []
        self.open: list[Node] = [Node(-1, b"", np.empty(0, np.int64))] if whole else []
        self.first = self.last = None

    def cut(self, depth: int) -> None:
        """Close what shares more than depth turns; the node of that depth is on top then."""
        while self.open[-1].depth > depth:
            node = self.open.pop()
            if not self.open:
                self._hand_on(node)
                self.open.append(Node(depth, node.path, node.lengths))
                return
            if self.open[-1].depth < depth:
                self.open.append(Node(depth, node.path, node.lengths))
            self._close(node, self.open[-1])

    def push(self, node: Node) -> None:
        """Put a part on top: of the top's own node, or of one below it in the tree."""
        if self.open and self.open[-1].depth == node.depth:
            self.open[-1].take(node)
        else:
            self.open.append(node)

    def conversation(self, conv_id: int, path: bytes, lengths: np.ndarray) -> None:
        if self.last is None:
            self.first = (path, lengths)
        else:
            self.cut(common_turns(self.last[0], path))
        self.last = (path, lengths)
        self.push(Node(len(path) // TURN_BYTES, path, lengths, 1, conv_id, ids=[conv_id]))

    def record(self, block: dict) -> None:
        """Append the record of the next block."""
        first, last = ((block[k], np.array(block[f"{k}_lengths"], np.int64)) for k in ("first", "last"))
        if self.last is None:
            self.first = first
        else:
            self.cut(common_turns(self.last[0], first[0]))
        self.last = last
        for i, tallies in enumerate(zip(*(block[f"item_{k}"] for k in TALLIES), strict=True)):
            member = first if i < block["descending"] else last
            depth, *rest = tallies
            if i and i <= block["descending"]:
                self.cut(depth)
            self.push(Node(depth, *member, *rest))

    def _close(self, node: Node, parent: Node) -> None:
        """Turn a whole node into a row and add it to its parent."""
        node.leaves = node.leaves or 1
        per_depth = (node.n - 1) * node.lengths[parent.depth if parent.depth > 0 else 0 : node.depth]
        saved = node.saved + np.cumsum(per_depth[::-1])[::-1]
        if parent.depth < 0:  # the root has no text
            saved = np.r_[saved[0] if len(saved) else node.saved, saved]
        row = {"conv_id": node.low, "top": parent.depth + 1, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved": saved.tolist(), "kind": "node"}
        row["ends"] = None if node.ends else hashlib.sha256(_joined_ids(node.ids)).hexdigest()
        row["key"] = node_key(node.path, node.depth) if self.merging else None
        self.rows += [child | {"parent_conv_id": node.low} for child in node.waiting]
        parent.children += 1
        parent.n += node.n
        parent.low = node.low if parent.low is None else min(parent.low, node.low)
        parent.leaves += node.leaves
        parent.saved += int(saved[0])
        parent.waiting.append(row)

    def _hand_on(self, node: Node) -> None:
        """Keep an interval for the record; its children and ends wait for its least member under its key."""
        key = node_key(node.path, node.depth)
        self.rows += [child | {"parent_key": key} for child in node.waiting]
        for at in range(0, len(node.ids), ENDS_A_ROW):
            self.rows.append({"kind": "ends", "key": key, "place": self.place, "ids": _joined_ids(node.ids[at : at + ENDS_A_ROW])})
            self.place += 1
            node.ends = True
        self.items.append(node)

    def finished(self) -> None:
        """Make a record of everything still open."""
        if self.last is None:
            return
        descending = len(self.items)
        for node in self.open:
            self._hand_on(node)
        out = {"kind": "record", "block": self.block, "descending": descending}
        for name, (path, lengths) in (("first", self.first), ("last", self.last)):
            out |= {name: path, f"{name}_lengths": lengths.tolist()}
        self.rows.append(out | {f"item_{k}": [getattr(node, k) for node in self.items] for k in TALLIES})

    def closed(self) -> None:
        """The order ends here: close all."""
        self.cut(-1)
        self.rows += self.open[0].waiting


def _joined_ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _fields() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in OUT.split(", "))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and the record of a block: conv_id, path and lengths in order."""
    stack, schema = Stack(TaskContext.get().partitionId()), _fields()
    for batch in batches:
        for conv_id, path, lengths in zip(*batch.columns, strict=True):
            stack.conversation(conv_id.as_py(), path.as_py(), np.array(lengths.as_py(), np.int64))
        if len(stack.rows) >= ROWS_OUT:
            yield from pa.Table.from_pylist(stack.rows, schema).to_batches(ROWS_OUT)
            stack.rows = []
    stack.finished()
    yield from pa.Table.from_pylist(stack.rows, schema).to_batches(ROWS_OUT)


def _merged(whole: bool) -> Callable[[pa.Table], pa.Table]:
    """Rows that a group of neighbouring records closes, and their one record; whole: all there are."""

    def run(group: pa.Table) -> pa.Table:
        stack = Stack(group.column("group")[0].as_py(), merging=True, whole=whole)
        for block in group.sort_by("block").to_pylist():
            stack.record(block)
        if whole:
            stack.closed()
        else:
            stack.finished()
        return pa.Table.from_pylist(stack.rows, _fields())

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of lists of ids that come in pieces, in order: one running hash, whatever the length."""
    key, running, done = None, None, []
    for batch in batches:
        for new, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if new == key:
                running.update(b",")
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = new, hashlib.sha256()
            running.update(ids)
    if key is not None:
        done.append((key, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["key", "ends"])


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each a name of role and text and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN_BYTES)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), name.alias("name"), F.char_length(text).alias("length")).alias("t"))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    """Nulls first, then by turn; turns of one number by their name."""
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    x, y = a["turn"], b["turn"]
    by_name = order(a["name"], b["name"])
    return F.when(x.isNull() & y.isNull(), by_name).when(x.isNull(), -1).when(y.isNull(), 1).when(x == y, by_name).otherwise(order(x, y))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, lengths): every conversation c with its first h turns replaced by those of conversation
    c - c % 100, h = crc32(decimal c) % 6."""
    own = gathered(turns)
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_BORROWED).cast("int")
    lenders = gathered(turns.where(f"conv_id % {GROUP} = 0")).select(F.col("conv_id").alias("lender"), F.slice("turns", 1, MOST_BORROWED).alias("lent"))
    met = own.withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP).join(lenders, "lender", "left").withColumn("h", h)
    none = F.array().cast(own.schema["turns"].dataType)
    lent = F.when(F.col("h") > 0, F.coalesce(F.slice("lent", F.lit(1), F.col("h")), none)).otherwise(none)
    kept = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = met.select("conv_id", F.concat(lent, kept).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.name", "")).alias("path"), F.col("turns.length").alias("lengths"))


def prefix_trie(conversations: DataFrame, rows_a_block: int = ROWS_A_BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """The nodes of the trie of conversations (conv_id long, path binary, lengths array<int>), one row each:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. conv_ids are distinct and not null; equal paths are members of the same nodes, in any
    number; an empty path is a member of the root alone; no conversation gives no node. A path stands in
    one row and in one record of each block that starts or ends with it.
    """
    spark = conversations.sparkSession
    ship(spark)
    state = stored(conversations.select("conv_id", "path", "lengths"), "paths")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-state.count() // rows_a_block))
    order = state.repartitionByRange(blocks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = [stored(order.mapInArrow(_blocks, OUT), "trie")]
    blocks = 1 + (parts[0].where("kind = 'record'").agg(F.max("block")).first()[0] or 0)
    while True:
        whole = blocks <= fan_in
        records = parts[-1].where("kind = 'record'").select(*(c.split()[0] for c in RECORD.split(", ")), (F.col("block") / fan_in).cast("int").alias("group"))
        parts.append(stored(records.groupBy("group").applyInArrow(_merged(whole), OUT), "trie"))
        blocks = -(-blocks // fan_in)
        if whole:
            break
    dropped(state)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    nodes = rows.where("kind = 'node'").select(*(c.split()[0] for c in NODE.split(", ")))
    lists = rows.where("kind = 'ends'").select("key", "ids", "place").repartition("key").sortWithinPartitions("key", "place")
    hashes = lists.select("key", "ids").mapInArrow(_hashed, "key binary, ends string")
    listed = nodes.where("ends IS NULL").drop("ends").join(hashes, "key").select(*nodes.columns)
    nodes = nodes.where("ends IS NOT NULL").union(listed)
    waiting = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id")
    parents = rows.where("kind = 'node' AND key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    found = joined(waiting, parents, ["parent_key"], "size", rows.where("parent_key IS NOT NULL").count()).select(*nodes.columns)
    nodes = nodes.where("parent_key IS NULL").union(found)
    each = nodes.select("*", F.posexplode("saved").alias("below", "saved_tokens")).withColumn("at", F.col("top") + F.col("below"))
    deepest = F.col("at") == F.col("depth")
    return each.select(
        "conv_id",
        F.col("at").alias("depth"),
        F.when(F.col("below") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(deepest, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(deepest, F.col("ends")).otherwise(NONE).alias("ends_sha256"),
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    Turns of one conversation that share a number, or have none, are ordered by role and text through
    their names; null role and text are empty; rows with a null conv_id take no part; repeated rows are
    turns each; other columns are not read; an empty table gives no node.
    """
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
