"""Classes of linked nodes through an inverted index, without comparing all members of a posting.

Members of a posting first meet its pivot alone: the member that shares most postings with others,
in a group of near copies the text that they were made from. What these links join needs no further
comparison. Members of a posting that still lie in different classes are then compared pair by pair
inside the join, where only pairs that pass the cheap test leave it, so no link between different
classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected
from tidewatch.llm.shared import dropped, joined, stored

End = Callable[[str], Column]


def every(pairs: DataFrame) -> DataFrame:
    """The links among pairs that passed the cheap test, where that test is the whole rule."""
    return pairs.select("a", "b")


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle: the sizes of compressed tables of postings would have them broadcast, and the driver
    builds what it broadcasts."""
    return df.hint("merge")


@dataclass(frozen=True)
class Rule:
    """Which nodes are linked.

    attributes: columns of nodes that near() reads; near: the cheap test of two ends, true for every
    link; sure: true where near() settles it; verified: the links (a, b) among pairs (a, b) that
    are not sure; prepared: called with the nodes (node) that share a posting, before any pair is made.
    """

    attributes: tuple[str, ...]
    near: Callable[[End, End], Column]
    sure: Callable[[End, End], Column] = lambda x, y: F.lit(True)
    verified: Callable[[DataFrame], DataFrame] = every
    prepared: Callable[[DataFrame], None] = lambda nodes: None

    def links(self, met: DataFrame) -> DataFrame:
        """(a, b), stored: the links among rows with the columns x and y, structs of node and attributes."""
        x, y = (lambda name, end=end: F.col(f"{end}.{name}") for end in "xy")
        low, high = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
        pairs = stored(met.select(low.alias("a"), high.alias("b"), self.sure(x, y).alias("sure")).distinct(), "pairs")
        if self.verified is every:
            return pairs
        found = stored(self.verified(pairs.where("NOT sure").select("a", "b")).union(pairs.where("sure").select("a", "b")), "links")
        dropped(pairs)
        return found


def classes(nodes: DataFrame, keys: Column, rule: Rule) -> DataFrame:
    """(node, root): the classes that links between members of a posting join; nodes without a link are left out.

    nodes has one row of each node, a long that is not null, with the rule's attributes. keys: an array
    of structs (slot, key) of a node, each slot once, in the same order for all nodes; some may have only the
    first of them. An empty table gives no rows.
    """
    light = nodes.select("node", F.explode(keys).alias("k")).select("k.slot", "k.key", "node")
    shared = light.groupBy("slot", "key").agg(F.count("*").alias("members")).where("members > 1")
    meeting = stored(light.join(shuffled(shared), ["slot", "key"]), "meeting")
    weights = meeting.groupBy("node").agg(F.sum("members").alias("weight"))
    rule.prepared(weights.select("node"))
    member = F.struct("node", *rule.attributes)
    known = weights.join(shuffled(nodes.select("node", member.alias("member"))), "node")
    index = stored(meeting.select("slot", "key", "node").join(shuffled(known), "node").select("slot", "key", "member", "weight"), "index")
    dropped(meeting)
    pivots = index.groupBy("slot", "key").agg(F.max_by("member", F.struct("weight", "member.node")).alias("y"))
    x, y = (lambda name, end=end: F.col(f"{end}.{name}") for end in "xy")
    stars = index.withColumnRenamed("member", "x").join(shuffled(pivots), ["slot", "key"]).where((F.col("x.node") != F.col("y.node")) & rule.near(x, y))
    first = rule.links(stars.select("x", "y"))
    roots = connected(first)
    names = roots.select(F.col("node").alias("named"), "root")
    labelled = index.join(shuffled(names), F.col("member.node") == F.col("named"), "left").select("slot", "key", "member", F.coalesce("root", "member.node").alias("root"))
    labelled = stored(labelled, "labelled")
    dropped(index)
    mixed = labelled.groupBy("slot", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("slot", "key")
    rows = stored(labelled.join(shuffled(mixed), ["slot", "key"]), "open")
    if rule.verified is every:
        once, rows_of = F.lit(True), rows
    else:  # a pair of many common postings leaves the join in the first alone
        slots = nodes.select(F.col("node").alias("named"), F.transform(keys, lambda k: k["slot"]).alias("slots"), F.transform(keys, lambda k: k["key"]).alias("keys"))
        rows_of = rows.join(slots, F.col("member.node") == F.col("named"))
        equal = F.zip_with("x_keys", "y_keys", lambda a, b: a == b)
        once = F.get("x_slots", (F.array_position(equal, True) - 1).cast("int")) == F.col("slot")
    names = [c for c in ("root", "keys", "slots") if c in rows_of.columns]
    left, right = (rows_of.select("slot", "key", F.col("member").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names]) for end in "xy")
    met = left.join(shuffled(right), ["slot", "key"]).where((F.col("x_root") < F.col("y_root")) & rule.near(x, y) & once)
    rest = rule.links(met.select("x", "y"))
    dropped(labelled, rows)
    if rest.isEmpty():
        dropped(first, rest)
        return roots
    out = connected(first.select("a", "b").union(rest.select("a", "b")))
    dropped(first, rest, roots)
    return out


def with_smallest_id(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node, low and others) with component_id, the smallest low of a node's class; nulls count last."""
    rooted = stored(roots.join(shuffled(nodes.select("node", "low")), "node").select("node", "root", "low"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("members")), "least")
    named = joined(rooted, least, ["root"], "members", rooted.count()).select("node", "least")
    return nodes.join(shuffled(named), "node", "left").withColumn("component_id", F.coalesce("least", "low")).drop("least")
