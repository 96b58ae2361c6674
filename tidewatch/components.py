"""Connected components of a link table by alternating star contractions, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.storage import dropped, stored

MAX_ROUNDS = 60


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), stored: the smallest node of the component of every node that has a link.

    Each round points every node at the smallest of its neighbours, first for larger neighbours,
    then for smaller ones; a round is two aggregations that combine before they shuffle and two
    equi-joins, so a node with very many links is no bottleneck. Ends when nothing changes; each
    round's table is written to the shared folder, where its count and checksum are taken on the way,
    and the one before is deleted.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    edges, state = _written(links.where(F.col(a) != F.col(b)).select(high, low).distinct())
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = up.groupBy("u").agg(F.min("v").alias("m"))
        moved = up.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new = _written(moved.union(down.select("u", F.col("m").alias("v"))).distinct())
        dropped(edges)
        edges, same, state = after, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
    dropped(edges)
    return out


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, stored, with their count and checksum."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])
