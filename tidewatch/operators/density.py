"""Clusters of density: mutual reachability, a minimum spanning tree, a condensed tree.

A row's core distance is that to its least-th nearest other row; the mutual reachability of two rows is the
largest of their core distances and their own distance. The minimum spanning tree of these is that of the pairs
of neighbours which gave the core distances and of what else may shorten it, found in one search in cells
around pivots. Cutting the tree from its longest edge down makes the hierarchy; parts of fewer than least rows fall out as noise, and of nested clusters those are chosen that live longest.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.components import connected
from tidewatch.operators.cells import PART, Cells, Joined, cells_of, close_pairs, distance, matrix, nearest_in, tiles
from tidewatch.session import ship
from tidewatch.storage import dropped, stored

LEAST = 10
EDGE = "a long, b long, weight double"
#: Rows of a cell, a block and a part: larger than elsewhere, so that rows travel less often.
WIDE = 131_072


def neighbours(cells: Cells, rows: DataFrame, least: int, part: int = PART) -> DataFrame:
    """(id, neighbour, score): the least nearest other rows of rows (id, vec)."""
    return nearest_in(cells, rows.select("id", "vec", F.lit(None).cast("double").alias("extra")), least, -1.0, True, part)


def core_distances(cells: Cells, rows: DataFrame, least: int, found: DataFrame | None = None) -> DataFrame:
    """(id, core): the distance of rows (id, vec) to their least-th nearest other row; infinite where there are fewer.

    found: neighbours() of the rows, if known."""
    found = (neighbours(cells, rows, least) if found is None else found).groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    core = F.when(F.col("n") >= least, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))).otherwise(F.lit(float("inf")))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce(F.when(F.col("n").isNotNull(), core), F.lit(float("inf"))).alias("core"))


#: Edges of a task that keeps their shortest forest, at least, and those that a search holds before it does so.
EDGES = 4_000_000


def shortest_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest; of equal weights the edge with the smaller ends goes first."""
    order = np.lexsort((b, a, weight))
    nodes, ends = np.unique(np.r_[a[order], b[order]], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    left, sets, taken = np.arange(len(a)), Joined(len(nodes)), []
    while True:
        of_x, of_y = sets.set_of[x[left]], sets.set_of[y[left]]
        apart = of_x != of_y
        left, of_x, of_y = left[apart], of_x[apart], of_y[apart]
        if not len(left):
            return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, of_x, left)
        np.minimum.at(first, of_y, left)
        found = np.unique(first[first < len(a)])
        taken.append(found)
        sets.add(x[found], y[found])


def _edges(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(weight, pa.float64())], names=["a", "b", "weight"])


def _forest_of_part(edges: pa.Table) -> pa.Table:
    kept = shortest_forest(*(edges.column(c).to_numpy() for c in ("a", "b", "weight")))
    return edges.select(["a", "b", "weight"]).take(pa.array(kept))


def forest(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b, weight), stored: a minimum spanning forest of edges between so many rows.

    An edge that a part's forest leaves out is in no forest of the whole. Parts have twice as many edges as there are
    rows, so each round halves them; the last part holds three numbers for each of them.
    """
    edges = stored(edges, "edges")
    while True:
        parts = max(1, edges.count() // max(2 * rows, EDGES))
        dealt = edges.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts)))
        kept = stored(dealt.groupBy("part").applyInArrow(_forest_of_part, EDGE), "edges")
        dropped(edges)
        edges = kept
        if parts == 1:
            return edges


def _levels(tree: pa.Table) -> pa.Table:
    """(id, level, branch, inner) of the ends of a forest; see spanning_tree().

    Of a tree's two parts at its longest edge the larger one is followed, and again, down to one row: what falls off at an edge is a
    branch, and the edge its rows' level. inner is the same within the branch. Rows of other than the largest tree have an
    infinite level and the branch of their tree.
    """
    a, b, weight = (tree.column(c).to_numpy() for c in ("a", "b", "weight"))
    ids, ends = np.unique(np.r_[a, b], return_inverse=True)
    n, order = len(ids), np.argsort(weight, kind="stable")
    x, y, weight = ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist(), weight[order]
    parent, size, kids = list(range(n + len(a))), [1] * n, []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in range(len(a)):
        p, q = find(x[k]), find(y[k])
        parent[p] = parent[q] = n + k
        kids.append((p, q) if size[p] >= size[q] else (q, p))
        size.append(size[p] + size[q])
    level, inner, branch = np.full(n, np.inf), np.zeros(n), np.full(n, -1)

    def below(node: int) -> list[int]:
        rows, work = [], [node]
        while work:
            i = work.pop()
            if i < n:
                rows.append(i)
            else:
                work += kids[i - n]
        return rows

    def fallen(node: int):
        while node >= n:
            at = weight[node - n]
            node, off = kids[node - n]
            yield off, at

    tops = sorted((i for i in range(n + len(a)) if parent[i] == i), key=lambda i: -size[i])
    branches = [(top, np.inf) for top in tops[1:]]
    for top in tops[:1]:
        level[below(top)] = 0.0
        branches += fallen(top)
    for number, (top, at) in enumerate(branches):
        rows = below(top)
        level[rows], branch[rows] = at, number
        for off, within in fallen(top):
            inner[below(off)] = within
    return pa.table([pa.array(ids), pa.array(level), pa.array(branch), pa.array(inner)], names=["id", "level", "branch", "inner"])


def _shorter(d: int):
    """A minimum spanning forest of the pairs that may shorten the way between their ends."""

    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        if not visitors.num_rows or not members.num_rows:
            return _edges(*[np.zeros(0)] * 3)
        own, ids = visitors.column("id").to_numpy(), members.column("id").to_numpy()
        x, y = matrix(visitors.column("vec"), d), matrix(members.column("vec"), d)
        (core, other), (branch, theirs), (inner, within) = ([t.column(c).to_numpy() for t in (visitors, members)] for c in ("core", "branch", "inner"))
        level = visitors.column("bound").to_numpy()
        floor = np.where(level < 2, 1 - np.minimum(level, 2) ** 2 / 2 - 2e-6, -2.0)
        single = x.astype(np.float32), y.astype(np.float32)
        held, many = [], 0

        def reduced() -> list[tuple[np.ndarray, ...]]:
            if not held:
                return []
            a, b, weight = (np.concatenate(column) for column in zip(*held, strict=True))
            kept = shortest_forest(a, b, weight)
            return [(a[kept], b[kept], weight[kept])]

        for r, c in tiles(len(own), len(ids)):
            i, j, cosine = close_pairs(x, y, single, r, c, floor)
            weight = np.maximum(distance(np.round(cosine, 6)), np.maximum(core[i], other[j]))
            same = branch[i] == theirs[j]
            fit = (own[i] != ids[j]) & (weight < np.where(same, np.minimum(level[i], np.maximum(inner[i], within[j])), level[i]))
            i, j = own[i[fit]], ids[j[fit]]
            held.append((np.minimum(i, j), np.maximum(i, j), weight[fit]))
            many += len(i)
            if many > EDGES:
                held, many = reduced(), 0
        return _edges(*(reduced() or [[np.zeros(0)] * 3])[0])

    return run


def near_edges(points: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, weight): pairs (id, neighbour, score) of points (id, core) with their mutual reachability."""
    core = points.select("id", "core")
    both = found.join(core, "id").join(core.select(F.col("id").alias("neighbour"), F.col("core").alias("other")), "neighbour")
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))
    return both.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.greatest(far, "core", "other").alias("weight")).distinct()


def spanning_tree(cells: Cells, points: DataFrame, part: int = PART, found: DataFrame | None = None) -> DataFrame:
    """(a, b, weight), stored: a minimum spanning forest of points (id, vec, core) under mutual reachability.

    found: the neighbours (id, neighbour, score) that gave the core distances. Their forest comes first. The longest edge on its way
    from a row to its densest part is the row's level, and the way between two rows has no longer edge than the larger of their
    levels. Two rows that are not each other's neighbours lie no nearer than their core distances, so their edge can
    shorten a way only if one of them has a level above its core distance: those rows alone look for others within their
    level, once. Rows of one branch are compared by the longest edge within it. Tasks send the forest of what they find.
    Without found all rows look everywhere. Rows with an infinite core distance stay alone.
    """
    points = stored(points.where(F.col("core") < float("inf")), "points")
    rows, tree = points.count(), None
    levels = points.select("id", "core").withColumns({"level": F.lit(float("inf")), "branch": F.lit(-1).cast("long"), "inner": F.lit(float("inf"))})
    if found is not None:
        tree = forest(near_edges(points, found), rows)
        known = tree.groupBy(F.lit(0).alias("all")).applyInArrow(_levels, "id long, level double, branch long, inner double")
        levels = stored(points.select("id", "core").join(known, "id"), "levels")
    padded = replace(cells, rows=cells.rows.join(levels.drop("level"), "id"))
    loose = levels.where("level > core").select("id", F.col("level").alias("bound"))
    asked = points.select("id", "vec", F.lit(None).cast("double").alias("extra")).join(loose, "id")
    visits = stored(padded.visits(asked, lambda extra, bound: np.minimum(bound, 2.0)).join(levels.drop("level"), "id"), "visits")
    more = padded.meet(visits, _shorter(cells.pivots.shape[1]), EDGE, part, ("core", "branch", "inner"))
    out = forest(more if tree is None else tree.union(more), rows)
    dropped(points, tree, levels, visits)
    return out


def condensed(ids: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Cluster (the smallest id of a member) of every id, -1 for noise, from the edges of one tree.

    A part that loses fewer than least rows goes on as the same cluster, one that falls into two or more of least
    rows ends, and these begin. A cluster's stability is the sum over its rows of 1/weight where they left it less 1/weight where
    it began; a cluster is chosen if it is at least as stable as those chosen within it. The whole tree is
    never chosen. Memory is linear in the rows.
    """
    n = len(ids)
    place = {int(i): k for k, i in enumerate(ids)}
    order = np.lexsort((b, a, weight))
    # single linkage: node n + k joins two nodes at the k-th weight
    parent_of, size = np.arange(2 * n - 1), np.r_[np.ones(n, np.int64), np.zeros(max(n - 1, 0), np.int64)]
    kids = np.zeros((max(n - 1, 0), 2), np.int64)

    def find(x: int) -> int:
        while parent_of[x] != x:
            parent_of[x] = parent_of[parent_of[x]]
            x = parent_of[x]
        return x

    for k, e in enumerate(order):
        x, y = find(place[int(a[e])]), find(place[int(b[e])])
        kids[k] = x, y
        parent_of[x] = parent_of[y] = n + k
        size[n + k] = size[x] + size[y]
    rate = lambda k: 1 / max(float(weight[order[k]]), 1e-12)
    born, stability, inside, members_of, owner = [0.0], [0.0], [[]], [-1], np.full(n, -1)
    work = [(2 * n - 2, 0)] if n > 1 else []

    def leave(node: int, cluster: int, at: float) -> None:
        below = [node]
        while below:
            x = below.pop()
            if x < n:
                owner[x] = cluster
                stability[cluster] += at - born[cluster]
            else:
                below += kids[x - n].tolist()

    while work:
        node, cluster = work.pop()
        if node < n:
            owner[node] = cluster
            continue
        at, parts, equal = rate(node - n), [], kids[node - n].tolist()
        while equal:  # edges of one weight go together
            z = equal.pop()
            if z >= n and weight[order[z - n]] == weight[order[node - n]]:
                equal += kids[z - n].tolist()
            else:
                parts.append(z)
        big = [z for z in parts if size[z] >= least]
        for z in parts:
            if size[z] < least:
                leave(z, cluster, at)
        if len(big) == 1:
            work.append((big[0], cluster))
        elif big:
            stability[cluster] += (at - born[cluster]) * float(sum(size[z] for z in big))
            for z in big:
                born.append(at)
                stability.append(0.0)
                inside.append([])
                members_of.append(cluster)
                inside[cluster].append(len(born) - 1)
                work.append((z, len(born) - 1))
    chosen = np.zeros(len(born), bool)
    total = list(stability)
    for c in range(len(born) - 1, 0, -1):
        within = sum(total[i] for i in inside[c])
        if not inside[c] or stability[c] >= within:
            chosen[c] = True
        else:
            total[c] = within
    label = np.full(len(born), -1)
    for c in range(1, len(born)):
        above = members_of[c]
        label[c] = label[above] if above > 0 and label[above] >= 0 else c if chosen[c] else -1
    own = np.where(owner >= 0, label[owner], -1)
    out = np.full(n, -1, np.int64)
    for c in np.unique(own[own >= 0]):
        out[own == c] = ids[own == c].min()
    return out


def _clusters(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = pdf[pdf["a"] != pdf["b"]]
        ids = np.unique(np.r_[edges["a"], edges["b"]])
        found = condensed(ids, edges["a"].to_numpy(), edges["b"].to_numpy(), edges["weight"].to_numpy(), least)
        return pd.DataFrame({"id": ids, "cluster": pd.array([None if c < 0 else int(c) for c in found], dtype="Int64")})

    return run


def density_clusters(rows: DataFrame, least: int = LEAST, rows_a_cell: int = WIDE, part: int = WIDE) -> DataFrame:
    """(id, cluster) of rows (id long, vec array): cluster is the smallest id of its members, null for noise.

    least is both the least size of a cluster and the rank of the neighbour that sets a core distance. Vectors
    that are null, zero or hold nulls are noise, and so is a table of fewer rows than that. The condensed tree of one
    tree is made in one task, of three numbers a row.
    """
    ship(rows.sparkSession)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    cells = cells_of(rows.withColumn("extra", F.lit(None).cast("double")), part, rows_a_cell)
    noise = rows.select("id", F.lit(None).cast("long").alias("cluster"))
    if cells is None:
        return noise
    near = stored(neighbours(cells, cells.rows, least, part), "neighbours")
    points = cells.rows.select("id", "vec").join(core_distances(cells, cells.rows, least, near), "id")
    tree = spanning_tree(cells, points, part, near)
    cells.drop()
    dropped(near)
    parts = connected(tree)
    found = tree.join(parts.select(F.col("node").alias("a"), "root"), "a").groupBy("root").applyInPandas(_clusters(least), "id long, cluster long")
    return rows.select("id").join(found, "id", "left")
