"""Density clusters against the whole matrix of mutual reachability."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.operators import density


def _points(seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, 4))
    x = [h + s * rng.normal(size=(m, 4)) for h, s, m in zip(heads, (0.05, 0.1, 0.2, 0.05, 0.15, 0.1), (40, 60, 30, 15, 25, 8), strict=True)]
    return np.vstack([*x, rng.normal(size=(40, 4))])


def _reach(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * np.round(u @ u.T, 6), 0))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, least - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def _prim(reach):
    n = len(reach)
    best, done, total = reach[0].copy(), {0}, []
    for _ in range(n - 1):
        best[list(done)] = np.inf
        j = int(best.argmin())
        total.append(best[j])
        done.add(j)
        best = np.minimum(best, reach[j])
    return sorted(total)


def _brute(x, least):
    """Clusters by cutting at every distance, top down: sets of rows, split, shrunk and chosen by stability."""
    reach = _reach(x, least)
    levels = np.unique(reach[np.isfinite(reach)])[::-1]

    def parts(members, cut):
        left, out = set(members), []
        while left:
            grow = [left.pop()]
            part = set(grow)
            while grow:
                i = grow.pop()
                for j in [j for j in left if reach[i, j] < cut]:
                    left.discard(j)
                    part.add(j)
                    grow.append(j)
            out.append(part)
        return out

    def follow(members, born):
        """(stability of the cluster that begins here, clusters within it)"""
        stable, members = 0.0, set(members)
        for cut in levels:
            if len(members) < least:
                break
            split = parts(members, cut)
            big = [p for p in split if len(p) >= least]
            gone = len(members) - sum(map(len, big))
            if len(big) >= 2 or not big:
                stable += (1 / cut - born) * len(members)
                return stable, [(p, *follow(p, 1 / cut)) for p in big]
            stable += (1 / cut - born) * gone
            members = big[0]
        return stable, []

    def choose(cluster):
        own, stable, within = cluster
        below = [choose(c) for c in within]
        total = sum(t for t, _ in below)
        if within and total > stable:
            return total, [c for _, cs in below for c in cs]
        return stable, [own]

    _, first = follow(range(len(x)), 0.0)
    return {frozenset(c) for f in first for c in choose(f)[1]}


def test_tree_and_clusters_are_those_of_the_matrix(spark):
    x = _points()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(2)
    cells = density.cells_of(df.selectExpr("id", "vec", "cast(null as double) as extra"), block=64, rows_a_cell=40)
    points = cells.rows.select("id", "vec").join(density.core_distances(cells, cells.rows.select("id", "vec"), 10), "id")
    tree = density.spanning_tree(cells, points).collect()
    assert len(tree) == len(x) - 1
    assert sorted(r["weight"] for r in tree) == pytest.approx(_prim(_reach(x, 10)))
    found = density.condensed(np.arange(len(x)), *(np.array([r[c] for r in tree]) for c in ("a", "b", "weight")), 10)
    groups = {frozenset(np.flatnonzero(found == c).tolist()) for c in np.unique(found[found >= 0])}
    assert groups == _brute(x, 10) and len(groups) >= 4 and (found < 0).sum() >= 20
    assert all(min(g) == found[min(g)] for g in groups)


@pytest.mark.parametrize("seed", (3, 4))
def test_tree_from_neighbours_is_that_of_the_matrix(spark, seed):
    """Two far groups and a tight one within noise: neighbours alone join neither."""
    rng = np.random.default_rng(seed)
    far = np.array([8.0, 0.0, 0.0, 0.0]) + 0.1 * rng.normal(size=(60, 4))
    x = np.vstack([_points(seed), -far, far + [0.0, 3.0, 0.0, 0.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(2)
    cells = density.cells_of(df.selectExpr("id", "vec", "cast(null as double) as extra"), block=64, rows_a_cell=40)
    near = density.neighbours(cells, cells.rows, 10)
    points = cells.rows.select("id", "vec").join(density.core_distances(cells, cells.rows, 10, near), "id")
    tree = density.spanning_tree(cells, points, 50, near).collect()
    assert sorted(r["weight"] for r in tree) == pytest.approx(_prim(_reach(x, 10)))


def test_rows_are_not_written_once_a_round(spark, monkeypatch):
    """The tree takes one search beyond the neighbours', whatever the number of its joins."""
    met = []
    monkeypatch.setattr(density.Cells, "meet", lambda self, *a, _meet=density.Cells.meet, **k: (met.append(1), _meet(self, *a, **k))[1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_points())], "id long, vec array<double>")
    density.density_clusters(df, rows_a_cell=40, part=50).count()
    assert len(met) <= 3


@pytest.mark.parametrize("seed", range(6))
def test_condensed_trees(seed):
    x = _points(seed)
    reach = _reach(x, 8)
    n, edges = len(x), []
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if find(i) != find(j):
            parent[find(j)] = find(i)
            edges.append((i, j, w))
    found = density.condensed(np.arange(n), *map(np.array, zip(*edges, strict=True)), 8)
    groups = {frozenset(np.flatnonzero(found == c).tolist()) for c in np.unique(found[found >= 0])}
    assert groups == _brute(x, 8)


def test_few_rows_are_noise(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, None), (10, [0.0, 0.0])], "id long, vec array<double>")
    assert {tuple(r) for r in density.density_clusters(df).collect()} == {(i, None) for i in (0, 1, 2, 3, 4, 9, 10)}
    assert density.density_clusters(df.limit(0)).count() == 0
