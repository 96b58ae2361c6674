"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments, coarse to fine. For a segment of n components with means m and
deviations d, the inner product of two pieces is at most n m m' + n d d' (Cauchy-Schwarz on what
is left after the means), which bounds the distance from below and the score from above. A vector
whose bound stays under a query's current k-th best score is ruled out for that query; exact
integer scores are computed for survivors alone. Queries lie in blocks of bounded size that tasks
map from the shared folder; each task keeps k rows a query and one more, and the best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.shared import dropped, new_path, stored, table
from tidewatch.llm.shelf import Shelf
from tidewatch.session import ship

K = 10
SCALE = 1024
LEVELS = (1, 4, 16)
QUERY_BLOCK, PASS_BLOCKS = 4096, 64
ROWS = 2048


def integers(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """floor(SCALE * x) of vectors, by dimension: rows and their matrix. Vectors that are null, empty
    or hold null or non-finite components take no part."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    out = {}
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        flat = lists.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        whole = np.isfinite(x).all(axis=1)
        out[int(d)] = (rows[whole], np.floor(SCALE * x[whole]))
    return sizes, out


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a product of two rows is their bound."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    widths = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    means = sums / widths
    spread = np.sqrt(np.maximum(squares / widths - means**2, 0.0))
    root = np.sqrt(widths)
    return np.hstack([means * root, spread * root])


class Search:
    """The best k of what it has seen, for a block of queries of one dimension."""

    def __init__(self, queries: np.ndarray, k: int, levels: tuple[int, ...]):
        self.queries, self.k, self.levels = queries, k, levels
        self.bounds = [segment_statistics(queries, s) for s in levels]
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.same = np.zeros((len(queries), k), bool)

    def add(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        """Rows of the table; own has the queries' ids."""
        slack = 1.0 + 1e-9 * np.abs(x).max(initial=1.0) * np.abs(self.queries).max(initial=1.0) * x.shape[1]
        alive = np.ones((len(own), len(ids)), bool)
        worst = self.score[:, -1]
        if np.isfinite(worst).any():
            for level, bound in zip(self.levels, self.bounds, strict=True):
                rows = np.flatnonzero(alive.any(axis=0))
                if not len(rows):
                    return
                alive[:, rows] &= bound @ segment_statistics(x[rows], level).T + slack >= worst[:, None]
        asked, kept = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(asked):
            return
        exact = self.queries[asked] @ x[kept].T
        exact[~alive[np.ix_(asked, kept)]] = -np.inf
        if exact.shape[1] > self.k:  # all that reach the k-th score stay, so ties are settled by id below
            near = np.partition(exact, -self.k, axis=1)[:, -self.k][:, None]
            exact[exact < near] = -np.inf
        for row, q in enumerate(asked):
            new = np.flatnonzero(np.isfinite(exact[row]) & (exact[row] >= self.score[q, -1]))
            if len(new):
                names = ids[kept[new]]
                same = (names == own[q]) & (x[kept[new]] == self.queries[q]).all(axis=1)
                score, found, same = np.r_[self.score[q], exact[row, new]], np.r_[self.found[q], names], np.r_[self.same[q], same]
                best = np.lexsort((~same, found, -score))[: self.k]
                self.score[q], self.found[q], self.same[q] = score[best], found[best], same[best]

    def rows(self, numbers: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(np.isfinite(self.score))
        cols = [pa.array(numbers[q]), pa.array(own[q]), pa.array(self.found[q, at]), pa.array(self.score[q, at].astype(np.int64)), pa.array(self.same[q, at])]
        yield pa.RecordBatch.from_arrays(cols, ["query", "query_id", "vec_id", "score", "same"])


def _put_block(shelf: Shelf):
    """Stores a block of queries by dimension; gives the block and its dimensions."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        group = group.sort_by("query").combine_chunks()
        numbers, ids = group.column("query").to_numpy(), group.column("vec_id").to_numpy()
        kept = []
        for d, (rows, x) in integers(_whole(group.column("embedding")))[1].items():
            if len(rows):
                shelf.put(f"numbers-{block}-{d}", numbers[rows].astype(np.int64))
                shelf.put(f"ids-{block}-{d}", ids[rows].astype(np.int64))
                shelf.put(f"vectors-{block}-{d}", x)
                kept.append(d)
        return pa.table({"block": pa.array([block] * len(kept), pa.int32()), "d": pa.array(kept, pa.int32())})

    return run


def _search(shelf: Shelf, blocks: list[tuple[int, int]], k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [(d, shelf.get(f"numbers-{b}-{d}"), shelf.get(f"ids-{b}-{d}"), Search(shelf.get(f"vectors-{b}-{d}"), k, levels)) for b, d in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                found = integers(part.column(1))[1]
                for d, _, own, search in searches:
                    if d in found:
                        rows, x = found[d]
                        search.add(ids[rows].astype(np.int64), x, own)
        for _, numbers, own, search in searches:
            yield from search.rows(numbers, own)

    return run


FOUND = "query long, query_id long, vec_id long, score long, same boolean"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, levels: tuple[int, ...] = LEVELS, block: int = QUERY_BLOCK, blocks_a_pass: int = PASS_BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest integer inner product.

    Both tables have vec_id and embedding. A query is a row of vectors and not its own candidate: one
    row with its id and its vector is left out, other rows that repeat the id, or all of it, count.
    Queries that repeat get their rows each. Ties go to the smaller vec_id; ranks start at 1; fewer
    candidates give fewer rows. Null ids and vectors that are empty or have null or non-finite
    components take no part, nor do vectors of another dimension than the query's. Scores are exact
    up to 2^53. Other columns are not read; an empty table gives no rows.

    Queries lie in blocks in the shared folder; a pass over the table serves blocks_a_pass of them.
    """
    spark = vectors.sparkSession
    ship(spark)
    narrow = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    asked, rows = stored(narrow(queries).withColumn("query", F.monotonically_increasing_id()), "queries"), narrow(vectors)
    blocks = max(1, -(-asked.count() * 5 // (block * 4)))  # a block holds about block * 4/5 queries
    shelf = Shelf(new_path(spark, "blocks"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_put_block(shelf), "block int, d int")
    written = sorted((r["block"], r["d"]) for r in dealt.collect())
    dropped(asked)
    out = spark.createDataFrame([], FOUND)
    for start in range(0, len(written), blocks_a_pass):
        out = out.union(rows.mapInArrow(_search(shelf, written[start : start + blocks_a_pass], k + 1, levels), FOUND))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    best = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    first_own = F.min(F.when(F.col("same"), F.col("place"))).over(W.partitionBy("query"))
    ranked = best.withColumn("own", F.coalesce(first_own, F.lit(k + 2))).where("place <> own")
    return ranked.select("query_id", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def op6_segment_search(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for every row whose vec_id is divisible by 100; see top_k()."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
