"""Vectors: centroids, cohesion, and nearest neighbours in cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.cells import BLOCK, ROWS_A_CELL, cells_of, nearest_in
from tidewatch.tables import Tables


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, however often use names it, also within its own lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))
    return bound_once(v, lambda v: bound_once(norm(v), lambda n: scaled(v, n)))


def nearest(left: DataFrame, right: DataFrame, k: int = 3, least: float = -1.0, others: bool = True, block: int = BLOCK, rows_a_cell: int = ROWS_A_CELL, seen: list[int] | None = None) -> DataFrame:
    """(id, neighbour, score): for each left row the k right rows of largest cosine, least or more.

    Both have id long, vec array and at double; a right row qualifies if its at is not larger than
    the left row's (nulls do not bind) and, with others, if its id differs. Scores have 6 places,
    ties go to the smaller id. See nearest_in() for how cells around pivots keep most pairs apart; seen
    gets the number of pairs compared.
    """
    columns = lambda df: df.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.col("at").cast("double").alias("extra"))
    cells = cells_of(columns(right), block, rows_a_cell)
    if cells is None:
        return left.sparkSession.createDataFrame([], "id long, neighbour long, score double")
    return nearest_in(cells, columns(left), k, least, others, block, seen)


def _vectors(t: Tables, *, at: Column | None = None) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (at if at is not None else F.lit(None).cast("double")).alias("at"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@operator("joi_13", f"SELECT id, neighbour, score FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) x WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) <= 3")
def nearest_articles(t: Tables, k: int = 3, least: float = 0.2) -> DataFrame:
    return nearest(_vectors(t), _vectors(t), k, least)


@operator("joi_14", f"SELECT id, neighbour, score FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 5 = 0) x WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) = 1")
def nearest_topics(t: Tables, least: float = 0.25) -> DataFrame:
    return nearest(_vectors(t), _vectors(t).where("id % 5 = 0"), 1, least)


@operator("joi_15", f"SELECT id, neighbour, score FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 37 <= a.vec_id % 37) x WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) = 1")
def merge_targets(t: Tables, least: float = 0.25) -> DataFrame:
    """The nearest topic that was first seen no later."""
    seen = _vectors(t, at=F.col("vec_id") % 37)
    return nearest(seen, seen, 1, least)


@operator("joi_16", f"SELECT x.id, x.neighbour, x.score, x.id % 3 = x.neighbour % 3 AS barred FROM (SELECT id, neighbour, score FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id ) y QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) <= 5) x")
def merge_suggestions(t: Tables, k: int = 5) -> DataFrame:
    found = nearest(_vectors(t), _vectors(t), k)
    return found.withColumn("barred", F.col("id") % 3 == F.col("neighbour") % 3)


@operator("joi_18", f"SELECT id, neighbour, score FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 11 <> 0) x WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) = 1")
def duplicate_lookup(t: Tables, least: float = 0.3) -> DataFrame:
    """The nearest row that is no duplicate itself."""
    return nearest(_vectors(t), _vectors(t).where("id % 11 <> 0"), 1, least)


def centroids(df: DataFrame, key: str) -> DataFrame:
    """(key, size, centroid, cohesion): unit mean of unit vectors, and members' mean cosine to it.

    Means are taken by dimension, so a large group is summed in parts; the cohesion of unit
    members is the dot product of their mean with the centroid.
    """
    parts = df.select(key, F.posexplode(normalized(F.transform("embedding", lambda x: x.cast("double")))).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    rows = means.groupBy(key).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    unit = rows.withColumn("centroid", normalized(F.col("mean")))
    return unit.select(key, "size", "centroid", F.aggregate(F.zip_with("mean", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("cohesion"))


_CENT = "SELECT label, n, list(x / norm ORDER BY i) AS c, sum(x * x / norm) AS cohesion FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS norm FROM (SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(range(1, 65)) AS i, unnest([y / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR y IN embedding::DOUBLE[]]) AS x FROM embeddings) a GROUP BY label, i) b) d GROUP BY label, n"


@operator("agg_26", f"SELECT label, n AS size, round(c[1], 6) AS first, round(cohesion, 6) AS cohesion FROM ({_CENT}) e")
def label_centroids(t: Tables) -> DataFrame:
    return centroids(t.embeddings, "label").select("label", "size", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round("cohesion", 6).alias("cohesion"))


@operator("agg_28", f"SELECT round((SELECT avg(cohesion) FROM ({_CENT}) e), 6) AS cohesion, round((SELECT min(list_dot_product(a.c, b.c)) FROM ({_CENT}) a JOIN ({_CENT}) b ON a.label < b.label), 6) AS separation")
def cluster_quality(t: Tables) -> DataFrame:
    """Mean cohesion and the smallest cosine between two centroids of the (few) clusters."""
    from tidewatch.operators.scalars import dot

    c = centroids(t.embeddings, "label")
    pairs = c.alias("a").join(c.alias("b"), F.col("a.label") < F.col("b.label")).agg(F.round(F.min(dot(F.col("a.centroid"), F.col("b.centroid"))), 6).alias("separation"))
    return c.agg(F.round(F.avg("cohesion"), 6).alias("cohesion")).join(F.broadcast(pairs))
