"""Language of a text by hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import ship

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
WINDOW = 96
SMOOTHING = 0.5
LEAST = 0.8
MOST_TEXTS = 20_000
FIT_TASKS = 16
FOLDS, HELD = 4, 2


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a whole text's lower-case letters, words parted by one blank; a row for each place
    and a column for each order."""
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not letters:
        return np.zeros((0, len(ORDERS)), np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros((len(points), len(ORDERS)), np.int64)
    for column, order in enumerate(ORDERS):
        key = np.full(len(points), order, np.uint64)
        for back in range(order):  # at the start shorter grams stand for themselves
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ np.r_[np.zeros(back, np.uint64), points[: len(points) - back]]
        key *= np.uint64(0xD6E8FEB86659FD93)
        out[:, column] = (key >> np.uint64(49)).astype(np.int64)
    return out


@dataclass(frozen=True)
class Model:
    """languages, and the log-probability of every bucket in each."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def posterior(self, text: str) -> np.ndarray | None:
        """The mean over stretches of WINDOW letters of each language's probability; None for a text without letters.

        A text of two languages gets about its shares, so it is sure of neither.
        """
        found = grams(text)
        if not len(found) or not self.languages:
            return None
        each = self.weights[found].sum(axis=1)
        starts = np.arange(0, len(each), WINDOW)
        sums = np.add.reduceat(each, starts, axis=0)
        sums -= sums.max(axis=1, keepdims=True)
        shares = np.exp(sums)
        shares /= shares.sum(axis=1, keepdims=True)
        return np.average(shares, axis=0, weights=np.diff(np.r_[starts, len(each)]))

    def detect(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and its probability; None and 0 for a text without letters."""
        shares = self.posterior(text)
        if shares is None:
            return None, 0.0
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def model_of(counts: dict[str, np.ndarray]) -> Model:
    names = tuple(sorted(counts))
    if not names:
        return Model((), np.zeros((BUCKETS, 0)))
    table = np.array([counts[n] for n in names], float).T + SMOOTHING
    return Model(names, np.log(table / table.sum(axis=0)))


def held_out(article_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(article_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit(texts: DataFrame, most: int = MOST_TEXTS) -> Model:
    """A model from texts (article_id, language, content) that are not held out: the first most of them by hash of
    article_id, and all rows of these ids. Only ids are ordered; texts go to FIT_TASKS tasks. Null languages are left out,
    null texts count as empty; without any text nothing is detected."""
    ship(texts.sparkSession)
    known = texts.where(F.col("language").isNotNull() & ~held_out("article_id"))
    chosen = known.select("article_id").orderBy(F.xxhash64("article_id"), "article_id").limit(most).distinct()
    sample = known.join(F.broadcast(chosen), "article_id", "left_semi").select("language", "content").repartition(FIT_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams(text.as_py() or "").ravel(), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["language", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(run, "language string, counts binary").collect():
        total[r["language"]] = total.get(r["language"], 0) + np.frombuffer(r["counts"], np.int64)
    return model_of(total)


def detected(texts: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """article_id, language, detected, confidence, found: found is what was detected with least confidence or
    more, else the source's own language. Whole texts are read; one without letters, or null, is not detected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.detect(t.as_py() or "") for t in batch.column(2)]
            own = batch.column(1).to_pylist()
            found = [name if name is not None and sure >= least else default for (name, sure), default in zip(rows, own, strict=True)]
            columns = [pa.array([n for n, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["article_id", "language", "detected", "confidence", "found"])

    ship(texts.sparkSession)
    rows = texts.select(F.col("article_id").cast("long").alias("article_id"), F.col("language").cast("string").alias("language"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, "article_id long, language string, detected string, confidence double, found string")
