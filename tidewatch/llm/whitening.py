"""Whitening of embeddings from a compensated covariance.

Entries become integers, so a centred vector times the number of rows, c = n x - S, is an integer
vector too. Each task sums the outer products of its c in double-double: c is cut without error
into slices of few bits, the products of slices of a block of rows are then exact in doubles (an
error-free transformation of the whole product), and two-sums carry what a high part cannot hold
into a low part. High and low parts of tasks are merged in rounds, a bounded number of tasks
together. The matrix, of a size that only the dimension sets, is rounded once and decomposed by
numpy.linalg.eigh: Householder reduction to a tridiagonal matrix, then divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import dropped, stored, table
from tidewatch.session import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SLICE_BITS, BLOCK = 21, 1 << 10
FAN_IN = 32
LARGEST = 1 << 53


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    total = a + b
    part = total - a
    return total, (a - (total - part)) + (b - part)


class DoubleDouble:
    """A sum of matrices as a high and a low part."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        self.high, self.low = high, np.zeros_like(high) if low is None else low

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        total, lost = two_sum(self.high, high)
        lost = lost + self.low + low
        self.high = total + lost
        self.low = lost - (self.high - total)


def slices(c: np.ndarray) -> list[np.ndarray]:
    """Integers as sums of slices: c = sum of slices[k] * 2^(SLICE_BITS k), every slice below 2^SLICE_BITS."""
    out, rest = [], c
    while True:
        if (np.abs(rest) < 1 << SLICE_BITS).all():
            return [*out, rest.astype(np.float64)]
        high = rest >> SLICE_BITS
        out.append((rest - (high << SLICE_BITS)).astype(np.float64))
        rest = high


def outer_products(c: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices of doubles that add up to the sum of the rows' outer products; each is exact, for up to BLOCK rows."""
    parts = slices(c)
    for k, a in enumerate(parts):
        yield np.ldexp(a.T @ a, 2 * k * SLICE_BITS)
        for m in range(k + 1, len(parts)):
            product = a.T @ parts[m]
            yield np.ldexp(product, (k + m) * SLICE_BITS)
            yield np.ldexp(product.T, (k + m) * SLICE_BITS)


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * entry) + SHIFT, one row for a vector; the vectors are usable() and have d entries."""
    flat = column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


class Centre:
    """c = n x - S for rows x, in integers: n (x - m) - rest, where S = n m + rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.middle = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        off = x - self.middle
        if self.n * (int(np.abs(off).max(initial=0)) + 1) >= 1 << 62:
            raise OverflowError("the entries' spread times the number of rows passes 2^62")
        return off * self.n - self.rest


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part; see whitened()."""
    entry_fits = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float(LARGEST // SCALE)), F.lit(False)) & ~F.isnan(x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.coalesce((F.size("embedding") > 0) & F.forall("embedding", entry_fits), F.lit(False)))


def _arrays(rows: DataFrame, run, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each entry of their x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            x = integers(batch.column(1), d)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "total"])

    parts = _arrays(rows, run, "n long, total array<long>")
    found = parts.select("n", F.posexplode("total").alias("entry", "part")).groupBy("entry").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).orderBy("entry").collect()
    return (found[0]["n"] if found else 0), [r["total"] for r in found]


SUMMED = "part int, line int, high array<double>, low array<double>"


def _lines(part: int, total: DoubleDouble) -> pa.RecordBatch:
    d = len(total.high)
    lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (total.high, total.low)]
    return pa.RecordBatch.from_arrays([pa.array([part] * d, pa.int32()), pa.array(range(d), pa.int32()), *lists], ["part", "line", "high", "low"])


def _merged(group: pa.Table) -> pa.Table:
    """One line of the matrix: the parts of some tasks added up, in order of the tasks."""
    group = group.sort_by("part")
    total = None
    for high, low in zip(group.column("high"), group.column("low"), strict=True):
        high, low = (np.array(v.as_py()) for v in (high, low))
        if total is None:
            total = DoubleDouble(high, low)
        else:
            total.add(high, low)
    values = [[group.column("group")[0].as_py()], [group.column("line")[0].as_py()], [total.high.tolist()], [total.low.tolist()]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["part", "line", "high", "low"])


def products(rows: DataFrame, d: int, centre: Centre, fan_in: int = FAN_IN) -> list[list[int]]:
    """The sum of all rows' outer products c c', as integers: exact while they keep below 2^106."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = DoubleDouble(np.zeros((d, d)))
        for batch in batches:
            c = centre(integers(batch.column(1), d))
            for at in range(0, len(c), BLOCK):
                for product in outer_products(c[at : at + BLOCK]):
                    total.add(product)
        yield _lines(TaskContext.get().partitionId(), total)

    state = stored(_arrays(rows, run, SUMMED), "covariance")
    while True:
        parts = state.agg(F.max("part")).first()[0]
        if not parts:  # one part, or none
            break
        groups = state.withColumn("group", (F.col("part") / fan_in).cast("int"))
        after = stored(groups.groupBy("group", "line").applyInArrow(_merged, SUMMED), "covariance")
        dropped(state)
        state = after
    lines = state.orderBy("line").collect()
    dropped(state)
    return [[int(h) + int(low) for h, low in zip(r["high"], r["low"], strict=True)] for r in lines]


def components(matrix: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, their unit eigenvectors as columns, and the trace, of matrix / n^3.

    Every entry is rounded once. Eigenvalues that rounding alone could make are left out. A vector's
    largest entry is positive.
    """
    v = np.array([[entry / n**3 for entry in line] for line in matrix])
    trace = sum(line[i] for i, line in enumerate(matrix)) / n**3
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > trace * len(v) * np.finfo(float).eps]
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), range(len(order))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0), trace


def _deviation(c: np.ndarray) -> pa.Array:
    """The sum of squares of each row; null where it passes a long."""
    if not len(c) or c.shape[1] * int(np.abs(c).max()) ** 2 < 1 << 63:
        return pa.array((c * c).sum(axis=1), pa.int64())
    exact = [sum(v * v for v in row) for row in c.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(vectors: DataFrame, most: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every vector and component.

    A vector that is null or empty, or that holds a null, a non-finite entry or one of 2^47 or more,
    takes no part. Of vectors of several lengths those of the commonest length do, of equally common
    ones the longest. Repeated rows and ids count each; a null vec_id stays null. Components with no
    variance beyond rounding are left out, so one vector, equal vectors or an empty table give no
    rows. deviation is null where it passes a long. Other columns are not read. identity_error is
    measured on the whitened vectors, by a pass of its own. The driver holds matrices whose size is
    the square of the dimension, and no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitting = usable(vectors)
    commonest = fitting.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    d = commonest["d"]
    rows = fitting.where(F.size("embedding") == d)
    n, totals = sums(rows, d)
    centre = Centre(n, totals)
    values, axes, trace = components(products(rows, d, centre, fan_in), n, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        c = centre(integers(column, d))
        return c, (c / n) @ scaled

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, y = project(batch.column(1))
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        lines = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), lines], ["line", "entries"])

    entries = _arrays(rows, spread, "line int, entries array<double>").select("line", F.posexplode("entries").alias("entry", "value"))
    found = entries.groupBy("line", "entry").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1, k))
    for r in found:
        total[r["line"], r["entry"]] = r["value"]
    mean = total[k] / n
    error = float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, y = project(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _deviation(c), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "deviation", "y"])

    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    out = _arrays(rows, run, "vec_id long, deviation long, y array<double>").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable embedding along up to 32 whitened components; see whitened()."""
    return whitened(table(spark, sf_dir, "embeddings"))
