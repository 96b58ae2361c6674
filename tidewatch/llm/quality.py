"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    z = b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so all pairwise interactions of a document cost time linear in its non-zero inputs. The model is
fitted on at most MAX_TRAIN labelled rows, taken in order of a hash of doc_id (that bound is a
parameter); its size is fixed by BUCKETS and RANK whatever the corpus. Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import table, trimmed, unused
from tidewatch.session import ship

BUCKETS = 1 << 14
RANK = 8
BINS = 8
MAX_TRAIN = 12_000
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.08, 7
WORD_CACHE = 50_000
BATCH_CHARS = 1_000_000
RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
STATS = ("words", "word_length", "upper", "digits", "symbols", "pipes", "letters", "other_bytes", "distinct", "commonest", "same_lines", "same_sentences", "symbol_runs", "bytes", "meta_size", "meta_differs")
INPUTS = BUCKETS + len(STATS) * (BINS + 1)


def statistics(data: bytes, words: list[bytes], counts: Counter, size: int | None) -> np.ndarray:
    """Structure of a text, each value from 0 to 1; size is the metadata column n_chars."""
    n, m = max(len(data), 1), max(len(words), 1)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, letters, digits = by[65:91].sum(), by[65:91].sum() + by[97:123].sum(), by[48:58].sum()
    symbols = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    lines = [x for x in data.split(b"\n") if x]
    sentences = [x for x in data.split(b".") if x]
    chars = n - by[128:192].sum()
    return np.minimum(1.0, np.array([
        np.log1p(len(words)) / 12, len(data) / m / 20, upper / max(letters, 1), 4 * digits / n, 3 * symbols / n, 8 * by[124] / n,
        letters / n, by[128:].sum() / n, len(counts) / m, (max(counts.values()) if counts else 0) / m,
        1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(sentences)) / max(len(sentences), 1), len(RUNS.findall(data)) / m, np.log1p(len(data)) / 16,
        np.log1p(max(size or 0, 0)) / 16, abs(chars - (size or 0)) / max(chars, size or 0, 1),
    ]))


_PLACES: dict[bytes, int] = {}


def _place(word: bytes) -> int:
    found = _PLACES.get(word)
    if found is None:
        if len(_PLACES) >= WORD_CACHE:
            _PLACES.clear()
        found = _PLACES[word] = zlib.crc32(word) % BUCKETS
    return found


def inputs(text: str, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-zero inputs of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    stats = statistics(data, words, counts, size)
    places = np.fromiter(map(_place, counts), np.int64, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    values /= max(np.sqrt((values**2).sum()), 1.0)
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    first = BUCKETS + np.arange(len(STATS)) * (BINS + 1)
    return np.r_[places, first + bins, first + BINS].astype(np.int32), np.r_[values, np.ones(len(STATS)), stats].astype(np.float32)


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, places: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """z of rows whose inputs lie one after the other; no row is without inputs."""
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        vx = self.factors[places] * values[:, None]
        pairs = np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx**2, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * pairs.sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(places: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-5, seed: int = SEED) -> Machine:
    """Logistic loss, AdaGrad over shuffled batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(INPUTS), rng.normal(0, 0.02, (INPUTS, RANK))
    if not len(labels):
        return Machine(0.0, linear.astype(np.float32), np.zeros((INPUTS, RANK), np.float32))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, seen_b = float(np.log(share / (1 - share))), 1e-6
    seen_l, seen_f = np.full(INPUTS, 1e-6), np.full((INPUTS, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            p = np.concatenate([places[i] for i in part])
            x = np.concatenate([values[i] for i in part]).astype(np.float64)
            sizes = np.array([len(places[i]) for i in part])
            starts, row = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(part)), sizes)
            vx = factors[p] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            z = bias + np.add.reduceat(linear[p] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            error = (_sigmoid(z) - labels[part]) / len(part)
            used, inverse = np.unique(p, return_inverse=True)
            ex = error[row] * x
            g_l = np.bincount(inverse, ex) + decay * linear[used]
            g_f = np.stack([np.bincount(inverse, ex * (sums[row, f] - vx[:, f])) for f in range(RANK)], axis=1) + decay * factors[used]
            g_b = error.sum()
            seen_b += g_b**2
            seen_l[used] += g_l**2
            seen_f[used] += g_f**2
            bias -= rate * g_b / np.sqrt(seen_b)
            linear[used] -= rate * g_l / np.sqrt(seen_l[used])
            factors[used] -= rate * g_f / np.sqrt(seen_f[used])
    return Machine(float(bias), linear.astype(np.float32), factors.astype(np.float32))


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def _size_column(docs: DataFrame) -> Column:
    return (F.expr("try_cast(n_chars as bigint)") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias(unused(docs, "_size"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from tidewatch.llm.quality import inputs as of

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [of(t.as_py() or "", s.as_py()) for t, s in zip(part.column(1), part.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["label", "places", "values"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Machine:
    """A machine from the labelled rows that are not held out: the first most of them by hash of doc_id.

    labels has doc_id and quality; rows where either is null are left out, repeated ids count once.
    Of documents that repeat a labelled id the one with the least text counts, so at most most rows
    come to the driver. Without any labelled row the machine scores all alike.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(text, _size_column(docs).alias("size")).alias("row")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("row").alias("row"))
    found = rows.select(F.col("label").cast("int"), "row.text", "row.size").mapInArrow(_featured, "label int, places binary, values binary").toArrow()
    places = [np.frombuffer(x.as_py(), np.int32) for x in found.column("places")]
    values = [np.frombuffer(x.as_py(), np.float32) for x in found.column("values")]
    order = sorted(range(len(places)), key=lambda i: (places[i].tobytes(), values[i].tobytes()))  # whatever order Spark gave them
    machine = train([places[i] for i in order], [values[i] for i in order], found.column("label").to_numpy()[order].astype(np.float64))
    del found, places, values
    trimmed()
    return machine


def _score(machine: Machine, names: list[str], out: str):
    text_at, size_at = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.llm.quality import inputs as of

        for batch in batches:
            scores, held, chars = [], [], 0

            def flush(held: list, scores: list) -> None:
                if held:
                    sizes = np.array([len(p) for p, _ in held])
                    scores.append(_sigmoid(machine.logits(np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held]), sizes)))

            for t, s in zip(batch.column(text_at), batch.column(size_at), strict=True):
                text = t.as_py() or ""
                held.append(of(text, s.as_py()))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    flush(held, scores)
                    held, chars = [], 0
            flush(held, scores)
            column = pa.array(np.concatenate(scores).astype(np.float64) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:size_at], column], [*names, out])
        trimmed()

    return run


def scored(docs: DataFrame, machine: Machine, *keep: str, out: str = "score") -> DataFrame:
    """keep columns (and text) of every row of docs with out, the probability of label 1.

    Null texts are scored as empty ones. Very long texts are scored whole, repeated rows each for
    itself. A kept column named as out is replaced; other extra columns pass where kept.
    """
    ship(docs.sparkSession)
    names = [c for c in (*keep, *(() if "text" in keep else ("text",))) if c != out]
    narrow = docs.select(*names, _size_column(docs))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_score(machine, names, out), f"{fields}, `{out}` double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score threshold or more; columns and texts stay as they are, whatever their names.

    Null and empty texts are scored like any other, repeated rows alike; an empty table stays empty.
    """
    out = unused(docs, "_tidewatch_score")
    good = scored(docs, fit(docs, labels, most), *docs.columns, out=out).where(F.col(out) >= threshold)
    return good.select(*docs.columns)


def op3_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labelled rows that are not held out; see fit() and scored()."""
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, machine, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
