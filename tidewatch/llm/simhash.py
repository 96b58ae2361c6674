"""Near-duplicate documents by SimHash, found through an inverted index on positional bytes.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits differ in at
most four bytes, so they share at least four positional bytes: the guaranteed minimum. Postings
of single bytes are long at any real size, so the index is keyed by positional bytes four at a time,
at all seventy choices of four positions. A pair that meets in a posting has its shared positional
bytes tallied, stays a candidate with the guaranteed minimum or more, and is then verified on its
bits. linking.py says how the members of a posting are compared.

Four bits stand for a high similarity only: texts that share 0.8 of their shingles differ in about
ten of 64 bits, too many for any guaranteed byte. one_of_each() therefore puts the bands of min-wise
sketches into the same index, and verifies pairs that meet there on their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import minhash
from tidewatch.llm.linking import Rule, classes, with_smallest_id
from tidewatch.llm.shared import dropped, joined, keyed, stored, table, trimmed
from tidewatch.llm.shingles import distinct_hashes, shingle_hashes
from tidewatch.session import ship

__all__ = ["distinct_hashes", "fingerprint", "near_duplicates", "one_of_each", "shingle_hashes"]

SHINGLE_WORDS = 4
MAX_BITS = 4
COPY_WORDS = 5
COPY_PERCENT = 80
COPY_DEVIATIONS = 4.0


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 where there is no word."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(sum(1 << int(i) for i in np.flatnonzero(votes * 2 > total)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py() or "", width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        trimmed()

    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def fours() -> list[tuple[int, ...]]:
    """All choices of four of the eight byte positions."""
    return list(combinations(range(8), 4))


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    differing = a.bitwiseXOR(b)
    tally = F.lit(0)
    for p in range(8):
        same = differing.bitwiseAND(F.lit(_mask((p,)))) == F.lit(0)
        tally = tally + same.cast("int")
    return tally


def linked(a: Column, b: Column, max_bits: int = MAX_BITS) -> Column:
    """Whether a pair from the index stays: first by the tally of shared bytes, then verified on the bits."""
    return (shared_bytes(a, b) >= 8 - max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def postings(fp: Column) -> Column:
    """The keys of a fingerprint in the inverted index: its bytes at four positions, for every choice."""
    return F.array(*[F.struct(F.lit(i).alias("slot"), fp.bitwiseAND(F.lit(_mask(four))).alias("key")) for i, four in enumerate(fours())])


def fingerprint_classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root): the classes of distinct fingerprints (fp) that links of max_bits bits or fewer join.

    Fingerprints without any link are left out.
    """
    if max_bits > 4:
        raise ValueError("four equal bytes find pairs of up to four differing bits")
    rule = Rule(attributes=(), near=lambda x, y: linked(x("node"), y("node"), max_bits))
    return classes(fps.select(F.col("fp").alias("node")), postings(F.col("node")), rule)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit), component_id (smallest doc_id reachable).

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any
    other. Repeated rows and repeated doc_ids each keep their row; rows whose doc_id is null count
    as members and take the smallest id among the others (null if there is none). There are no ties:
    a class is all that links join. Other columns of docs are not read. An empty table gives an
    empty result.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    named = with_smallest_id(fps.withColumnRenamed("fp", "node"), fingerprint_classes(fps, max_bits))
    found = joined(rows, named.select(F.col("node").alias("fp"), "n", "component_id"), ["fp"], "n", rows.count())
    return found.select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, percent: int = COPY_PERCENT) -> DataFrame:
    """docs with one row of each class of near duplicates: that with the smallest doc_id, nulls last.

    Near duplicates are texts that near_duplicates() links, by at most max_bits bits over shingles of
    width words, and texts whose sets of five-word shingles have a similarity of percent or more: such a
    pair meets in the index and passes the sketches but for a chance of 3 in 10^4 at 0.8, and less above. Both kinds of links
    join one set of classes. Null texts count as empty and empty texts are one class; of repeated rows,
    and of rows with equal ids in a class, one stays; columns stay as they are, whatever their names; an
    empty table stays empty.
    """
    rows, key = keyed(docs)
    texts = rows.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"))
    made = stored(_both(texts, width), "sketches")
    met = made.join(ids, F.col("doc_id") == F.col("row"))
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    same = met.groupBy("fp", "name").agg(order, F.min("row").alias("low"), *[F.first(c).alias(c) for c in ("n", "keys", "bits")])
    nodes = stored(minhash.with_bits(same.withColumn("node", F.monotonically_increasing_id())), "texts")
    confirmed = minhash.Confirmed(texts, nodes, COPY_WORDS, percent)
    by_bits = lambda x, y: linked(x("fp"), y("fp"), max_bits)
    rule = Rule(
        attributes=("fp", "n", *minhash.BITS),
        near=lambda x, y: by_bits(x, y) | F.coalesce(minhash.sizes_and_sketches_allow(x, y, percent, COPY_DEVIATIONS), F.lit(False)),
        sure=by_bits,
        verified=confirmed.links,
        prepared=confirmed.prepare,
    )
    roots = classes(nodes, F.concat(postings(F.col("fp")), minhash.slots(len(fours()))), rule)
    confirmed.done()
    named = nodes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("best").alias("best"))
    kept = stored(named.select(F.col("best.row").alias(key)), "kept")
    dropped(made, nodes, roots)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def _both(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp and the columns of minhash.sketches() for every row of docs (doc_id long, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            if not texts:
                continue
            fps = [_signed(fingerprint(t, width)) for t in texts]
            n, name, keys, bits = zip(*(minhash.sketch_of(t, COPY_WORDS) for t in texts), strict=True)
            made = [pa.array(fps, pa.int64()), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "fp", "n", "name", "keys", "bits"])
        trimmed()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id long, fp long, {minhash.SKETCHED.removeprefix('doc_id long, ')}")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and class of near duplicates; see near_duplicates()."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
