"""Near-duplicate documents by circulant MinHash, confirmed on their whole shingle sets.

All coordinates of a signature come from two permutations of the 64-bit hashes: the first is applied
once to a set, the second is shifted by one place of the circle for every further coordinate. Eight
of the first 384 coordinates make a band, the key of a posting; three bits of all 512 go into a sketch. Pairs
that meet in a band stay candidates where sizes and sketches allow the similarity, and are linked if
their whole sets have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.linking import End, Rule, classes, with_smallest_id
from tidewatch.llm.shared import dropped, joined, stored, table, trimmed
from tidewatch.llm.shingles import distinct_hashes
from tidewatch.session import ship

WORDS = 5
PERCENT = 85
BANDS, BAND = 48, 8
COORDINATES = 512
LONGS = COORDINATES // 64
PART = 256
DEVIATIONS = 4.5
#: Odd factors of the permutations; any would do, these are fixed so that every machine uses the same.
FACTORS = (0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLANES = 3
BITS = tuple(f"bits{i}" for i in range(PLANES * LONGS))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every coordinate over distinct hashes, of which there is one at least.

    Coordinate k of a hash x is pi(sigma(x) - k): sigma permutes the 64-bit numbers, pi does so too, and
    subtracting k shifts its circle by k places.
    """
    first, second, third = (np.uint64(f) for f in FACTORS)
    sigma = hashes.astype(np.uint64)
    sigma = (sigma ^ (sigma >> np.uint64(33))) * first
    sigma ^= sigma >> np.uint64(29)
    start, shifts = sigma * second, (np.arange(COORDINATES, dtype=np.uint64) * second)[:, None]
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(start), PART):
        pi = start[None, at : at + PART] - shifts  # pi multiplies first, so the shift may follow
        pi ^= pi >> np.uint64(32)
        pi *= third
        least = np.minimum(least, pi.min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A number for each band of a signature, of its first BANDS * BAND coordinates."""
    factors = np.uint64(FACTORS[1]) ** np.arange(1, BAND + 1, dtype=np.uint64)
    keys = (least[: BANDS * BAND].reshape(BANDS, BAND) * factors).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """PLANES bits of each coordinate: planes of one bit of all coordinates, 64 in a number."""
    planes = [np.packbits((least >> np.uint64(17 + plane)).astype(np.uint8) & 1) for plane in range(PLANES)]
    return np.concatenate(planes).view(">i8").astype(np.int64)


def sketch_of(text: str, width: int = WORDS) -> tuple[int, bytes, list[int], list[int]]:
    """Size of a text's shingle set, a name of the set, its band keys and sketch; both empty without words."""
    hashes = distinct_hashes(text, width)
    name = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    if not len(hashes):
        return 0, name, [], []
    least = signature(hashes)
    return len(hashes), name, band_keys(least).tolist(), sketch(least).tolist()


SKETCHED = "doc_id long, n long, name binary, keys array<long>, bits array<long>"


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n (set size), name (of the set), keys and bits for every row of docs (doc_id long, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, name, keys, bits = zip(*(sketch_of(t.as_py() or "", width) for t in batch.column(1)), strict=True)
            made = [pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "name", "keys", "bits"])
        trimmed()

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_some(run), SKETCHED)


def _some(run):
    """run over the batches that have rows."""
    return lambda batches: run(b for b in batches if b.num_rows)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(name, hashes): the whole shingle set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [distinct_hashes(t.as_py() or "", width) for t in batch.column(0)]
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["name", "hashes"])
        trimmed()

    return docs.select("text").mapInArrow(_some(run), "name binary, hashes array<long>")


def most_differing(percent: int, deviations: float = DEVIATIONS) -> int:
    """Coordinates whose sketches differ at most in pairs of this similarity, but for a chance of about 3 in 10^6
    (3 in 10^5 for four deviations)."""
    p = (1 - percent / 100) * (1 - 0.5**PLANES)
    return int(COORDINATES * p + deviations * (COORDINATES * p * (1 - p)) ** 0.5)


def sizes_and_sketches_allow(x: End, y: End, percent: int, deviations: float = DEVIATIONS) -> Column:
    """Whether two sets may have this similarity, by their sizes and the tally of coordinates equal in the sketch."""
    bits = [x(b).bitwiseXOR(y(b)) for b in BITS]
    differing = F.lit(0)
    for i in range(LONGS):
        apart = bits[i]
        for plane in range(1, PLANES):
            apart = apart.bitwiseOR(bits[plane * LONGS + i])
        differing = differing + F.bit_count(apart)
    sizes = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
    return sizes & (differing <= most_differing(percent, deviations))


def with_bits(sets: DataFrame) -> DataFrame:
    """The sketch in columns of its own."""
    return sets.withColumns({name: F.get("bits", F.lit(i)) for i, name in enumerate(BITS)}).drop("bits")


def slots(first: int = 0) -> Column:
    """Posting keys of the column keys; slots are numbered from first."""
    return F.transform("keys", lambda key, i: F.struct((i + first).cast("int").alias("slot"), key.alias("key")))


class Confirmed:
    """Pairs of nodes whose whole sets have a similarity.

    nodes: (node, low, name), of which low finds the text in docs (doc_id, text). Pairs first meet by the upper
    halves of their hashes: equal hashes have equal halves, and what halves that fall together may hide is added, so
    this never counts too few. What is left is confirmed on the whole hashes.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.nodes, self.width, self.percent, self.sets = docs, nodes.select("node", "low", "name"), width, percent, None

    def prepare(self, meeting: DataFrame) -> None:
        """Store the sets of the nodes that share a posting."""
        asked = self.nodes.join(meeting, "node", "left_semi")
        texts = self.docs.join(asked.select("low"), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")
        sets = _sets(texts, self.width).dropDuplicates(["name"])
        self.sets = stored(asked.select("node", "name").join(sets, "name").select("node", "hashes"), "shingles")

    def links(self, pairs: DataFrame) -> DataFrame:
        halves = F.array_distinct(F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")))
        n = F.size("hashes").cast("long").alias("n")
        half = self.sets.select("node", halves.alias("hashes"), n).withColumn("hidden", F.col("n") - F.size("hashes"))
        left = self._similar(pairs, half)
        return self._similar(left, self.sets.select("node", "hashes", n, F.lit(0).cast("long").alias("hidden")))

    def _similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b), stored: the pairs whose sets (node, hashes, n, hidden) share enough for the similarity."""
        pairs = candidates = stored(pairs, "candidates")
        total = candidates.count()
        if not total:
            return candidates
        for end in "ab":
            uses = candidates.groupBy(end).agg(F.count("*").alias("uses"))
            ends = sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("hashes", "n", "hidden")]).join(uses, end)
            pairs = joined(pairs, ends, [end], "uses", total).drop("uses")
        both = F.size(F.array_intersect("a_hashes", "b_hashes")) + F.least("a_hidden", "b_hidden")
        out = stored(pairs.where(both * 100 >= (F.col("a_n") + F.col("b_n") - both) * self.percent).select("a", "b"), "similar")
        dropped(candidates)
        return out

    def done(self) -> None:
        dropped(self.sets)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct word
    shingles. A pair of similarity 0.85 meets in some band but for a chance of 3 in 10^7, of 0.8 of 2 in
    10^4. Null and empty texts and texts without words have no shingles and no link: each is kept.
    Repeated rows and repeated doc_ids keep their rows; rows whose doc_id is null are linked like any
    other and take the smallest id among the others; where there is none, component_id is null, and such
    rows are not kept. Other columns are not read. An empty table gives an empty result.
    """
    if not 75 <= percent <= 100:
        raise ValueError(f"{BANDS} bands of {BAND} find sets of similarity 0.75 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(sketches(rows, width), "sketches")
    same = made.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("low"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("n", "keys", "bits")])
    nodes = stored(with_bits(same.withColumn("node", F.monotonically_increasing_id())), "sets")
    confirmed = Confirmed(rows, nodes, width, percent)
    rule = Rule(
        attributes=("n", *BITS),
        near=lambda x, y: sizes_and_sketches_allow(x, y, percent),
        sure=lambda x, y: F.lit(False),
        verified=confirmed.links,
        prepared=confirmed.prepare,
    )
    roots = classes(nodes, slots(), rule)
    confirmed.done()
    named = with_smallest_id(nodes.select("node", "low", "name", "size"), roots)
    total = made.count()
    found = joined(made.where("n > 0").select("doc_id", "n", "name"), named.select("name", "size", "component_id"), ["name"], "size", total)
    none = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "n", "component_id").union(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
