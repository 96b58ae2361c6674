"""Exact dedup by deterministic block naming, on DataFrame functions alone.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered, so a
block's name is an integer that equal blocks share and no others. Pairs of adjacent names are then
sorted and numbered in turn, again and again, until one name is left for each document. A name
together with the number of rounds it took identifies a text: there are no collisions to hope
away. Texts cross the network once, as distinct blocks after a map-side combine; documents carry
128-bit block keys, and the run checks on the blocks themselves that no two share a key (else it
takes other keys).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import ascii_lower, dropped, joined, keyed, stored, table

BLOCK_BYTES = 4096
MAX_TRIES = 8


def block_key(block: Column, attempt: int) -> Column:
    """A 128-bit key of a block; attempt picks another pair of hash functions."""
    return F.struct(F.xxhash64(F.lit(2 * attempt), block).alias("a"), F.xxhash64(F.lit(2 * attempt + 1), block).alias("b"))


def _blocks(norm: Column, size: int) -> Column:
    data = norm.cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(norm) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """The normalised text and its blocks. Both are used above, so that the text is normalised once."""
    norm = docs.withColumn("norm", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return norm.withColumn("blocks", _blocks(F.col("norm"), size))


def numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows, sorted in their partitions and given integer names in that order."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK_BYTES, key: Callable[[Column, int], Column] = block_key, extra: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, extra columns, sha, rounds, name): rows share (rounds, name) exactly if their texts are equal.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. rid numbers the
    rows, so rows that repeat a doc_id stay apart.
    """
    docs = docs.select("doc_id", "text", *extra)
    for attempt in range(MAX_TRIES):
        cut = _cut(docs, size).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", *extra, F.sha2("norm", 256).alias("sha"),
            F.transform("blocks", lambda b: key(b, attempt)).alias("keys"),
        )
        rows = stored(cut, "blocks")
        blocks = _cut(docs, size).select(F.col("norm"), F.explode("blocks").alias("block")).select(key(F.col("block"), attempt).alias("k"), "block").distinct()
        names = stored(numbered(blocks.select("k.a", "k.b", "block"), "a", "b", "block").select("a", "b", "name"), "names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
        dropped(rows, names)
    else:
        raise RuntimeError(f"block keys clashed in {MAX_TRIES} tries")
    placed = rows.select("rid", F.posexplode("keys").alias("pos", "k")).select("rid", "pos", "k.a", "k.b")
    state = stored(placed.join(names, ["a", "b"]).select("rid", "pos", "name"), "level")
    finals, rounds, tables = [], 0, [names]
    counts = rows.select("rid", F.size("keys").alias("n"))
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    level = state.join(counts, "rid")
    while True:
        finals.append(level.where("n <= 1").select("rid", F.lit(rounds).alias("rounds"), "name"))
        if most <= 1:
            break
        pairs = level.where("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.lit(-1)).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = stored(pairs, "pairs")
        named = numbered(pairs.select("l", "r").distinct(), "l", "r")
        level = stored(pairs.join(stored(named, "names"), ["l", "r"]).select("rid", "pos", "n", "name"), "level")
        rounds, most = rounds + 1, (most + 1) // 2
    out = finals[0]
    for df in finals[1:]:
        out = out.union(df)
    return rows.select("rid", "doc_id", *extra, "sha").join(out, "rid")


def exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, extra columns (none clash with these names), keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays; of rows that repeat that
    doc_id, the first. Null doc_ids are smaller than any other. Null texts count as empty; very
    long texts only take more rounds. Other columns are not read; an empty table gives no rows.
    """
    rows = stored(identities(docs, size, extra=extra), "identities")
    best = rows.groupBy("rounds", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), (-F.max(F.struct("doc_id", -F.col("rid")))["col2"]).alias("best"),
    )
    out = joined(rows, stored(best, "best"), ["rounds", "name"], "group_size", rows.count())
    kept = F.col("rid") == F.col("best")
    return out.select("doc_id", *extra, "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op8_block_naming(spark, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays; see exact_duplicates()."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


def deduplicated(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that exact_duplicates() drops; columns and texts stay as they are, whatever
    their names. Null texts count as empty, of equal texts the largest doc_id stays (nulls last), of repeated
    rows one; an empty table stays empty."""
    rows, key = keyed(docs)
    kept = exact_duplicates(rows, size, (key,)).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)
