"""A full-text index in blocks: search reads the blocks of its words that can still reach the best texts, no other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ship

BUCKETS = 64
SPAN = 4096
TIE_BREAK = 0.3
BLOCK = "word string, slice long, largest double, ids array<long>, scores array<double>, bucket int"
DIGITS = 4
#: Words of texts that a task packs at once, about.
TOGETHER = 2_000_000
PACKED = "word string, slice long, ids array<long>, fields array<tinyint>"


def bucket_of(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def slice_of(article: Column, span: int = SPAN) -> Column:
    return F.floor(article / span)


def packed(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """Postings of texts (article_id, title, content) in blocks: word, slice, ids, and for each id the fields that hold
    the word, content as 1 and title as 2.

    Texts are dealt by slices of span successive ids, and a task packs some at a time, so words do not travel one by one. Rows of one
    article count as one text. A word has one block in a slice, or a few where a task has packed the slice in parts.
    """
    ship(texts.sparkSession)
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(c, "\n")), r"[^\p{L}\p{N}]+")), "")
    dealt = texts.select("article_id", "title", "content", slice_of(F.col("article_id"), span).alias("slice")).repartition("slice")
    whole = dealt.groupBy("slice", "article_id").agg(F.collect_list("title").alias("title"), F.collect_list("content").alias("content"))
    return whole.select("slice", "article_id", words(F.col("title")).alias("title"), words(F.col("content")).alias("content")).mapInArrow(_pack, PACKED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += sum(len(batch[c].flatten()) for c in ("title", "content"))
        if n >= TOGETHER:
            yield from _blocks(held)
            held, n = [], 0
    if n:
        yield from _blocks(held)


def _blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of some texts in order of word, slice and id, cut where word or slice change."""
    texts = pa.Table.from_batches(held).sort_by([("slice", "ascending"), ("article_id", "ascending")]).combine_chunks()
    slices, ids, title, content = (texts[c].combine_chunks() for c in ("slice", "article_id", "title", "content"))
    found = pa.concat_arrays([title.flatten(), content.flatten()]).dictionary_encode()
    row = np.concatenate([np.repeat(np.arange(len(ids)), pc.list_value_length(c).to_numpy()) for c in (title, content)])
    field = np.repeat(np.array([2, 1]), [len(title.flatten()), len(content.flatten())])
    key = np.sort((found.indices.to_numpy().astype(np.int64) * len(ids) + row) * 4 + field)
    first = np.flatnonzero(np.diff(key >> 2, prepend=-1))
    fields = np.add.reduceat(key & 3, first).astype(np.int8)
    word, row = np.divmod(key[first] >> 2, len(ids))
    part = slices.dictionary_encode(null_encoding="encode").indices.to_numpy()[row]
    starts = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    bounds = pa.array(np.append(starts, len(word)).astype(np.int32))
    columns = [found.dictionary.take(pa.array(word[starts])), slices.take(pa.array(row[starts])), pa.ListArray.from_arrays(bounds, ids.take(pa.array(row))), pa.ListArray.from_arrays(bounds, pa.array(fields))]
    yield from pa.table(columns, ["word", "slice", "ids", "fields"]).to_batches(max_chunksize=65_536)


def write_texts(texts: DataFrame, base: str, buckets: int = BUCKETS, span: int = SPAN) -> None:
    """write_blocks() of the postings of texts (article_id, title, content), where a word of the title weighs twice that of the content."""
    score = lambda f: F.when(f == 1, 1.0).when(f == 2, 2.0).otherwise(2.0 + TIE_BREAK)
    rows = packed(texts, span).withColumn("scores", F.transform("fields", score))
    _store(rows.select("word", "slice", F.array_max("scores").alias("largest"), "ids", "scores"), base, buckets)


def write_blocks(postings: DataFrame, base: str, buckets: int = BUCKETS, span: int = SPAN) -> None:
    """Pack postings (word, article_id, best, total), one of each word and article, into blocks under base.

    A word's score in a text is its best field and TIE_BREAK of its others. A block holds a word's postings of
    span successive article ids and the largest score among them. Files lie in folders by the word's bucket, in order of
    words, so a reader of few words opens few folders and few row groups.
    """
    score = F.col("best") + TIE_BREAK * (F.col("total") - F.col("best"))
    rows = postings.select("word", slice_of(F.col("article_id"), span).alias("slice"), F.struct("article_id", score.alias("score")).alias("p"))
    blocks = rows.groupBy("word", "slice").agg(F.max("p.score").alias("largest"), F.array_sort(F.collect_list("p")).alias("p"))
    _store(blocks.select("word", "slice", "largest", F.col("p.article_id").alias("ids"), F.col("p.score").alias("scores")), base, buckets)


def _store(blocks: DataFrame, base: str, buckets: int) -> None:
    dealt = blocks.withColumn("bucket", bucket_of(F.col("word"), buckets))
    dealt.repartition("bucket", F.pmod(F.xxhash64("slice"), F.lit(16))).sortWithinPartitions("bucket", "word", "slice").write.mode("overwrite").partitionBy("bucket").parquet(base)


def read_blocks(spark: SparkSession, base: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The blocks of some words: a scan of their buckets' folders, filtered by word."""
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("w")).select(bucket_of(F.col("w"), buckets)).distinct().collect()] if words else []
    rows = spark.read.schema(BLOCK).parquet(base)
    return rows.where(F.col("bucket").isin(wanted) & F.col("word").isin(words))


def best_texts(spark: SparkSession, base: str, words: list[str], k: int, buckets: int = BUCKETS, seen: list[int] | None = None) -> DataFrame:
    """(article_id, score): the k texts with the largest sums of the words' scores, ties to the smaller id.

    A slice of ids can hold no sum above that of its blocks' largest scores. The k slices of the highest such bounds are
    read first; the k-th score in them rules out all slices whose bound lies below it, whose postings are
    not read. Words that are not in the index add nothing; without words, or with none found, there are no rows. seen gets the number of blocks
    that the words have and of those read.
    """
    blocks = read_blocks(spark, base, sorted(set(words)), buckets)
    bounds = blocks.groupBy("slice").agg(F.sum("largest").alias("bound"), F.count("*").alias("blocks"))
    seeds = bounds.orderBy(F.desc("bound"), "slice").limit(k).collect()

    def scored(rows: DataFrame) -> DataFrame:
        each = rows.select(F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(F.col("p.ids").alias("article_id"), F.col("p.scores").alias("s"))
        return each.groupBy("article_id").agg(F.round(F.sum("s"), DIGITS).alias("score")).orderBy(F.desc("score"), "article_id").limit(k)

    first = scored(blocks.where(F.col("slice").isin([r["slice"] for r in seeds]))).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = first["least"] - 10.0**-DIGITS if first["n"] == k else 0.0
    open_slices = bounds.where(F.col("bound") >= least)
    if seen is not None:
        seen += [bounds.agg(F.sum("blocks")).first()[0] or 0, open_slices.agg(F.sum("blocks")).first()[0] or 0]
    return scored(blocks.join(open_slices.select("slice"), "slice", "left_semi"))
