"""Files in the folder that all machines share: buffers and versioned datasets behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.blocks import PACKED, SPAN, bucket_of, packed, slice_of
from tidewatch.storage import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share."""
    return f"{shared_folder(spark)}/tidewatch-{name}/{uuid.uuid4().hex}"


class Buffer:
    """A rolling buffer of delimited pulls under one folder, each named by its time.

    A pull is written whole before it counts (its success mark); the newest keep of them stay, and
    a reader takes the latest whole one, so a failed pull leaves the one before in use.
    """

    def __init__(self, spark: SparkSession, schema: str, base: str | None = None, keep: int = 96):
        self.spark, self.schema, self.base, self.keep = spark, schema, base or new_folder(spark, "buffer"), keep
        self.fs, self.path = _fs(spark, self.base)

    def names(self, whole: bool = True) -> list[str]:
        if not self.fs.exists(self.path(self.base)):
            return []
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.base)))
        return [n for n in found if not whole or self.fs.exists(self.path(f"{self.base}/{n}/_SUCCESS"))]

    def add(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"{self.base}/{name}")
        self._prune()

    def touch(self, name: str, whole: bool = True) -> None:
        """An empty pull, or the traces of one that failed."""
        self.fs.mkdirs(self.path(f"{self.base}/{name}"))
        if whole:
            self.fs.create(self.path(f"{self.base}/{name}/_SUCCESS"), True).close()
        self._prune()

    def _prune(self) -> None:
        for name in self.names()[: -self.keep]:
            self.fs.delete(self.path(f"{self.base}/{name}"), True)

    def latest(self) -> DataFrame:
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("header", True).csv(f"{self.base}/{names[-1]}")


INDEX_BUCKETS = 64


def write_index(texts: DataFrame, base: str, batch: int, buckets: int = INDEX_BUCKETS) -> None:
    """Postings of the texts of one batch (article_id, title, content), packed, in buckets by word, and the batch's articles;
    a batch that runs again replaces itself."""
    dealt = packed(texts).withColumn("bucket", bucket_of(F.col("word"), buckets))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings/batch={batch}")
    texts.select("article_id").distinct().write.mode("overwrite").parquet(f"{base}/articles/batch={batch}")


def read_index(spark: SparkSession, base: str, words: list[str] | None = None, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The packed postings (word, ids, fields) of some words or of all: of each article, those of the last batch that holds it.

    Where articles of a slice came again in a later batch, a flag for each id of the slice says so.
    """
    rows = spark.read.schema(f"{PACKED}, batch int, bucket int").option("basePath", f"{base}/postings").parquet(f"{base}/postings")
    articles = spark.read.schema("article_id long, batch int").option("basePath", f"{base}/articles").parquet(f"{base}/articles")
    again = articles.groupBy("article_id").agg(F.sort_array(F.collect_set("batch")).alias("batches")).where(F.size("batches") > 1)
    old = again.select("article_id", slice_of(F.col("article_id")).alias("slice"), F.explode(F.expr("slice(batches, 1, size(batches) - 1)")).alias("batch"))
    places = old.groupBy("slice", "batch").agg(F.collect_list(F.pmod("article_id", F.lit(SPAN))).alias("places"))
    gone = places.select("slice", "batch", F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda i: F.array_contains("places", i.cast("long"))).alias("gone"))
    if words is not None:
        wanted = {r[0] for r in spark.createDataFrame([(w,) for w in words], "word string").select(bucket_of(F.col("word"), buckets)).collect()}
        rows = rows.where(F.col("bucket").isin(*wanted) & F.col("word").isin(*words))
    live = lambda article: ~F.coalesce(F.get("gone", F.pmod(article, F.lit(SPAN)).cast("int")), F.lit(False))
    kept = {"ids": F.filter("ids", live), "fields": F.filter("fields", lambda f, i: live(F.get("ids", i)))}
    found = rows.join(gone, ["slice", "batch"], "left").select("word", *[F.when(F.col("gone").isNull(), F.col(c)).otherwise(x).alias(c) for c, x in kept.items()])
    return found.where(F.size("ids") > 0)


def publish(df: DataFrame, name: str, base: str | None = None) -> str:
    """Write a new version, then point to it: readers see the old version or the new one, whole."""
    spark = df.sparkSession
    base = base or new_folder(spark, name)
    version = uuid.uuid4().hex
    df.write.parquet(f"{base}/versions/{version}")
    fs, path = _fs(spark, base)
    part, pointer = path(f"{base}/.pointer-{version}"), path(f"{base}/pointer")
    out = fs.create(part, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(part, pointer)
    return base


def read_published(spark: SparkSession, base: str, schema: str) -> DataFrame:
    version = spark.read.text(f"{base}/pointer").first()[0]
    return spark.read.schema(schema).parquet(f"{base}/versions/{version}")


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
