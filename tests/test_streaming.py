"""Streams that read all that is available give what the batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.joins import title_fingerprint
from tidewatch.streaming import jobs
from tidewatch.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landed"))
    articles = Tables(spark, SF).articles.selectExpr("article_id", "source_id", "topic_id", "country_code", "title", "published_at")
    articles.orderBy("published_at").coalesce(1).write.mode("overwrite").parquet(folder)
    return folder


def _run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    jobs.to_batches(stream, out, str(tmp_path / "checkpoint"))
    return spark.read.parquet(out)


def test_tumbling_windows(spark, landed, tmp_path):
    got = _run(spark, jobs.tumbling(jobs.article_stream(spark, landed).withColumn("published_at", F.col("published_at"))), tmp_path)
    batch = spark.read.parquet(landed).groupBy(F.date_trunc("hour", "published_at").alias("window_start"), "country_code").agg(F.count("*").alias("n"))
    last = spark.read.parquet(landed).agg(F.max("published_at")).first()[0]
    done = batch.where(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    assert got.count() and sorted(map(tuple, got.select("window_start", "country_code", "n").collect())) == sorted(map(tuple, done.collect()))


def test_deduplication(spark, landed, tmp_path):
    got = _run(spark, jobs.deduplicated(jobs.article_stream(spark, landed), "40 days"), tmp_path)
    assert got.count() == spark.read.parquet(landed).select(title_fingerprint(F.col("title"))).distinct().count()


def test_health_states(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    Tables(spark, SF).jobs.select("job_id", "source_id", "status", "scheduled_at").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("job_id long, source_id long, status string, scheduled_at timestamp").parquet(folder)
    got = _run(spark, jobs.health_states(stream), tmp_path)
    from tidewatch.operators.folds import source_health_states

    batch = {r["source_id"]: r["status"] for r in source_health_states(Tables(spark, SF)).collect()}
    assert {r["source_id"]: r["status"] for r in got.collect()} == batch


def test_dead_letters(spark):
    messages = spark.createDataFrame([('{"article_id": 1}',), ("{broken",), ("{}",)], "value string")
    good, dead = jobs.split_dead(messages, "article_id long")
    assert [r[0] for r in good.collect()] == [1] and dead.count() == 2
