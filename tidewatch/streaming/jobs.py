"""Streaming forms: file source to windows, deduplication, stateful source health and idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.folds import CONFIG
from tidewatch.session import ship
from tidewatch.sources.files import new_folder

ARTICLES = "article_id long, source_id long, topic_id string, country_code string, title string, published_at timestamp"


def article_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """Landed articles as a stream, files at a time."""
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(articles: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Articles per country and window; a window is final once the watermark passes it."""
    windows = articles.withWatermark("published_at", late).groupBy(F.window("published_at", width).alias("w"), "country_code")
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "country_code", "n")


def sliding(articles: DataFrame, width: str = "24 hours", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """The trailing day, again at every step."""
    windows = articles.withWatermark("published_at", late).groupBy(F.window("published_at", width, step).alias("w"), "topic_id")
    return windows.agg(F.count("*").alias("n"), F.approx_count_distinct("source_id").alias("sources")).select(F.col("w.end").alias("window_end"), "topic_id", "n", "sources")


def topic_sessions(articles: DataFrame, gap: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Activity of topics: a topic idle for gap is over."""
    windows = articles.withWatermark("published_at", late).groupBy(F.session_window("published_at", gap).alias("w"), "topic_id")
    return windows.agg(F.count("*").alias("n")).select("topic_id", F.col("w.start").alias("first_seen"), F.col("w.end").alias("idle_at"), "n")


def deduplicated(articles: DataFrame, keep: str = "72 hours") -> DataFrame:
    """One report of each title fingerprint within keep."""
    from tidewatch.operators.joins import title_fingerprint

    return articles.withColumn("fingerprint", title_fingerprint(F.col("title"))).withWatermark("published_at", keep).dropDuplicatesWithinWatermark(["fingerprint"])


def split_dead(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed messages (column value), and the dead letters that do not parse."""
    parsed = messages.withColumn("p", F.from_json("value", schema))
    bad = F.col("p").isNull() | F.col(f"p.{schema.split()[0]}").isNull()
    return parsed.where(~bad).select("p.*"), parsed.where(bad).select("value")


HEALTH = "source_id long, status string, failures long"
STATE = "status string, bad long, good long, since timestamp"


def health_states(jobs: DataFrame) -> DataFrame:
    """Status of a source after each batch, from state kept between batches."""
    ship(jobs.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, bad, good, since = state.get if state.exists else ("active", 0, 0, pd.Timestamp(0).to_pydatetime())
        rows = pd.concat(list(batches)).sort_values(["scheduled_at", "job_id"])
        for r in rows.itertuples():
            if r.status == "pending":
                continue
            failed = r.status.endswith("failure")
            bad, good = (bad + 1, 0) if failed else (0, good + 1)
            if status == "active" and bad >= CONFIG.degrade_after:
                status, since = "degraded", r.scheduled_at.to_pydatetime()
            elif status == "degraded" and failed and (r.scheduled_at - pd.Timestamp(since)).total_seconds() > CONFIG.fail_hours * 3600:
                status = "failed"
            elif status in ("degraded", "failed") and good >= CONFIG.recover_after:
                status = "active"
        state.update((status, bad, good, since))
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "failures": [bad]})

    return jobs.groupBy("source_id").applyInPandasWithState(step, HEALTH, STATE, "append", "NoTimeout")


def to_batches(stream: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Everything available, written batch by batch under the batch's number: a batch that runs again replaces itself."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
