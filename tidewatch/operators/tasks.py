"""Tasks for an external text service, each with the result that stands where none answers; small client-side rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.filters import display_name
from tidewatch.session import ship
from tidewatch.tables import Tables

CATEGORIES = ("politics", "economy", "society", "technology", "health", "environment", "other")


def asked(df: DataFrame, prompt: str, client: Callable[[list[str]], list[str | None]] | None, degraded: str) -> DataFrame:
    """df with answer and degraded: a client's answers to column prompt, else what column degraded holds.

    The client is called once a batch in the executors; a call that fails degrades its batch alone.
    """
    if client is None:
        return df.withColumns({"answer": F.col(degraded), "degraded": F.lit(True)})
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                found = client(pdf[prompt].tolist())
            except Exception:  # the service's failure is not the job's
                found = [None] * len(pdf)
            yield pdf.assign(answer=[a if a is not None else d for a, d in zip(found, pdf[degraded], strict=True)], degraded=[a is None for a in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, answer string, degraded boolean")


@operator("llm_naming", "SELECT topic_id, coalesce(string_agg(keyword, ' ' ORDER BY position), '') AS answer, true AS degraded FROM topic_keywords WHERE position < 3 GROUP BY topic_id")
def naming(t: Tables, client=None) -> DataFrame:
    """Topic names; without a service the first three keywords."""
    words = t.topic_keywords.where("position < 3").groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "keyword"))), lambda x: x["keyword"]), " ").alias("plain"))
    return asked(words.withColumn("prompt", F.concat(F.lit("Name: "), "plain")), "prompt", client, "plain").select("topic_id", "answer", "degraded")


@operator("llm_category", "SELECT task, label AS answer, CASE WHEN label IN ('" + "', '".join(CATEGORIES) + "') THEN label ELSE 'other' END AS category, count(*) AS n FROM judgements GROUP BY ALL")
def categories(t: Tables) -> DataFrame:
    """Answers brought to the closed set of categories."""
    closed = F.when(F.col("label").isin(*CATEGORIES), F.col("label")).otherwise("other")
    return t.judgements.groupBy("task", F.col("label").alias("answer"), closed.alias("category")).agg(F.count("*").alias("n"))


@operator("src_12", "SELECT job_id, status = 'temporary_failure' AND retry_count < 3 AS resend FROM jobs")
def resend(t: Tables, most: int = 3) -> DataFrame:
    """Submissions that are sent again: transient failures, up to a number of tries."""
    return t.jobs.select("job_id", ((F.col("status") == "temporary_failure") & (F.col("retry_count") < most)).alias("resend"))


@operator("src_21", "SELECT entity_id, coalesce(nullif(name_zh, ''), name) AS name, true AS is_seed FROM entities WHERE priority = 4")
def watch_list(t: Tables) -> DataFrame:
    """Watched entities as a load upserts them: seeds from then on."""
    return t.entities.where("priority = 4").select("entity_id", display_name(F.col("name_zh"), F.col("name")).alias("name"), F.lit(True).alias("is_seed"))


@operator("src_25", "SELECT audit_id FROM audit WHERE \"at\" < :now - INTERVAL '25' DAY")
def expired(t: Tables, days: int = 25) -> DataFrame:
    """Records past their retention."""
    return t.audit.where(F.col("at") < t.now - F.expr(f"INTERVAL '{days}' DAY")).select("audit_id")


@operator("seq_40", "SELECT task, CAST(min(judgement_id) AS BIGINT) AS opened FROM (SELECT task, judgement_id, NOT ok AND lag(NOT ok) OVER w AND lag(NOT ok, 2) OVER w AS trip FROM judgements WINDOW w AS (PARTITION BY task ORDER BY created_at, judgement_id)) x WHERE trip GROUP BY task")
def breaker_trips(t: Tables) -> DataFrame:
    """Where three failures in a row first open a task's breaker."""
    from pyspark.sql import Window as W

    w = W.partitionBy("task").orderBy("created_at", "judgement_id")
    failed = lambda k: F.coalesce(F.lag(~F.col("ok"), k).over(w), F.lit(False))
    trips = t.judgements.select("task", "judgement_id", (~F.col("ok") & failed(1) & failed(2)).alias("trip")).where("trip")
    return trips.groupBy("task").agg(F.min("judgement_id").alias("opened"))


@operator("fn_33", "SELECT rule_id, CASE condition WHEN 'growth_rate' THEN concat('grows by ', CAST(CAST(threshold AS INT) AS VARCHAR), ' % or more') WHEN 'top_n' THEN concat('among the first ', CAST(CAST(threshold AS INT) AS VARCHAR)) ELSE concat('negative share above ', CAST(CAST(round(threshold * 100) AS INT) AS VARCHAR), ' %') END AS text FROM rules")
def condition_texts(t: Tables) -> DataFrame:
    whole = F.col("threshold").cast("int").cast("string")
    text = F.when(F.col("condition") == "growth_rate", F.concat(F.lit("grows by "), whole, F.lit(" % or more"))).when(F.col("condition") == "top_n", F.concat(F.lit("among the first "), whole))
    return t.rules.select("rule_id", text.otherwise(F.concat(F.lit("negative share above "), F.round(F.col("threshold") * 100).cast("int").cast("string"), F.lit(" %"))).alias("text"))


@operator("src_04", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'tls' ELSE 'plain' END AS scheme, length(html) AS n FROM pages")
def landed(t: Tables) -> DataFrame:
    """Pages as fetchers land them; fetching itself is left to collectors."""
    return t.pages.select("page_id", F.when(F.col("url").startswith("https://"), "tls").otherwise("plain").alias("scheme"), F.char_length("html").alias("n"))
