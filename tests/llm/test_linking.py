"""Joins of the inverted index: small compressed tables are no reason to broadcast postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm import linking, simhash


def test_postings_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], linking.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(linking, "stored", seen)
    fps = spark.range(300).selectExpr("CASE WHEN id < 100 THEN shiftleft(1L, CAST(id % 60 AS INT)) ELSE xxhash64(id) END AS fp").distinct()
    found = linking.with_smallest_id(fps.select(F.col("fp").alias("node"), F.col("fp").alias("low")), simhash.fingerprint_classes(fps))
    assert found.count() == fps.count()
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
