"""Language detection on held-out texts, mixed and empty ones."""

from __future__ import annotations

import pytest

from tidewatch.operators import language
from tidewatch.tables import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return Tables(spark, SF).texts


@pytest.fixture(scope="module")
def model(texts):
    return language.fit(texts)


def test_held_out_texts_are_told_apart(spark, texts, model):
    rows = language.detected(texts.where(language.held_out("article_id")), model).collect()
    assert len(rows) > 150 and sum(r["detected"] == r["language"] for r in rows) >= 0.95 * len(rows)
    assert all(r["found"] == (r["detected"] if r["confidence"] >= 0.8 else r["language"]) for r in rows)


def test_odd_texts(spark, texts, model):
    of = {r["language"]: r["content"] for r in texts.where("length(content) BETWEEN 1500 AND 4000").select("language", "content").collect()}
    assert {"en", "fr"} <= set(of)
    mixed = of["en"][:1500] + "\n" + of["fr"][:1500]
    rows = [(1, "en", of["fr"]), (2, "fr", of["fr"].upper()), (3, "de", mixed), (4, "es", ""), (5, "es", None), (6, "es", "12345 !?"), (7, None, of["en"])]
    got = {r["article_id"]: r for r in language.detected(spark.createDataFrame(rows, "article_id long, language string, content string"), model).collect()}
    assert [got[i]["found"] for i in (1, 2, 7)] == ["fr", "fr", "en"]
    assert got[3]["confidence"] < 0.8 and got[3]["found"] == "de"
    assert all(got[i]["detected"] is None and got[i]["confidence"] == 0 and got[i]["found"] == "es" for i in (4, 5, 6))


def test_without_texts_nothing_is_detected(spark, texts):
    none = language.fit(texts.limit(0))
    assert none.detect("some text") == (None, 0.0)
    assert language.fit(texts, 5).languages and len(language.fit(texts, 1).languages) == 1


def test_a_fit_orders_ids_alone(spark, texts, monkeypatch):
    """Texts of the sample never meet in one task; the model is that of the same ids read in one piece."""
    parts, kind = [], type(texts)

    def seen(self, *args, **how):
        parts.append(self.rdd.getNumPartitions())
        return original(self, *args, **how)

    original = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", seen)
    fitted = language.fit(texts, 50)
    assert parts == [language.FIT_TASKS]
    ids = [r[0] for r in texts.where(~language.held_out("article_id") & texts["language"].isNotNull()).selectExpr("article_id").orderBy(language.F.xxhash64("article_id"), "article_id").limit(50).collect()]
    rows = texts.where(texts["article_id"].isin(ids)).select("language", "content").collect()
    counts = {}
    for r in rows:
        own = counts.setdefault(r["language"], language.np.zeros(language.BUCKETS, language.np.int64))
        own += language.np.bincount(language.grams(r["content"]).ravel(), minlength=language.BUCKETS)
    want = language.model_of(counts)
    assert want.languages == fitted.languages and (want.weights == fitted.weights).all()
