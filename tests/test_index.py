"""Postings packed where their texts are: rows, marks of fields, and what travels."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from tidewatch.operators import sinks
from tidewatch.sources import blocks, files
from tidewatch.tables import Tables

TEXTS = [(1, "The Token", "the token, THE licence"), (2, "", "token"), (1, "again", "token again"), (5, "license", None), (9, None, "— the é2 —"), (40, "Token", "x"), (None, "the", "token")]
SCHEMA = "article_id long, title string, content string"


def _postings(rows):
    out = {}
    for i, *texts in rows:
        for field, text in zip((2, 1), texts):
            for w in re.findall(r"[^\W_]+", (text or "").lower()):
                out.setdefault((w, i), set()).add(field)
    return {k: sum(v) for k, v in out.items()}


def _flat(rows):
    got = [((r["word"], i), f) for r in rows for i, f in zip(r["ids"], r["fields"])]
    assert len(got) == len(dict(got))
    return dict(got)


def test_postings_are_packed_without_travelling_one_by_one(spark):
    df = blocks.packed(spark.createDataFrame(TEXTS, SCHEMA), 4)
    rows = df.collect()
    assert _flat(rows) == _postings(TEXTS)
    assert all(i is None or i // 4 == r["slice"] for r in rows for i in r["ids"])
    assert len(rows) == len({(r["word"], r["slice"]) for r in rows})
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("together", [1, 3, 10_000])
def test_packing_in_parts_loses_nothing(monkeypatch, together):
    monkeypatch.setattr(blocks, "TOGETHER", together)
    texts = [(0, 4, ["a"], ["a", "b"]), (0, 2, [], ["b"]), (1, 7, ["c"], []), (1, 6, ["a"], ["a"]), (2, 8, [], [])]
    held = [pa.RecordBatch.from_pylist([dict(zip(("slice", "article_id", "title", "content"), t))], pa.schema([("slice", pa.int64()), ("article_id", pa.int64()), ("title", pa.list_(pa.string())), ("content", pa.list_(pa.string()))])) for t in texts]
    rows = [r for b in blocks._pack(iter(held)) for r in b.to_pylist()]
    assert _flat(rows) == {("a", 4): 3, ("b", 4): 1, ("b", 2): 1, ("c", 7): 2, ("a", 6): 3}
    assert list(blocks._pack(iter(held[4:]))) == []


def test_a_word_of_an_articles_repeated_rows_counts_once(spark):
    texts = spark.createDataFrame([(3, "", "token"), (3, "", "the token"), (4, "The", "the")], SCHEMA)
    assert [tuple(r) for r in sinks.search(Tables(spark, texts=texts)).collect()] == [(4, 2.3), (3, 2.0)]


def test_the_last_batch_of_an_article_counts_even_without_words(spark):
    base = files.new_folder(spark, "index")
    first = [(i, f"t{i}", "common" + " old" * (i % 2)) for i in range(6)] + [(5000, "far", "common")]
    batches = [first, [(1, "", ""), (2, "new", "common"), (7, "late", "common")], [(2, "newer", "rare")]]
    for n in (0, 0, 1, 2, 1):
        files.write_index(spark.createDataFrame(batches[n], SCHEMA), base, n)
    last = {r[0]: r for batch in batches for r in batch}
    want = _postings(last.values())
    assert _flat(files.read_index(spark, base).collect()) == want
    assert _flat(files.read_index(spark, base, ["common", "new", "t3"]).collect()) == {k: f for k, f in want.items() if k[0] in ("common", "new", "t3")}
