"""The stages of the corpus pipeline, on the smallest tables and on planted rows."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import pytest

from tidewatch.llm import simhash
from tidewatch.llm.shared import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, after := stored(stage(spark, docs, SF), "test"))
        docs = after
    return out


def test_stages_keep_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_quality_follows_labels(spark, stages):
    before, after = stages["quality classifier"]
    kept = {r[0] for r in after.select("doc_id").collect()}
    labels = table(spark, SF, "labels").collect()
    assert all(r["doc_id"] in kept for r in labels if r["quality"] == 1)
    assert sum(r["doc_id"] in kept for r in labels if r["quality"] == 0) <= 0.1 * len(labels)


def test_one_of_equal_texts_stays(stages):
    before, after = stages["exact dedup"]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    want = defaultdict(int)
    for r in before.collect():
        want[low(r["text"])] = max(want[low(r["text"])], r["doc_id"])
    assert sorted(want.values()) == sorted(r["doc_id"] for r in after.collect())


def similar(a, b):
    x, y = (set(simhash.distinct_hashes(t, 5).tolist()) for t in (a, b))
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def test_one_of_near_copies_stays(stages):
    before, after = stages["simhash near-dedup"]
    rows = {r["doc_id"]: (simhash.fingerprint(r["text"]), r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert kept <= set(rows)
    near = lambda a, b: (rows[a][0] ^ rows[b][0]).bit_count() <= 4 or similar(rows[a][1], rows[b][1])
    for doc in set(rows) - kept:
        assert any(near(doc, o) for o in rows if o != doc)
    assert not any(near(a, b) for a in kept for b in kept if a < b)


def test_secrets_go_and_documents_stay(stages):
    before, after = stages["secret scans"]
    assert before.count() == after.count() and after.where("text RLIKE 'AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}'").count() == 0


def test_all_tokens_are_packed(stages):
    before, after = stages["packing"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
