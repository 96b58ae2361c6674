"""Search in blocks against scores of all texts; what a plan reads."""

from __future__ import annotations

import random
import re

import pytest

from tidewatch.sources import blocks
from tidewatch.storage import new_path


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        for w in range(40):
            if rng.random() < 0.4 / (w + 1) + 0.01:
                best = float(rng.choice([1, 2]))
                rows.append((f"w{w}", i, best, best + rng.choice([0.0, 1.0])))
    rows += [("big", i, 1.0, 1.0) for i in range(900) if i != 450] + [("big", 450, 2.0, 3.0)]
    base = new_path(spark, "blocks")
    blocks.write_blocks(spark.createDataFrame(rows, "word string, article_id long, best double, total double"), base, 16, 20)
    return base, rows


def _brute(rows, words, k):
    score = {}
    for w, i, best, total in rows:
        if w in words:
            score[i] = score.get(i, 0.0) + best + 0.3 * (total - best)
    return sorted(((i, round(s, 4)) for i, s in score.items()), key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("words,k", [(["w0"], 5), (["w3", "w20", "w31"], 10), (["w30", "w0", "missing"], 3), (["w7", "w7"], 4), (["big"], 1), (["missing"], 5), ([], 5), (["w39"], 500)])
def test_the_best_texts_are_those_of_all(spark, index, words, k):
    base, rows = index
    seen = []
    got = [tuple(r) for r in blocks.best_texts(spark, base, words, k, 16, seen).collect()]
    assert got == _brute(rows, set(words), k)
    if words == ["big"]:
        assert seen == [45, 1]  # blocks that cannot reach the best score are not read


def test_a_search_opens_the_buckets_of_its_words_alone(spark, index):
    base, _ = index
    df = blocks.read_blocks(spark, base, ["w1", "w2"], 16)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in found[1] and "word" in found[2]
    assert df.select("bucket").distinct().count() <= 2
    assert df.select("word").distinct().count() == 2
