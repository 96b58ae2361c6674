"""Words and vectors of texts that travel whole."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tidewatch.operators import aggregates, scalars
from tidewatch.tables import Tables

TEXTS = [(i, " ".join(["the"] * (i % 4 + 1) + ["of"] * (i % 3) + [f"w{chr(97 + i % 5)}x", f"rare{chr(97 + i % 26)}", "Token token", "ab cd ef gh"][: i % 5])) for i in range(40)] + [(41, None), (42, "")]


@pytest.mark.parametrize("hot", (1, 3, 2000))
def test_label_words_are_those_of_all_words(spark, hot):
    """However few frequencies are known beforehand, no word that belongs to a text's best is left out."""
    counts = {i: Counter(re.findall("[a-z]{2,}", (c or "").lower())) for i, c in TEXTS}
    df = Counter(w for c in counts.values() for w in c)
    score = lambda f, w: round(f * (math.log((len(TEXTS) + 1) / (df[w] + 1)) + 1) * min(len(w), 4), 6)
    want = {(i, w) for i, c in counts.items() for _, w in sorted((-score(f, w), w) for w, f in c.items())[:3]}
    t = Tables(spark, texts=spark.createDataFrame(TEXTS, "article_id long, content string"))
    assert {(r["article_id"], r["w"]) for r in aggregates.label_keywords(t, 3, hot).collect()} == want


def test_shingles_stay_where_their_text_is(spark):
    t = Tables(spark, texts=spark.createDataFrame(TEXTS, "article_id long, content string"))
    out = scalars.hashed_vectors(t)
    assert sum(r["n"] for r in out.collect()) == sum(max(len(re.findall("[a-z]+", (c or "").lower())) - 2, 0) for _, c in TEXTS)
    assert not re.search(r"Exchange hashpartitioning\(article_id#\d+L?, dim", out._jdf.queryExecution().executedPlan().toString())
