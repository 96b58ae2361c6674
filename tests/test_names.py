"""Names in texts by one automaton, against a search for each name."""

from __future__ import annotations

import random
import re
import time

import pytest

from tidewatch.operators import names


def _brute(texts, wanted, whole):
    out = set()
    for key, text in texts:
        low = (text or "").lower()
        for name in {(w or "").lower() for w in wanted} - {""}:
            pattern = f"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])" if whole else re.escape(name)
            n = len(re.findall(pattern, low))
            if n:
                out.add((key, name, n))
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_hits_are_those_of_every_name(spark, whole, most_bytes):
    rng = random.Random(5)
    wanted = ["aa", "aba", "ab", "Ab c", "北京", "北京市", "新华社", "x", "x-y", "", None, "aa", "é"] + ["".join(rng.choices("ab ", k=rng.randint(1, 4))).strip() or "q" for _ in range(12)]
    texts = [(i, "".join(rng.choices("abx- 北京市新华社é\n", k=60))) for i in range(40)] + [(90, None), (91, ""), (92, "AA aa-AA 在北京市,北京"), (93, "ab " * 5000)]
    df = spark.createDataFrame(texts, "article_id long, content string").repartition(3)
    known = spark.createDataFrame([(w,) for w in wanted], "name string")
    assert {tuple(r) for r in names.name_hits(df, known, whole, most_bytes).collect()} == _brute(texts, wanted, whole)
    assert names.name_hits(df, known.limit(0), whole).count() == 0 and names.name_hits(df.limit(0), known, whole).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_words_seen_before_cost_no_search(monkeypatch, whole):
    searched, places = [], names._places
    monkeypatch.setattr(names, "_places", lambda automaton, text, whole: searched.append(text if len(automaton) else "") or places(automaton, text, whole))
    finder = names.Finder(["aa", "baa", "c"], whole)
    for _ in range(3):
        assert dict(finder.counts("aaaa baa baa, c")) == ({"baa": 2, "c": 1} if whole else {"aa": 4, "baa": 2, "c": 1})
    assert sorted(t for t in searched if t) == ([] if whole else ["aaaa", "baa", "c"])


def test_many_names_cost_as_few():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(60_000))
    words = ["".join(rng.choices("klmnopqrst", k=8)) for _ in range(10_000)]

    def took(n):
        finder = names.Finder(words[:n], True)
        best = 1e9
        for _ in range(5):
            start = time.perf_counter()
            finder.counts(text)
            best = min(best, time.perf_counter() - start)
        return best

    assert took(10_000) < 2 * took(10)
