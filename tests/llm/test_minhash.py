"""Circulant MinHash: estimates, bands and classes against all pairs of whole sets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import minhash
from tidewatch.llm.shingles import distinct_hashes

SCHEMA = "doc_id long, text string, n long, name string, keys string, node string, low string, component_id int"


def _texts():
    draw = np.random.default_rng(11)
    word = lambda n: ["".join(map(chr, draw.integers(97, 123, 7))) for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "One two three four", "one two three four five", "One two\tthree four FIVE", "é b c d e f", "É b c d e f"]
    for length in (12, 60, 200, 200, 900):
        base = word(length)
        texts.append(" ".join(base))
        for share in (0.003, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06) * 4:
            copy = list(base)
            for at in np.flatnonzero(draw.random(length) < share):
                copy[at] = word(1)[0]
            texts.append(" ".join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    step = word(120)
    for at in range(0, 100, 5):  # neighbours are alike, ends are not
        step = step[:at] + word(1) + step[at + 1 :]
        texts.append(" ".join(step))
    template = word(80)
    texts += [" ".join([*word(30), *template]) for _ in range(60)]
    texts.append(" ".join(word(30_000)))
    texts += [texts[-1] + " end", texts[12]]
    return texts


def _shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(rows, percent=85):
    """Rows (doc_id, text) with their set size and smallest doc_id reachable, from all pairs."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((doc, len(s), low.get(top(i)), doc is not None and doc == low.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("percent", [85, 80, 100])
def test_classes_are_those_of_all_pairs(spark, percent):
    rows = [(3 * i + 5, t) for i, t in enumerate(_texts())]
    rows += [rows[20], (5, "an id that repeats with another text of more words"), (None, rows[40][1]), (None, "no id at all here today"), (None, None)]
    want = _brute(rows, percent)
    df = spark.createDataFrame([(*r, 7, "clash", "clash", "clash", "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, percent=percent).collect()), key=str)
    assert got == want and len({r[2] for r in want}) < len(rows) - 30
    if percent == 85:
        assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_all_equal_and_all_empty(spark):
    same = spark.createDataFrame([(i, "the same words stand in every row") for i in range(900)], "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(same).collect()} == {(i, 3, 0, i == 0) for i in range(900)}
    none = spark.createDataFrame([(i, "  ") for i in range(9)], "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(none).collect()} == {(i, 0, i, True) for i in range(9)}


def test_estimates_are_unbiased_and_spread_as_the_binomial():
    draw = np.random.default_rng(2)
    for j in (0.5, 0.85):
        found, bits = [], []
        for _ in range(300):
            both, apart = int(600 * j), 600 - int(600 * j)
            x = draw.integers(0, 1 << 63, both + apart, dtype=np.uint64)
            a, b = (minhash.signature(s) for s in (np.r_[x[:both], x[both : both + apart // 2]], np.r_[x[:both], x[both + apart // 2 :]]))
            found.append(np.mean(a == b))
            apart = (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64).reshape(minhash.PLANES, -1)
            bits.append(sum(int(v).bit_count() for v in np.bitwise_or.reduce(apart, axis=0)))
        assert np.mean(found) == pytest.approx(j, abs=0.006) and np.std(found) < 1.25 * (j * (1 - j) / minhash.COORDINATES) ** 0.5
        p = (1 - j) * (1 - 0.5**minhash.PLANES)
        assert np.mean(bits) == pytest.approx(minhash.COORDINATES * p, rel=0.03) and np.std(bits) < 1.25 * (minhash.COORDINATES * p * (1 - p)) ** 0.5


def test_a_dense_group_leaves_the_join_once(spark):
    """Copies of one text, most too far from it and from each other: no link is lost, no pair comes twice."""
    draw = np.random.default_rng(6)
    base = [f"w{i}" for i in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for at in draw.choice(140, i % 12, replace=False):
            copy[at] = f"new{i}x{at}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, rows[119][1] + f" tail{i}") for i in range(3)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == _brute(rows) and 20 < len({r[2] for r in got}) < 110


def test_coordinates_are_shifts_of_one_permutation():
    hashes = distinct_hashes(" ".join(f"w{i}" for i in range(50)), 5)
    mask = (1 << 64) - 1
    first, second, third = minhash.FACTORS

    def sigma(x):
        x = ((x ^ (x >> 33)) * first) & mask
        return x ^ (x >> 29)

    def pi(x):
        x = (x * second) & mask
        return ((x ^ (x >> 32)) * third) & mask

    want = [min(pi((sigma(int(h)) - k) & mask) for h in hashes) for k in range(minhash.COORDINATES)]
    assert minhash.signature(hashes).tolist() == want
