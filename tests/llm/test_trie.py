"""The prefix trie against a dictionary of prefixes, in many small blocks and rounds."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewatch.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, name string, lengths string"


def _brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, trie_name(role, text), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return _nodes(whole)


def trie_name(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def _nodes(whole):
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
    out = set()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _rows(seed, convs, alphabet, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice("ua"), rng.choice(alphabet), "clash", 1, "clash", "clash"))
    return rows


def _got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,convs,alphabet,longest,blocks,fan_in", [(1, 230, ["a", "é𝒳", ""], 4, 50, 3), (2, 120, ["x"], 9, 7, 2), (3, 90, ["hello", "bye", "a b"], 3, 1000, 32), (4, 60, ["q"], 2, 1, 2)])
def test_trie_is_the_dictionary_of_prefixes(spark, seed, convs, alphabet, longest, blocks, fan_in):
    rows = _rows(seed, convs, alphabet, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(trie.prefix_trie(trie.rebuilt(df), blocks, fan_in)) == _brute(rows)


def test_many_equal_conversations_over_many_blocks(spark):
    rows = [(c, t, "user", f"t{t}", "", 0, "", "") for c in range(0, 4000, 10) for t in range(6)]
    rows += [(c, t, "user", f"t{t}" if t < 6 else f"c{c}", "", 0, "", "") for c in range(5, 1000, 10) for t in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(trie.prefix_trie(trie.rebuilt(df), 20, 4)) == _brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "lost"), (7, None, "u", "first"), (7, None, "a", "also first"), (7, 3, None, None), (7, 3, None, None), (7, 1, "u", ""), (8, 0, "", ""), (9, 0, "u", "x" * 100_000), (200, 0, "u", "x" * 100_000), (100, 5, "u", "p"), (100, 4, "u", "q"), (-3, 0, "u", "p")]
    rows = [(*r, "", 0, "", "") for r in rows]
    got = _got(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == _brute([r for r in rows if r[0] != -3] + [(-3, 0, "u", "p")])
    empty = spark.createDataFrame([], SCHEMA)
    assert _got(trie.prefix_trie(trie.rebuilt(empty))) == set()


def test_a_conversation_alone_and_one_without_turns(spark):
    lone = spark.createDataFrame([(3, 0, "u", "abc", "", 0, "", "")], SCHEMA)
    assert _got(trie.prefix_trie(trie.rebuilt(lone))) == _brute([(3, 0, "u", "abc")])
    paths = spark.createDataFrame([(4, b"", []), (2, b"", []), (9, b"0" * 16, [5])], "conv_id long, path binary, lengths array<int>")
    none, ends = hashlib.sha256(b"2,4").hexdigest(), hashlib.sha256(b"9").hexdigest()
    assert _got(trie.prefix_trie(paths)) == {(2, 0, None, 3, 1, 1, 0, none), (9, 1, 2, 1, 0, 1, 0, ends)}
