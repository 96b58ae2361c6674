"""Names in texts: one pass over each text, however many names there are."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import ship
from tidewatch.storage import dropped, stored

#: Bytes of names in one automaton; more names go in parts, each with a pass of its own.
NAMES_BYTES = 32 << 20
HITS = "article_id long, name string, n int"


#: What names of ASCII letters and digits alone lie within, as texts are in lower case.
WORD = re.compile("[a-z0-9]+")
#: Words whose names a finder keeps at most.
KEPT_WORDS = 200_000


class Finder:
    """Counts names in a text, which is in lower case, whatever their number.

    Names of ASCII letters and digits alone are looked up by the text's different words; for all others the
    Aho-Corasick automaton of them follows the text once. whole: a name counts only where no ASCII letter or digit
    stands beside it. Hits of one name do not overlap; those of different names may.
    """

    def __init__(self, names: list[str], whole: bool):
        self.whole = whole
        self.words = {name for name in names if WORD.fullmatch(name)}
        self.automaton = _automaton([name for name in names if name not in self.words])
        self.inside = _automaton([] if whole else self.words)
        self.known: dict[str, Counter] = {}

    def counts(self, text: str) -> Counter:
        out = Counter(name for _, name in _places(self.automaton, text, self.whole))
        words = Counter(WORD.findall(text)) if self.words else Counter()
        if self.whole:
            out.update({word: words[word] for word in words.keys() & self.words})
            return out
        for word, n in words.items():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                found = self.known[word] = Counter(name for _, name in _places(self.inside, word, False))
            for name, k in found.items():
                out[name] += k * n
        return out


def _automaton(names):
    import ahocorasick

    out = ahocorasick.Automaton()
    for name in names:
        if name:
            out.add_word(name, name)
    if len(out):
        out.make_automaton()
    return out


def _places(automaton, text: str, whole: bool) -> Iterator[tuple[int, str]]:
    """(start, name) of all hits, by their ends."""
    if not len(automaton):
        return
    taken: dict[str, int] = {}
    for last, name in automaton.iter(text):
        start = last + 1 - len(name)
        if start < taken.get(name, 0):
            continue
        if whole and (_joins(text[start - 1 : start]) or _joins(text[last + 1 : last + 2])):
            continue
        taken[name] = last + 1
        yield start, name


def _joins(beside: str) -> bool:
    return beside.isascii() and beside.isalnum()


def name_hits(texts: DataFrame, names: DataFrame, whole: bool, most_bytes: int = NAMES_BYTES) -> DataFrame:
    """(article_id, name, n): how often each name stands in each text, both in lower case; only where it does.

    texts: article_id, content; names: name. Null and empty names and texts hit nothing, repeated names count once.
    Names come to the driver most_bytes at a time and go to the tasks with the code.
    """
    spark = texts.sparkSession
    ship(spark)
    lowered = stored(names.select(F.lower("name").alias("name")).where("name <> ''").distinct(), "names")
    size = lowered.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    rows = texts.select(F.col("article_id").cast("long").alias("article_id"), F.col("content").cast("string").alias("content"))
    out = None
    for part in range(parts):
        own = [r["name"] for r in lowered.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()]
        found = rows.mapInArrow(_counted(own, whole), HITS)
        if parts > 1:
            found = stored(found, "hits")  # one part of the names in memory at a time
        out = found if out is None else out.union(found)
    dropped(lowered)
    return out


def _counted(names: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names, whole)
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1):
                hits = finder.counts((text.as_py() or "").lower())
                sizes.append(len(hits))
                found += hits.keys()
                counts += hits.values()
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string()), pa.array(counts, pa.int32())], ["article_id", "name", "n"])

    return run
