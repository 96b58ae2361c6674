"""Secret scans with linked multipart credentials, on DataFrame functions alone.

Certain kinds (assignments, access keys, long hexadecimal runs) are reported wherever they match.
Weak parts (access identifiers, free-standing secrets, endpoints) say little alone: they are
reported only where complementary parts meet. Parts are exploded to rows, keyed by document and
scope bin, and joined on overlapping intervals: an identifier and a secret whose gap is at most
SCOPE code points are linked, and an endpoint joins a linked pair within the same distance. A
single part, or two of one kind, is never reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import keyed, stored, table, unused

# The certain kinds in the order they are listed in, with the least length of the
# group that decides.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

# Weak parts: kind and pattern. Names may follow a prefix (DB_USER), values may follow their name at
# once; runs have no upper length and are possessive, so that a text is read a fixed number of times.
# A secret's name (SECRET_ACCESS_KEY) is no identifier, an identifier's value is no secret.
IDENT = r"(?i)(?<![a-z0-9])(?<!secret[_-])(?:access[_-]?id|access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:name)?|login|account)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?[A-Za-z0-9_.@-]{4,}+"
NAMED = r"(?<![A-Za-z0-9])(?i:access[_-]?id|access[_-]?key[_-]?id|client[_-]?id|user(?:name)?|login|account)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?"
LOOSE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z0-9+/_-]{{20}})(?<!{NAMED})[A-Za-z0-9+/_-]{{20,}}+={{0,2}}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i)\b(?:https?|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[A-Za-z0-9._:@/-]{4,}+"
WEAK = (("ident", IDENT), ("loose", LOOSE), ("endpoint", ENDPOINT))
SCOPE = 200
CHUNK = 128
ORDER = ("assign", "access", "hex", "ident", "loose", "endpoint")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _prefix(lengths: Column, levels: int = 3) -> Column:
    """Running sums before each element, in time that grows with the array alone (to CHUNK^levels elements):
    sums before each chunk, from the chunks' own running sums, and within the chunk."""
    places = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i - 1)

    def inner(own: Column, i: Column) -> Column:
        return _total(F.slice(own, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))

    def level(own: Column, left: int) -> Column:
        n = F.greatest(F.size(own), F.lit(1))
        if left == 1:
            return F.transform(places(n), lambda i: _total(F.slice(own, F.lit(1), i)))
        chunks = F.transform(places(F.ceil(n / CHUNK).cast("int")), lambda c: _total(F.slice(own, c * CHUNK + 1, F.lit(CHUNK))))
        sums = _let(chunks, lambda c: level(c, left - 1))
        return _let(sums, lambda before: F.transform(places(n), lambda i: F.get(before, F.floor(i / CHUNK).cast("int")) + inner(own, i)))

    return level(lengths, levels)


def _found(df: DataFrame, kind: str, pattern: str, rank: int, least: int = 0, group: int = 0) -> DataFrame:
    """Add the column kind: structs (start, end, rank) of all matches, leftmost and non-overlapping.

    Between n matches lie n + 1 pieces; both alternate over the whole text, so running lengths give
    the code points. The shorter parts of a match, where a group decides, are tested afterwards.
    """
    df = df.withColumn("_hits", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    decides = (lambda h: F.char_length(F.regexp_extract(h, pattern, group))) if group else F.char_length
    before = lambda i: F.when(i > 0, F.char_length(F.get("_hits", i - 1))).otherwise(0)
    steps = lambda gaps: F.transform(F.sequence(F.lit(0), F.size("_hits") - 1), lambda i: F.char_length(F.get(gaps, i)) + before(i))

    def spans(own: Column, sums: Column) -> Column:
        """From each match's distance to the one before and the sums of these."""
        found = F.transform("_hits", lambda h, i: F.struct((F.get(sums, i) + F.get(own, i)).alias("start"), (F.get(sums, i) + F.get(own, i) + F.char_length(h)).alias("end"), F.lit(rank).alias("rank"), (decides(h) >= least).alias("ok")))
        return F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))

    kept = _let(F.split("text", pattern, -1), lambda gaps: _let(steps(gaps), lambda own: _let(_prefix(own), lambda sums: spans(own, sums))))
    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    return df.withColumn(kind, F.when(F.size("_hits") > 0, kept).otherwise(none)).drop("_hits")


def parts(docs: DataFrame) -> DataFrame:
    """rid, doc_id and, for each kind, the spans of its matches in the whole text (null: empty)."""
    df = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, pattern, group, least in BASE:
        # A run of 24 hexadecimal digits or more is found as such: shorter runs are dropped anyway,
        # and a run is maximal either way. Access keys alike.
        quick = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}.get(kind, pattern)
        df = _found(df, kind, quick, ORDER.index(kind), least, group)
    for kind, pattern in WEAK:
        df = _found(df, kind, pattern, ORDER.index(kind))
    return df.select("rid", "doc_id", *ORDER)


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, start, end, rank) of weak parts that meet complementary parts within a scope.

    found has rid and the span arrays. Certain matches serve as partners too: an assignment or a
    hexadecimal run stands for a secret, an access key for an identifier.
    """
    role = F.array(*[F.lit(r) for r in ("secret", "ident", "secret", "ident", "secret", "endpoint")])
    some = F.size("ident") + F.size("loose") + F.size("endpoint") > 0
    rows = found.where(some).select("rid", F.explode(F.concat(*ORDER)).alias("s")).select("rid", "s.start", "s.end", "s.rank")
    rows = rows.withColumn("role", F.get(role, F.col("rank")))
    bins = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope))
    near = rows.withColumn("bin", F.explode(bins))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of left and right of the same document whose gap is at most scope, not overlapping."""
        a, b = left.alias("a"), right.alias("b")
        on = (F.col("a.rid") == F.col("b.rid")) & (F.col("a.bin") == F.col("b.bin"))
        gap = F.greatest(F.col("a.start"), F.col("b.start")) - F.least(F.col("a.end"), F.col("b.end"))
        return a.join(b, on & (gap >= 0) & (gap <= scope))

    idents, secrets, ends = (near.where(F.col("role") == r) for r in ("ident", "secret", "endpoint"))
    pairs = meet(idents, secrets)
    side = lambda df, x: df.select(*[F.col(f"{x}.{c}").alias(c) for c in ("rid", "start", "end", "rank")])
    matched = side(pairs, "a").union(side(pairs, "b")).distinct()
    again = matched.withColumn("bin", F.explode(bins))
    with_end = side(meet(again, ends), "b").distinct()
    weak = len(BASE)
    return matched.union(with_end).where(F.col("rank") >= weak)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: rid, doc_id, base (certain spans) and spans (all), arrays of
    (start, end, rank) in order of start, then rank, which indexes ORDER.

    Null and empty texts have no spans; positions are code points, ends exclusive; repeated rows
    are scanned each for itself; other columns are not read; an empty table gives no rows.
    """
    found = stored(parts(docs), "parts")
    weak = linked_parts(found, scope).groupBy("rid").agg(F.collect_list(F.struct("start", "end", "rank")).alias("weak"))
    base = F.array_sort(F.concat(*[k for k, *_ in BASE]))
    out = found.select("rid", "doc_id", *[k for k, *_ in BASE], base.alias("base")).join(weak, "rid", "left")
    spans = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("weak"))))
    return out.withColumn("spans", spans).drop("weak")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with every reported span replaced by [kind] and n_chars, where there is one, set to the new
    length; rows, order of columns and clean texts stay.

    Overlapping spans are merged first and take the name of the one that starts first. Null and empty
    texts stay as they are, repeated rows are redacted each for itself, other columns pass whatever
    their names; an empty table stays empty.
    """
    rows, key = keyed(docs)
    found, new_text = unused(docs, "_spans"), unused(docs, "_new")
    hits = scan(rows.select(F.col(key).alias("doc_id"), "text"), scope).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(found))
    both = rows.join(hits, key, "left")
    names = F.array(*[F.lit(f"[{k}]") for k in ORDER])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], before, F.get(names, s["rank"])).alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        )

    masked = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.char_length("text"))))
    changed = both.withColumn(new_text, F.when(F.col(found).isNotNull(), masked))
    new = {"text": F.coalesce(new_text, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(new_text), "n_chars").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op4_secret_links(spark, sf_dir: str) -> DataFrame:
    """Certain and linked spans of every whole document; see scan()."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
