"""Shards by balanced label propagation, on DataFrame functions alone.

Rows are linked through groups (equal texts, or whatever keys the caller links by); a group stands
between its rows, so a group of n rows is n links, not n squared. Rows start in shards chosen by a
hash. In every round each group counts the shards of its rows (an equi-join and an aggregation that
combines before it shuffles) and names the one most of them are in; rows elsewhere ask to move
there. A quota for every shard admits, by greatest gain, no more linked rows than its capacity
leaves, counted in a table of fixed size. A group too large for a shard is dealt into subgroups,
each of which propagates for itself.

At the end capacities are met exactly: rows beyond a shard's quota, unlinked ones first, go to the
shards that have room. Places within a shard come from ranks in blocks of bounded size, with the
blocks' offsets summed separately, so that no shard is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.shared import dropped, joined, stored, table

SHARDS = 24
ROUNDS = 4
BLOCK_ROWS = 4000
GAINS = 16  # gain classes of the quota table
LAW = "rows"


def _pick(value: Column, n: int) -> Column:
    return F.pmod(value, F.lit(n)).cast("int")


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: counts differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _by_shard(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def propagate(links: DataFrame, shards: int, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(rid, grp, shard) of linked rows after label propagation.

    links has rid, grp (only groups of two rows or more), big and shard, where the row starts.
    """
    state = stored(links, "labels")
    for _ in range(rounds):
        votes = state.groupBy("grp", "shard").agg(F.count("*").alias("votes"))
        best = votes.groupBy("grp").agg(F.max(F.struct("votes", F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("b"))
        asks = votes.join(best, "grp").where("shard <> b.shard")
        gain = F.least(F.lit(GAINS - 1), (F.col("b.votes") - F.col("votes")).cast("int"))
        # whole cells (group, shard) move: their rows share one gain
        asks = stored(asks.select("grp", "shard", F.col("b.shard").alias("target"), "votes", gain.alias("gain"), _pick(F.xxhash64("grp", "shard"), 16).alias("part")), "asks")
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        total = sum(load.values())
        flows = asks.groupBy("target", "gain", "part").agg(F.sum("votes").alias("n")).collect()  # shards x GAINS x 16 rows at most
        if not flows:
            dropped(asks)
            break
        admitted: list[tuple[int, int, int]] = []
        for target in range(shards):
            room = capacity[target] - load.get(target, 0)
            for r in sorted((r for r in flows if r["target"] == target), key=lambda r: (-r["gain"], r["part"])):
                if r["n"] <= room:
                    room -= r["n"]
                    admitted.append((target, r["gain"], r["part"]))
        if not admitted:
            dropped(asks)
            break
        codes = [(t * GAINS + g) * 16 + p for t, g, p in admitted]
        code = (F.col("target") * GAINS + F.col("gain")) * 16 + F.col("part")
        moves = asks.where(_flag(codes, shards * GAINS * 16, code)).select("grp", "shard", "target", "votes")
        after = stored(joined(state, moves, ["grp", "shard"], "votes", total, "left").select("rid", "grp", "big", F.coalesce("target", "shard").alias("shard")), "labels")
        dropped(state, asks)
        state = after
    return state


def _flag(true: list[int], size: int, code: Column) -> Column:
    """Whether code is among true, looked up in the bits of an array literal."""
    words = [0] * (-(-size // 32))
    for i in true:
        words[i // 32] |= 1 << (i % 32)
    packed = F.array(*[F.lit(w).cast("long") for w in words])
    return F.getbit(F.get(packed, F.floor(code / 32).cast("int")), (code % 32).cast("int")) == 1


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard).

    Links: equal texts; null and empty texts count as equal. size is the text's bytes and 8 more.
    Counts of shards differ by one at most. Repeated rows keep a row each; fewer rows than shards
    leave shards empty; extra columns are not read; an empty table gives no rows. Rows start by their
    place in the input, so the same table split otherwise may give other shards, under the same laws.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text")).select(
        "rid", "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"),
    )
    rows = stored(rows, "rows")
    total = rows.count()
    quota = quotas(total, shards)
    # (hash, crc, size) stand for the text: 96 bits and the length
    key = ["h", "text_crc32", "size"]
    sizes = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    most = max(1, *quota)
    chunk = F.when(F.col("n") > most, F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / most))).otherwise(F.lit(0))
    linked = joined(rows, sizes, key, "n", total).select("rid", F.xxhash64(*key, chunk).alias("grp"), (F.col("n") > block_rows).alias("big"), _pick(F.xxhash64("rid", F.lit(1)), shards).alias("shard"))
    labels = propagate(linked, shards, quota, rounds)
    single = F.col("grp").isNull()
    placed = rows.join(labels, "rid", "left").select("rid", "doc_id", "size", "text_crc32", single.alias("single"), F.coalesce("big", F.lit(False)).alias("big"), F.coalesce("grp", F.xxhash64("rid", F.lit(2))).alias("grp"), F.coalesce("shard", _pick(F.xxhash64("rid", F.lit(1)), shards)).alias("shard"))
    ranked = _ranked(placed, total, shards, block_rows)
    counts = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    have = [counts.get(s, 0) for s in range(shards)]
    over = [max(0, h - q) for h, q in zip(have, quota, strict=True)]
    room = [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    before = [sum(over[:s]) for s in range(shards)]
    upto = [sum(room[: s + 1]) for s in range(shards)]
    kept = F.col("rank") < F.get(_by_shard(quota), "shard")
    index = F.get(_by_shard(before), "shard") + F.col("rank") - F.get(_by_shard(quota), "shard")
    target = F.size(F.filter(_by_shard(upto), lambda x: x <= index)).cast("int")
    out = ranked.withColumn("index", index).withColumn("to", F.when(kept, F.col("shard")).otherwise(target))
    slot = F.when(kept, F.col("rank")).otherwise(F.get(_by_shard(have), "to") + F.col("index") - F.get(_by_shard([0, *upto]), "to"))
    return out.select("doc_id", "size", "text_crc32", F.col("to").alias("shard"), slot.cast("long").alias("slot"))


def _ranked(placed: DataFrame, total: int, shards: int, block_rows: int) -> DataFrame:
    """Add rank, from 0 in each shard: linked rows first, by group, then single ones."""
    per_shard = max(1, total // (shards * block_rows))
    high = F.pmod(F.col("grp"), F.lit(per_shard)).cast("int")
    sub = F.when(F.col("big"), _pick(F.xxhash64("rid", F.lit(3)), per_shard)).otherwise(F.lit(0))
    block = F.struct("single", high.alias("part"), sub.alias("sub"))
    rows = stored(placed.withColumn("block", block), "placed")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    begin = F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = counts.select("shard", "block", begin.alias("begin"))
    inner = F.row_number().over(W.partitionBy("shard", "block").orderBy("grp", "rid")) - 1
    return stored(rows.withColumn("inner", inner).join(starts, ["shard", "block"]).withColumn("rank", F.col("begin") + F.col("inner")).drop("begin", "inner", "block"), "ranked")


def op2_label_propagation(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards; see shard()."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
