"""Merging topics day by day, oldest candidate first, to a fixpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.aggregates import global_ranks
from tidewatch.operators.cells import ERROR, ROWS_A_CELL, cells_of, links_within, settled
from tidewatch.operators.lifecycle import merge_roots
from tidewatch.operators.windows import top_per
from tidewatch.session import ship
from tidewatch.storage import dropped, stored
from tidewatch.tables import Tables

LISTED = 16
#: Entries of the vectors of a component that one task folds; it holds about 30 bytes for each.
LARGEST = 16_000_000
FOUND = "candidate long, id long, score double, at double, seen double, size long, vec binary"


def _unit(v) -> np.ndarray:
    x = np.asarray(v, np.float64)
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def _listed(ids: np.ndarray, matrix: np.ndarray, at: np.ndarray, k: int):
    """Of every partition the k best targets of each candidate: no newer than it and not itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, _unit(v)) for i, v in enumerate(batch.column(1).to_pylist()) if v]
            if not own:
                continue
            rows, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
            numbers, first = batch.column(0).to_numpy()[rows], batch.column(2).to_numpy()[rows]
            scores = np.round(matrix @ x.T, 6)
            scores[(first[None, :] > at[:, None]) | (numbers[None, :] == ids[:, None])] = -np.inf
            order = np.lexsort((np.broadcast_to(numbers, scores.shape), -scores), axis=1)[:, :k]
            c, place = np.nonzero(np.isfinite(np.take_along_axis(scores, order, axis=1)))
            chosen = order[c, place]
            cols = [pa.array(ids[c]), pa.array(numbers[chosen]), pa.array(scores[c, chosen]), pa.array(first[chosen]), batch.column(3).take(pa.array(rows[chosen])), batch.column(4).take(pa.array(rows[chosen])), pa.array([v.tobytes() for v in x[chosen]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["candidate", "id", "score", "at", "seen", "size", "vec"])

    return run


class Round:
    """One batch of candidates against the targets listed for each, with what merges change on the way."""

    def __init__(self, pending: list, found: list, least: float, now: float, barred: set[tuple[int, int]], listed: int):
        self.least, self.now, self.barred, self.listed = least, now, barred, listed
        self.rows = {r["id"]: {"vec": _unit(r["vec"]), "at": r["at"], "seen": r["seen"], "size": r["size"]} for r in pending}
        self.of: dict[int, list] = {r["id"]: [] for r in pending}
        for r in found:
            self.rows.setdefault(r["id"], {"vec": np.frombuffer(r["vec"]), "at": r["at"], "seen": r["seen"], "size": r["size"]})
            self.of[r["candidate"]].append((-r["score"], r["id"]))
        self.gone: dict[int, tuple[int, float]] = {}
        self.changed: set[int] = set()

    def target(self, own: int) -> tuple[int, float] | None | bool:
        """The nearest target as things stand now; None without any, False if the list does not reach far enough."""
        row, listed = self.rows[own], sorted(self.of[own])
        options = [(s, i) for s, i in listed if i not in self.gone and i not in self.changed]
        options += [(-round(float(row["vec"] @ self.rows[i]["vec"]), 6), i) for i in self.changed if i != own and i not in self.gone and self.rows[i]["at"] <= row["at"]]
        if own in self.changed:  # its own centroid moved, so the list is no longer its list
            return False
        best = min(options, default=None)
        if len(listed) == self.listed and (best is None or best > listed[-1]):
            return False
        return None if best is None else (best[1], -best[0])

    def merge(self, own: int, target: int, score: float) -> None:
        src, dst = self.rows[own], self.rows[target]
        after = _merged_centre(dst["vec"], src["vec"], dst["seen"], src["size"], self.now)
        dst["way"] = dst.get("way", 0.0) + _angle(after, dst["vec"])
        dst["vec"] = after
        dst["size"] += src["size"]
        dst["seen"] = self.now
        self.changed.add(target)
        self.gone[own] = (target, score)

    def run(self, pending: list[int], again: list[int], progress: bool) -> tuple[list[int], list[int], bool]:
        """Merge in order until a pass merges nothing. Where a list does not reach far enough it stops: what
        is pending, what the pass has put off and whether it has merged anything come back."""
        while pending:
            for at, own in enumerate(pending):
                found = self.target(own)
                if found is False:
                    return pending[at:], again, progress
                if found is None:
                    continue
                target, score = found
                if score < self.least:
                    again.append(own)
                elif (pair := (min(own, target), max(own, target))) not in self.barred:
                    self.merge(own, target, score)
                    progress = True
            if not progress:
                break
            pending, again, progress = again, [], False
        return [], [], False


def _pairs(df: DataFrame, ids: DataFrame) -> set[tuple[int, int]]:
    """Barred pairs of the batch's candidates: the part of a list that concerns a bounded number of topics."""
    rows = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    own = rows.join(F.broadcast(ids.select(F.col("id").alias("a"))), "a", "left_semi").union(rows.join(F.broadcast(ids.select(F.col("id").alias("b"))), "b", "left_semi"))
    return {(r["a"], r["b"]) for r in own.distinct().collect()}


FOLDED = "id long, merged_into long, root long, similarity double, drift double"


class Reach:
    """The live topics among those of some time or before, one under the other in single precision, which only says
    what may be nearest."""

    def __init__(self, start: np.ndarray, at: np.ndarray):
        self.single, self.rows, self.places, self.n = np.empty(start.shape, np.float32), np.empty(len(at), np.int64), np.full(len(at), -1), 0
        self.at, self.coming, self.next = np.empty(len(at)), np.argsort(at, kind="stable"), 0
        self.times = at

    def until(self, time: float, now_at: np.ndarray) -> None:
        """Let in what is no newer."""
        stop = int(np.searchsorted(self.times[self.coming], time, "right")) if self.next < len(self.coming) and self.times[self.coming[self.next]] <= time else self.next
        new = self.coming[self.next : stop]
        places = slice(self.n, self.n + len(new))
        self.single[places], self.rows[places], self.at[places] = now_at[new], new, self.times[new]
        self.places[new] = np.arange(places.start, places.stop)
        self.n, self.next = places.stop, stop

    def nearest(self, own: int, now_at: np.ndarray) -> tuple[int, float] | None:
        """The row of the largest cosine, of equal ones the first, and that cosine."""
        found = self.single[: self.n] @ now_at[own].astype(np.float32)
        found[self.at[: self.n] > self.times[own]] = -np.inf
        found[self.places[own]] = -np.inf
        most = found.max(initial=-np.inf)
        if most == -np.inf:
            return None
        rows = np.sort(self.rows[: self.n][found >= most - 2 * ERROR])
        scores = np.round(now_at[rows] @ now_at[own], 6)
        best = int(scores.argmax())
        return int(rows[best]), float(scores[best])

    def move(self, row: int, now_at: np.ndarray) -> None:
        self.single[self.places[row]] = now_at[row]

    def leave(self, row: int) -> None:
        place, last = self.places[row], self.n - 1
        self.single[place], self.rows[place], self.at[place] = self.single[last], self.rows[last], self.at[last]
        self.places[self.rows[place]], self.n = place, last


def fold_part(ids: np.ndarray, vec: np.ndarray, at: np.ndarray, seen: np.ndarray, size: np.ndarray, batch: np.ndarray, barred: set[tuple[int, int]], least: float, now: float) -> tuple[np.ndarray, ...]:
    """The columns of FOLDED for topics that meet no others: candidates in turn, batch by batch, to a fixpoint.

    batch is negative for what is no candidate; rows are in order of ids. A candidate looks at the topics that are still
    live and no newer than its batch. drift is the largest angle a centroid has ever had to where it started.
    """
    start, seen, size = np.array([_unit(v) for v in vec]), seen.copy(), size.copy()
    now_at, drift = start.copy(), np.zeros(len(ids))
    into, score_of = np.full(len(ids), -1), np.zeros(len(ids))
    reach, order = Reach(start, at), np.lexsort((ids, at, batch))
    order = order[batch[order] >= 0]
    for pending in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
        pending, progress = pending.tolist(), True
        while pending and progress:
            again, progress = [], False
            for own in pending:
                reach.until(at[own], now_at)
                found = reach.nearest(own, now_at)
                if found is None:
                    continue
                target, score = found
                if score < least:
                    again.append(own)
                elif (min(ids[own], ids[target]), max(ids[own], ids[target])) not in barred:
                    now_at[target] = _merged_centre(now_at[target], now_at[own], seen[target], size[own], now)
                    seen[target], size[target] = now, size[target] + size[own]
                    reach.move(target, now_at)
                    reach.leave(own)
                    into[own], score_of[own] = target, score
                    drift[target] = max(drift[target], _angle(now_at[target], start[target]))
                    progress = True
            pending = again
    root = np.where(into >= 0, into, np.arange(len(ids)))
    while (further := root[root]).tobytes() != root.tobytes():
        root = further
    return ids, into, root, score_of, drift


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.arccos(np.clip(a @ b, -1.0, 1.0)))


def _merged_centre(target: np.ndarray, own: np.ndarray, seen: float, size: int, now: float) -> np.ndarray:
    a = 0.5 ** (max(now - seen, 0.0) / CONFIG.half_life_hours)
    b = (1 - a) * size / (size + 1)
    return _unit((a * target + b * own) / (a + b))


def _fold_parts(least: float, now: float):
    def run(topics: pa.Table, pairs: pa.Table) -> pa.Table:
        barred = set(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True))
        topics = topics.take(pa.array(np.argsort(topics.column("id").to_numpy(), kind="stable")))
        column = lambda name: topics.column(name).to_numpy()
        batch = topics.column("batch").fill_null(-1).to_numpy()
        vec = topics.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(max(topics.num_rows, 1), -1)[: topics.num_rows]
        ids, into, root, score, drift = fold_part(column("id"), vec, column("at"), column("seen"), column("size"), batch, barred, least, now)
        alone = into < 0
        return pa.table([pa.array(ids, pa.int64()), pa.array(ids[into], pa.int64(), mask=alone), pa.array(ids[root], pa.int64()), pa.array(score, pa.float64(), mask=alone), pa.array(drift, pa.float64())], names=[c.split()[0] for c in FOLDED.split(", ")])

    return run


def _folded(state: DataFrame, comps: DataFrame, pairs: DataFrame, least: float, now: float, largest: int, listed: int) -> DataFrame:
    """FOLDED for the topics of comps (node, root), each component for itself; those of more than largest
    topics are stepped through together."""
    placed = state.join(comps.select(F.col("node").alias("id"), F.col("root").alias("component")), "id")
    sizes = comps.groupBy("root").count()
    large = sizes.where(F.col("count") > largest).select(F.col("root").alias("component"))
    mine = comps.select(F.col("node").alias("a"), F.col("root").alias("component"))
    near = pairs.join(mine, "a").join(comps.select(F.col("node").alias("b"), F.col("root").alias("component")), ["b", "component"])
    small = placed.join(large, "component", "left_anti")
    out = small.groupBy("component").cogroup(near.join(large, "component", "left_anti").select("component", "a", "b").groupBy("component")).applyInArrow(_fold_parts(least, now), FOLDED)
    if large.isEmpty():
        return out
    return out.union(_stepped(placed.join(large, "component", "left_semi").drop("component"), near, least, now, listed))


def _stepped(topics: DataFrame, pairs: DataFrame, least: float, now: float, listed: int) -> DataFrame:
    """FOLDED for topics too many for one task: a batch of candidates and the listed nearest topics of each come
    to the driver; where merges used a list up, the batch is listed anew. drift is the way a centroid went."""
    spark = topics.sparkSession
    state = stored(topics.select("*", F.lit(None).cast("long").alias("merged_into"), F.lit(None).cast("double").alias("similarity"), F.lit(0.0).alias("drift")), "merging")
    last, pending, again, progress = -1, [], [], False
    while True:
        live = state.where("merged_into IS NULL")
        if not pending:
            last = live.where(F.col("batch") > last).agg(F.min("batch")).first()[0]
            if last is None:
                break
            rows = live.where(F.col("batch") == last).orderBy("at", "id").collect()
            pending = [r["id"] for r in rows]
        else:
            rows = live.where(F.col("id").isin(*pending, *again)).collect()
        names = spark.createDataFrame([(r["id"],) for r in rows], "id long")
        ids, at = np.array([r["id"] for r in rows], np.int64), np.array([r["at"] for r in rows])
        scan = live.select("id", "vec", "at", "seen", "size").mapInArrow(_listed(ids, np.array([_unit(r["vec"]) for r in rows]), at, listed), FOUND)
        found = top_per(scan, ["candidate"], listed, F.desc("score"), "id").collect()
        round_ = Round(rows, found, least, now, _pairs(pairs, names), listed)
        pending, again, progress = round_.run(pending, again, progress)
        if round_.gone:
            news = [(i, r["vec"].tolist() if i in round_.changed else None, r["seen"], r["size"], *round_.gone.get(i, (None, None)), r.get("way", 0.0)) for i, r in round_.rows.items() if i in round_.changed or i in round_.gone]
            after = spark.createDataFrame(news, "id long, new_vec array<double>, new_seen double, new_size long, target long, score double, way double")
            met = state.join(F.broadcast(after), "id", "left")  # a batch and its lists
            new = {"vec": F.coalesce("new_vec", "vec"), "seen": F.coalesce("new_seen", "seen"), "size": F.coalesce("new_size", "size"), "merged_into": F.coalesce("merged_into", "target"), "similarity": F.coalesce("similarity", "score"), "drift": F.col("drift") + F.coalesce("way", F.lit(0.0))}
            moved = stored(met.select(*[new[c].alias(c) if c in new else c for c in state.columns]), "merging")
            dropped(state)
            state = moved
    links = state.where("merged_into IS NOT NULL").select(F.col("id").alias("topic_id"), "merged_into")
    roots = merge_roots(links).select(F.col("topic_id").alias("id"), "root")
    return state.join(roots, "id", "left").select("id", "merged_into", F.coalesce("root", "id").alias("root"), "similarity", "drift")


def merged_to_fixpoint(topics: DataFrame, least: float = CONFIG.merge_cosine, batch: int = CONFIG.merge_batch, now: float | None = None, no_merge: DataFrame | None = None, veto: DataFrame | None = None, listed: int = LISTED, largest: int | None = None, rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """(id, root, merged_into, similarity) of every topic after each candidate in turn, oldest first, went
    into its nearest topic that is no newer, where their cosine reaches least.

    topics has id, vec, at (hours, when first seen) and size; if it also has seen (last seen), candidate
    and locked, only candidates that are not locked move. A merge moves the target's centroid by
    size_pooled(), so candidates below the threshold are looked at again while anything merges in their
    batch; pairs of no_merge, and those a judge surely denies (veto), stay apart. All candidates are
    stepped through, batch at a time. A topic without a vector stays as it is.

    Only topics within the threshold's angle can merge, so the components of the links within it are
    folded apart, each in one task or, beyond largest topics (None: LARGEST entries of vectors), in steps. Merges move centroids: where
    two components' topics lie apart by no more than that angle and the angles both have drifted, they
    might have met, so such components are joined and folded again, until none might. What then comes out
    is what the whole order would have given: at the first step that differed, two components would
    have had to meet. Links come from cells around pivots (see cells.py).
    """
    spark = topics.sparkSession
    ship(spark)
    if now is None:
        now = float(topics.agg(F.max("at")).first()[0] or 0.0)
    have = set(topics.columns)
    whole = stored(topics.select(
        F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.col("at").cast("double").alias("at"), (F.col("seen") if "seen" in have else F.col("at")).cast("double").alias("seen"), F.col("size").cast("long").alias("size"),
        ((F.col("candidate") if "candidate" in have else F.lit(True)) & ~(F.col("locked") if "locked" in have else F.lit(False))).alias("moves"),
    ), "topics")
    queue = whole.where("moves AND vec IS NOT NULL").select("id", "at")
    batches = global_ranks(queue, [], "at", "id").select("id", F.floor(F.col("place") / batch).alias("batch"))
    state = stored(whole.where("vec IS NOT NULL").drop("moves").join(batches, "id", "left"), "topics")
    vectors = state.select("id", "vec", F.lit(None).cast("double").alias("extra"))
    cells = cells_of(vectors, rows_a_cell=rows_a_cell)
    if cells is None:
        return whole.select("id", F.col("id").alias("root"), F.lit(None).cast("long").alias("merged_into"), F.lit(None).cast("double").alias("similarity"))
    largest = max(LARGEST // cells.pivots.shape[1], 1) if largest is None else largest
    pairs = [df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for df in (no_merge, veto) if df is not None]
    pairs = stored((pairs[0].union(pairs[-1]) if pairs else spark.createDataFrame([], "a long, b long")).distinct(), "barred")
    angle = float(np.arccos(np.clip(least - 1e-6, -1.0, 1.0)))
    edges = stored(links_within(cells, state.where("batch IS NOT NULL").select("id", "vec", F.lit(None).cast("double").alias("extra")), angle, 0.0), "links")
    folded = settled(cells, state.select("id", "vec"), edges, angle, lambda comps: _folded(state, comps, pairs, least, now, largest, listed), both=True)
    cells.drop()
    found = folded.select("id", "merged_into", "root", "similarity")
    return whole.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "merged_into", "similarity")


@operator("seq_07")
def merges(t: Tables, least: float = 0.3) -> DataFrame:
    """Topics of the next day's merge; each seventh is no candidate any more, each thirteenth locked."""
    own = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 97).cast("double").alias("at"), F.lit(1).alias("size"), (F.col("vec_id") % 7 != 0).alias("candidate"), (F.col("vec_id") % 13 == 0).alias("locked"))
    pairs = t.embeddings.where("vec_id % 29 = 11").select(F.col("vec_id").alias("a"), (F.col("vec_id") % 8).alias("b"))
    denied = t.embeddings.where("vec_id % 31 = 5").select(F.col("vec_id").alias("a"), (F.col("vec_id") - 5).alias("b"))
    return merged_to_fixpoint(own, least, now=97.0, no_merge=pairs, veto=denied).select("id", "root", F.round("similarity", 6).alias("similarity"))
