"""Operators without SQL, against plain restatements and textbook values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import documents, folds, lifecycle, merging, names, scalars, sinks, statistics, vectors
from tidewatch.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_p_values():
    assert statistics.t_p_value(0.5, 12) == pytest.approx(0.09785, abs=1e-4)
    assert statistics.t_p_value(1.0, 12) == 0.0
    assert statistics.f_p_value(4.96, 1, 10) == pytest.approx(0.05, abs=1e-3)


def test_planted_lag_is_found():
    rng = np.random.default_rng(3)
    x = rng.poisson(20, 30).astype(float)
    y = np.r_[rng.poisson(20, 2), x[:-2]]
    lag, r, p = statistics.correlate(x, y)
    assert lag == 2 and r > 0.99 and p < 1e-6
    assert statistics.granger(x, y)[2] < 0.05
    assert statistics.qap(x, y, 200)[1] < 0.05
    assert statistics.correlate(x, np.full(30, 4.0)) is None and statistics.qap(x, np.full(30, 4.0)) is None


def test_permutation_test_is_one_of_the_mean_follower(spark):
    """The query's rows against a plain restatement on the tables' own daily counts; a series by hand."""
    t = Tables(spark, SF)
    got = {r["kind"]: (r["qap_r"], r["qap_p"]) for r in statistics.mean_follower_test(t, least=1).collect()}
    days = {}
    for r in statistics.series(t).collect():
        days.setdefault(r["kind"], {}).setdefault(r["country_code"], {})[r["day"]] = r["n"]

    def best(a, b):
        found = 0.0
        for lag in range(8):
            x, y = a[: len(a) - lag], b[lag:]
            if len(x) >= 3 and np.std(x) and np.std(y) and abs(r := np.corrcoef(x, y)[0, 1]) > abs(found) + 1e-9:
                found = r
        return found

    assert got and set(got) <= set(days)
    for kind, (r, p) in list(got.items())[:2]:
        of = {c: np.array([v for _, v in sorted(s.items())], float) for c, s in days[kind].items()}
        x, y = of.pop("C0"), np.mean(list(of.values()), axis=0)
        rng = np.random.default_rng(42)
        hits = sum(abs(best(rng.permutation(x), y)) >= abs(best(x, y)) - 1e-12 for _ in range(1000))
        assert r == pytest.approx(best(x, y), abs=1e-9) and p == pytest.approx((hits + 1) / 1001)
    x = np.array([0, 0, 9, 0, 1, 0, 4, 0, 0, 2, 7, 0, 1, 3, 0, 0], float)
    r, p = statistics.qap(x, np.r_[0, 0, 0, 10 - x[:-3]])
    assert r == pytest.approx(-1.0) and p <= 0.02


def test_nearest_with_many_blocks_equals_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), float(i % 5)) for i in range(60)] + [(60, None, 0.0), (61, [0.0] * 8, 0.0)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, at double")
    one = sorted(map(tuple, vectors.nearest(df, df, 3).collect()))
    assert one == sorted(map(tuple, vectors.nearest(df, df, 3, block=7).collect()))
    assert len(one) and all(r[0] < 60 and r[1] < 60 and r[0] != r[1] for r in one)
    assert one == sorted(map(tuple, vectors.nearest(df, df, 3, block=9, rows_a_cell=4).collect()))


@pytest.mark.parametrize("k,least,spread", [(3, -1.0, 0.3), (1, 0.9, 0.1), (2, 0.5, 1.0)])
def test_nearest_in_cells_is_that_of_all_pairs(spark, k, least, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 400)] + spread * rng.normal(size=(400, 6))
    x[7] = x[8] = x[9]
    at = rng.integers(0, 9, 400).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), None if i % 50 == 0 else float(at[i])) for i in range(400)], "id long, vec array<double>, at double")
    seen = []
    got = sorted(map(tuple, vectors.nearest(df, df, k, least, block=40, rows_a_cell=20, seen=seen).collect()))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 6)
    want = []
    for i in range(400):
        may = [(-scores[i, j], j) for j in range(400) if j != i and scores[i, j] >= least and (i % 50 == 0 or j % 50 == 0 or at[j] <= at[i])]
        want += [(i, j, -s) for s, j in sorted(may)[:k]]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
    share = sum(seen) / 400**2
    assert share < {0.3: 0.75, 0.1: 0.25, 1.0: 1.01}[spread]


def test_echo_folding_thresholds():
    import pandas as pd

    def at(cos):
        return [cos, (1 - cos * cos) ** 0.5]

    rows = [(1, at(1.0), 0), (2, at(0.7), 10), (3, at(0.2), 12), (4, at(0.8), 30), (5, at(1.0), 100)]
    pdf = pd.DataFrame([("T", i, v, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for i, v, h in rows], columns=["topic_id", "article_id", "vec", "published_at"])
    got = {r.article_id: r.node_id for r in folds.echo_step(pdf).itertuples()}
    assert got[1] == 1 and got[2] == 1 and got[3] == 3 and got[5] == 5


def test_average_linkage_joins_only_near_vectors():
    v = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99]])
    label = folds.average_linkage(v / np.linalg.norm(v, axis=1, keepdims=True))
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2]


def _linked_by_matrix(vectors, cut):
    """Average linkage with the whole matrix of distances, the nearest pair first."""
    distance = 1 - vectors @ vectors.T
    np.fill_diagonal(distance, np.inf)
    size, label, n = np.ones(len(vectors)), np.arange(len(vectors)), len(vectors)
    while n > 1:
        i, j = sorted(divmod(int(distance.argmin()), len(vectors)))
        if distance[i, j] > cut:
            break
        row = (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = row, row
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        label[label == j] = i
        size[i] += size[j]
        n -= 1
    return label


@pytest.mark.parametrize("cut", [0.05, 0.25, 0.6, 1.2])
def test_chains_cluster_as_the_matrix_does(cut):
    rng = np.random.default_rng(7)
    for n, d, spread in ((1, 3, 1.0), (60, 3, 1.0), (150, 8, 0.4), (200, 16, 0.2)):
        v = rng.normal(size=(9, d))[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, d))
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        v[n // 2] = 0.0
        assert folds.average_linkage(v, cut).tolist() == _linked_by_matrix(v, cut).tolist()
    assert folds.average_linkage(np.zeros((0, 3)), cut).tolist() == []


def test_a_large_block_needs_memory_in_its_rows_alone():
    import tracemalloc

    rng = np.random.default_rng(2)
    v = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    labels = folds.average_linkage(v)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * v.nbytes and len(set(labels.tolist())) < 4000  # the matrix of distances would be 250 times as large


def test_merge_roots_follow_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("s", "s")], "topic_id string, merged_into string")
    assert dict(map(tuple, lifecycle.merge_roots(links).collect())) == {"a": "d", "b": "d", "c": "d", "x": "d"}


def test_merging_reaches_a_fixpoint(spark):
    rows = [(1, [1.0, 0.0], 0.0, 1), (2, [0.95, 0.1], 1.0, 1), (3, [0.9, 0.2], 2.0, 1), (4, [0.0, 1.0], 0.0, 1)]
    got = {r["id"]: r["root"] for r in merging.merged_to_fixpoint(spark.createDataFrame(rows, "id long, vec array<double>, at double, size int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def _merged_by_hand(rows, least, batch, now, barred):
    """Every candidate in turn against every live topic, as plain loops."""
    unit = lambda v: v / np.linalg.norm(v)
    live = {i: [unit(np.array(v)), at, at, 1] for i, v, at, *_ in rows}
    into, order = {}, sorted((at, i) for i, _, at, candidate, locked in rows if candidate and not locked)
    for start in range(0, len(order), batch):
        pending = [i for _, i in order[start : start + batch]]
        while pending:
            again, progress = [], False
            for own in pending:
                vec, at = live[own][:2]
                options = [(-round(float(vec @ o[0]), 6), i) for i, o in live.items() if i != own and i not in into and o[1] <= at]
                if not options:
                    continue
                score, target = min(options)
                if -score < least:
                    again.append(own)
                elif (min(own, target), max(own, target)) not in barred:
                    dst = live[target]
                    a = 0.5 ** (max(now - dst[2], 0) / 24)
                    b = (1 - a) * live[own][3] / (live[own][3] + 1)
                    dst[0], dst[2], dst[3] = unit((a * dst[0] + b * vec) / (a + b)), now, dst[3] + live[own][3]
                    into[own] = target
                    progress = True
            if not progress:
                break
            pending = again
    return into


@pytest.mark.parametrize("batch,largest", [(7, 1000), (200, 1000), (7, 8), (40, 30)])
def test_merging_equals_one_candidate_after_the_other(spark, batch, largest):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 6))
    rows = [(i, (heads[i % 12] + rng.normal(size=6) * 0.4).tolist(), float(rng.integers(0, 40)), i % 5 != 0, i % 17 == 3) for i in range(150)]
    barred = {(i, i + 12) for i in range(0, 130, 9)}
    df = spark.createDataFrame([(i, v, at, 1, c, x) for i, v, at, c, x in rows], "id long, vec array<double>, at double, size int, candidate boolean, locked boolean").repartition(3)
    pairs = spark.createDataFrame([(b, a) for a, b in barred], "a long, b long")
    got = {r["id"]: r["merged_into"] for r in merging.merged_to_fixpoint(df, 0.8, batch, 60.0, pairs, listed=4, largest=largest, rows_a_cell=16).collect()}
    want = _merged_by_hand(rows, 0.8, batch, 60.0, barred)
    assert {i: t for i, t in got.items() if t is not None} == want and len(want) > 20


def test_a_large_component_is_folded_in_one_task(spark, monkeypatch):
    """30,000 topics that all reach each other, three clusters of them; nothing is stepped through on the driver."""
    rng = np.random.default_rng(4)
    x = np.array([1.0, 0.0, 0.0]) + 0.3 * np.repeat(np.eye(3), 10_000, axis=0) + 1e-3 * rng.normal(size=(30_000, 3))
    monkeypatch.setattr(merging, "_stepped", None)
    df = spark.createDataFrame([(i, v.tolist(), float(i // 300), 1) for i, v in enumerate(x)], "id long, vec array<double>, at double, size int")
    got = merging.merged_to_fixpoint(df, 0.8, now=100.0)
    assert got.where("merged_into IS NULL").count() == 1 and got.select("root").distinct().count() == 1


def test_drift_joins_components_that_first_lie_apart(spark):
    """Topics along an arc: one that has moved by its merges reaches another that nothing reached before."""
    at = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    least = float(np.cos(np.radians(20)))
    rows = [(1, at(0), 0.0, True, False), (2, at(19), 1.0, True, False), (3, at(36), 2.0, True, False), (4, at(120), 0.0, True, False), (5, at(150), 3.0, True, False)]
    want = _merged_by_hand(rows, least, 200, 400.0, set())
    assert want == {2: 1, 3: 1}
    df = spark.createDataFrame([(i, [float(x) for x in v], at_, 1) for i, v, at_, *_ in rows], "id long, vec array<double>, at double, size int")
    got = {r["id"]: r["merged_into"] for r in merging.merged_to_fixpoint(df, least, 200, 400.0).collect()}
    assert {i: t for i, t in got.items() if t is not None} == want


def test_next_days_merge_as_the_rules_say(spark):
    """A near candidate goes into the older topic, one below 0.62, a barred pair and a locked one stay."""
    def near(cos, axis):
        v = [0.0] * 8
        v[axis], v[axis + 1] = cos, (1 - cos * cos) ** 0.5
        return v

    base = lambda axis: [float(i == axis) for i in range(8)]
    rows = [(1, base(0), 0.0, False, False), (2, near(0.95, 0), 20.0, True, False), (3, base(2), 0.0, False, False), (4, near(0.5, 2), 20.0, True, False), (5, base(4), 0.0, False, False), (6, near(0.95, 4), 20.0, True, False), (7, base(6), 0.0, False, False), (8, near(0.9, 6), 20.0, True, True)]
    df = spark.createDataFrame([(i, v, at, 1, c, x) for i, v, at, c, x in rows], "id long, vec array<double>, at double, size int, candidate boolean, locked boolean")
    out = merging.merged_to_fixpoint(df, 0.62, now=24.0, no_merge=spark.createDataFrame([(6, 5)], "a long, b long")).collect()
    assert {r["id"]: (r["root"], r["similarity"]) for r in out if r["merged_into"] is not None} == {2: (1, 0.95)} and len(out) == 8


def test_old_topics_merge_beyond_one_batch(spark):
    rows = [(i, [1.0, float(i)], 0.0, 1) for i in range(0, 30, 10)] + [(100 + i, [-1.0, -float(i * i)], 1.0 + i, 1) for i in range(40)] + [(900, [0.0, 0.0, 1.0][:2], 99.0, 1)]
    rows = [(i, v, at, s) for i, v, at, s in rows if any(v)]
    rows += [(950, [5.0, -5.0], 100.0, 1), (951, [5.0, -5.0], 101.0, 1)]
    got = {r["id"]: r["root"] for r in merging.merged_to_fixpoint(spark.createDataFrame(rows, "id long, vec array<double>, at double, size int"), 0.99, 2).collect()}
    assert got[951] == 950


def test_urls(spark):
    rows = [(u,) for u in ("HTTP://News.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://e.com/x/?ref=1&from=z", "https://e.com", "https://e.com:80/?UTM_x=1&q=", "http://e.com:443/a?k", "https://e.com:443/a//?b=x%20y*~", "no url")]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(scalars.normalized_url(F.col("u"))).collect()]
    assert got == ["http://news.example.com/a?a=1&b=2", "https://e.com/x?ref=1", "https://e.com/", "https://e.com:80/?q=", "http://e.com:443/a?k=", "https://e.com/a?b=x+y%2A~", "no url"]


def test_page_parsing():
    html = "<html><head><title>T</title></head><body><nav><a href='/n'>n</a></nav><div class='list item-7 active fa-x sidebar'>" + "".join(f"<p>Body {i} <a href='/a/{i}'>x</a></p>" for i in range(6)) + "</div><script>no()</script></body></html>"
    page = documents.parsed(html, "http://h.com/l")
    assert page.title == "T" and page.text().startswith("Body 0") and "no()" not in page.text()
    signatures = {s for link, s in page.links if "/a/" in link}
    assert signatures == {"html>body>div.item-N.list.sidebar>p>a"}
    assert documents.parsed(html, "", "div.list p").selected().split("\n")[1] == "Body 1 x" and documents.parsed(html, "", "p div").selected() == ""
    assert documents.parsed(None).text() == ""


def test_entity_runs():
    assert ("United Nations Council", "ORG") in documents.latin_runs("the United Nations Council said")
    assert documents.latin_runs("President Ana Silva spoke. The end in Paris") == [("President Ana Silva", "PEOPLE"), ("Paris", "LOCATION")]
    assert documents.latin_runs("said Silva. Monday came") == [("Silva Monday", "PEOPLE")]
    assert names.Finder(["北京"], True).counts("在北京的北京大学") == {"北京": 2}


def test_health_machine():
    import pandas as pd

    at = pd.Timestamp("2024-01-01")
    rows = [("temporary_failure", h) for h in (0, 1, 2)] + [("permanent_failure", 200), ("success", 201), ("success", 202)]
    pdf = pd.DataFrame([(1, s, at + pd.Timedelta(hours=h), i) for i, (s, h) in enumerate(rows)], columns=["source_id", "status", "scheduled_at", "job_id"])
    assert folds.health_step(pdf).iloc[0].tolist() == [1, "active", 3, "active>degraded,degraded>failed,failed>active"]


def test_versions_are_published_whole(spark):
    from tidewatch.sources.files import publish, read_published

    base = publish(spark.range(3), "v")
    publish(spark.range(5), "v", base)
    assert read_published(spark, base, "id long").count() == 5


def test_replay_case_faults(tables):
    got = {r["case_id"]: r["faults"] for r in sinks.replay_cases(tables).collect()}
    assert got == {"k0": "", "k1": "", "k2": "repeated"}


def test_pooling_weights(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    same, day = df.select(lifecycle.pooled(F.col("a"), F.col("b"), F.lit(0.0)), lifecycle.pooled(F.col("a"), F.col("b"), F.lit(24.0))).first()
    assert same == [1.0, 0.0] and day == pytest.approx([0.5**0.5] * 2)


def test_subsequence():
    assert folds.common_subsequence(list("abcde"), list("ace")) == 3 and folds.common_subsequence([], ["a"]) == 0


@pytest.mark.parametrize("spread,titles", [(0.25, 30), (0.5, 1000), (0.12, 5)])
def test_assignment_in_components_is_that_of_one_fold(spark, spread, titles):
    """Topics that cross cells and drift: the same rows as all reports in order."""
    import pandas as pd

    rng = np.random.default_rng(17)
    heads = rng.normal(size=(25, 5))
    rows = []
    for i in range(400):
        v = heads[i % 25] + spread * rng.normal(size=5) + 0.02 * (i // 25) * heads[(i + 1) % 25]  # heads move towards their neighbours
        title = None if i % 7 == 0 else f"Report, {rng.integers(0, titles)}!"
        rows.append((i, v.tolist(), pd.Timestamp("2024-01-01") + pd.Timedelta(hours=float(i // 3)), title))
    rows[11] = (11, None, *rows[11][2:])
    rows[12] = (12, rows[40][1], *rows[12][2:])
    pdf = pd.DataFrame(rows, columns=["article_id", "vec", "published_at", "title"]).sort_values(["published_at", "article_id"])
    want = {r.id: (r.topic_id, None if pd.isna(r.duplicate_of) else r.duplicate_of) for r in folds.assign_step(pdf).itertuples()}
    df = spark.createDataFrame([(i, v, at.to_pydatetime(), t) for i, v, at, t in rows], "article_id long, vec array<double>, published_at timestamp, title string").repartition(3)
    got = {r["article_id"]: (r["topic_id"], r["duplicate_of"]) for r in folds.assigned(df, rows_a_cell=30).collect()}
    assert got == want and 5 < len({t for t, _ in want.values()}) < 399
    assert folds.assigned(df.limit(0)).count() == 0


def test_titles_join_no_components(spark, monkeypatch):
    """Reports of a few titles are folded apart where their vectors are, and come out as from one fold."""
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    x[200:] = x[:100] + 0.05 * rng.normal(size=(100, 40))  # repeat a vector, so their titles do not count
    rows = [(i, x[i].tolist(), pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(rng.integers(0, 90))), f"Report {i % 3}") for i in range(300)]
    pdf = pd.DataFrame(rows, columns=["article_id", "vec", "published_at", "title"]).sort_values(["published_at", "article_id"])
    want = {r.id: (r.topic_id, None if pd.isna(r.duplicate_of) else r.duplicate_of) for r in folds.assign_step(pdf).itertuples()}
    sizes, connected = [], folds.connected

    def seen(links):
        out = connected(links)
        sizes.append(out.groupBy("root").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(folds, "connected", seen)
    df = spark.createDataFrame([(i, v, at.to_pydatetime(), t) for i, v, at, t in rows], "article_id long, vec array<double>, published_at timestamp, title string")
    got = {r["article_id"]: (r["topic_id"], r["duplicate_of"]) for r in folds.assigned(df).collect()}
    assert got == want and max(sizes) <= 3
    assert sum(d is not None for _, d in want.values()) > 150


def test_rows_looked_through_in_blocks(monkeypatch):
    monkeypatch.setattr(folds, "AHEAD", 7)
    rng = np.random.default_rng(4)
    coming = rng.normal(size=(60, 5))
    rows, plain = folds.Rows(coming), []
    for place in range(60):
        scores = [float(v @ coming[place]) for v in plain]
        i, score = rows.nearest(place)
        assert (i, round(score, 9)) == ((int(np.argmax(scores)), round(max(scores), 9)) if plain else (-1, -1.0))
        if place % 3 == 1:
            plain[place % len(plain)] = coming[-1 - place] / 2
            rows.move(place % len(plain), coming[-1 - place] / 2)
        else:
            plain.append(coming[place])
            rows.add(coming[place])


def test_linkage_by_parts_is_that_of_all_rows():
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(40, 12)), 5, axis=0) + 0.35 * rng.normal(size=(200, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = folds.linkage_by_parts(v)
    assert label.tolist() == folds.average_linkage(v).tolist() and 20 < len(set(label.tolist())) < 180
    assert folds.linkage_by_parts(v[:0]).tolist() == []


def test_a_split_pools_both_topics_anew(spark):
    """Edges of another child stay; what is left is pooled in order of time, as the fold says."""
    import datetime as dt

    from tidewatch.operators import chain

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    topics = [("p", None, "confirmed", day(0)), ("c1", "p", "evolving", day(5)), ("c2", "p", "evolving", day(6))]
    articles = [(1, "p", "A"), (2, "p", "B"), (3, "p", "C"), (4, "c1", "D"), (5, "p", "E")]
    t = Tables(
        spark,
        topics=spark.createDataFrame(topics, "topic_id string, merged_into string, lifecycle string, first_seen timestamp"),
        articles=spark.createDataFrame(articles, "article_id long, topic_id string, country_code string"),
        edge_origins=spark.createDataFrame([(2, "p", "c1"), (3, "p", "c2")], "article_id long, topic_id string, origin_topic string"),
        agenda_events=spark.createDataFrame([("p", day(5))], "topic_id string, origin_at timestamp"),
    )
    got = {r["child"]: r for r in chain.splits(t).collect()}
    assert (got["c1"]["moved_back"], got["c1"]["stay"], got["c1"]["child_size"], got["c1"]["parent_scope"], got["c1"]["child_scope"], got["c1"]["event_moves"]) == (1, 3, 2, "A,C,E", "B,D", True)
    assert (got["c2"]["moved_back"], got["c2"]["stay"], got["c2"]["child_size"], got["c2"]["parent_scope"], got["c2"]["event_moves"]) == (1, 3, 1, "A,B,E", False)
    reports = spark.createDataFrame([(i, [float(i), 1.0], c, day(i)) for i, _, c in articles if i != 5] + [(5, None, "E", day(5))], "article_id long, vec array<double>, country_code string, published_at timestamp")
    edges = chain.split_edges(t).where("child = 'c1'").select(F.when(F.col("goes"), 1).otherwise(2).cast("long").alias("topic"), "article_id")
    rows = {r["topic_id"]: r for r in chain.repooled(edges, reports).collect()}
    for topic, ids in ((1, [2, 4]), (2, [1, 3])):
        centre = None
        for i in ids:
            v = folds.unit(np.array([float(i), 1.0]))
            centre = v if centre is None else folds.pool(centre, v, 2.0)
        assert rows[topic]["centroid"] == pytest.approx(centre.tolist()) and rows[topic]["size"] == 2


def test_a_rate_flips_there_and_back(spark):
    bad = {5, 6, 7}
    df = spark.createDataFrame([("a", i, i not in bad, i) for i in range(1, 31)] + [("b", 100, False, 100)], "task string, judgement_id long, ok boolean, created_at long")
    t = Tables(spark, judgements=df.withColumn("created_at", F.col("created_at").cast("timestamp")))
    got = sorted(tuple(r) for r in folds.degradation_flips(t, window=10).collect())
    rate = lambda i: (min(i, 10), sum(j in bad for j in range(max(1, i - 9), i + 1)))
    want, before = [], False
    for i in range(1, 31):
        n, failed = rate(i)
        now = n >= 5 and failed / n > 0.2
        want += [("a", i, now)] if now != before else []
        before = now
    assert got == want == [("a", 6, True), ("a", 15, False)]


def test_a_vector_is_pooled_once_a_row(spark):
    """Work linear in the entries: 20 vectors of 3,000 entries (27 million steps each, were the norm made anew for every entry)."""
    import time

    rows = spark.range(20, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: (i + F.col("id")).cast("double")).alias("x"))
    y = F.transform("x", lambda x: x * 2 + 1)
    start = time.monotonic()
    got = rows.select(lifecycle.size_pooled(F.col("x"), y, F.lit(12), F.lit(3)).alias("v")).collect()
    assert time.monotonic() - start < 20
    x = np.arange(1, 3001, dtype=float)
    a = 0.5**0.5
    b = (1 - a) * 3 / 4
    want = a / (a + b) * x + b / (a + b) * (2 * x + 1)
    assert np.allclose(got[0]["v"], want / np.linalg.norm(want))


def test_nearest_over_many_tiles_with_copies(spark, monkeypatch):
    """Single precision only leaves out; of many equal vectors those with the smallest ids come first."""
    from tidewatch.operators import cells

    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 16))
    x[40:120] = x[40]
    x[200] = x[201] * 3
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, vec array<double>").selectExpr("id", "vec", "cast(null as double) as extra").coalesce(1)
    dealt = cells.cells_of(df, rows_a_cell=1000)
    pairs = []
    monkeypatch.setattr(cells.Cells, "meet", lambda self, visits, run, schema, part=0, also=(): pairs.append((run, visits.toArrow(), self.rows.toArrow())) or spark.createDataFrame([], schema))
    cells.nearest_in(dealt, df, 5, -1.0, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 6)
    for tile in ((32, 50), (512, 4096)):
        monkeypatch.setattr(cells, "TILE", tile)
        run, visits, rows = pairs[0]
        got = run(visits, rows).to_pylist()
        want = {i: sorted((-scores[i, j], j) for j in range(300) if j != i)[:5] for i in range(300)}
        assert {i: sorted((-r["score"], r["neighbour"]) for r in got if r["id"] == i) for i in range(300)} == want


def test_links_leave_no_visits_behind(spark):
    import os

    from tidewatch.operators import cells
    from tidewatch.storage import shared_folder

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(80)], "id long, vec array<double>").selectExpr("id", "vec", "cast(null as double) as extra")
    dealt = cells.cells_of(df, rows_a_cell=20)
    folder = f"{shared_folder(spark).removeprefix('file://')}/tidewatch"
    before = set(os.listdir(folder))
    assert cells.links_within(dealt, df, 0.5, 0.0).count() > 0
    assert set(os.listdir(folder)) == before


def test_links_send_no_vector_to_each_cell(spark):
    """Each vector lies in one array of a block and is sent once, however many cells it reaches; links join what all pairs would."""
    import os

    from tidewatch.operators import cells
    from tidewatch.storage import stored

    rng = np.random.default_rng(21)
    x = rng.normal(size=(260, 6))
    x[200:] = x[:60] + 0.2 * rng.normal(size=(60, 6))
    wide = np.where(np.arange(260) % 5 == 0, rng.uniform(0, 0.2, 260), 0.0)
    df = spark.createDataFrame([(i, x[i].tolist(), float(wide[i])) for i in range(260)], "id long, vec array<double>, extra double")
    plain = df.withColumn("extra", F.lit(None).cast("double"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    angles = np.arccos(np.clip(u @ u.T, -1, 1))

    def sets(pairs):
        of = cells.Joined(260)
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        of.add(pairs[:, 0], pairs[:, 1])
        return of.set_of.tolist()

    dealt = cells.cells_of(plain, block=16, rows_a_cell=20)
    folder = dealt.folder.removeprefix("file:")
    links = cells.links_within(dealt, None, 0.35, 0.0)
    assert "Exchange" not in links._jdf.queryExecution().toString()
    got = [tuple(r) for r in links.collect()]
    want = sets(np.argwhere(angles <= 0.35))
    assert sets(got) == want and 20 < len(set(want)) < 250
    held = [np.load(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("id-") and f.endswith(".npy")]
    assert len(held) > 20 and sorted(np.concatenate(held).tolist()) == list(range(260))

    comps = stored(spark.createDataFrame([(i, r) for i, r in enumerate(want)], "node long, root long"), "components")
    padded = cells.replace(dealt, rows=dealt.rows.drop("extra").join(df.select("id", "extra"), "id"))
    more = cells.links_within(padded, df.where("id % 3 = 0"), 0.35, float(wide.max()), part=30, comps=comps).collect()
    reach = (angles <= 0.35 + wide[:, None] + wide[None]) & (np.arange(260) % 3 == 0)[:, None]
    both = sets(np.r_[np.argwhere(angles <= 0.35), np.argwhere(reach)])
    assert sets([*got, *(tuple(r) for r in more)]) == both != want and all(r["a"] != r["b"] for r in more)
    dealt.forget()
    assert sorted(n for n in os.listdir(folder) if n in (cells.ARRAYS, cells.CALLS)) == [cells.ARRAYS]
    dealt.drop()
    assert not os.path.exists(folder)


def test_a_search_sends_no_row_to_all_cells(spark, monkeypatch):
    """Beyond the nearest cell rows are not sent, but blocks mapped; what comes out is that of all pairs."""
    from tidewatch.operators import cells

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, x[i].tolist(), float(i % 4)) for i in range(300)], "id long, vec array<double>, at double")
    sent = []
    monkeypatch.setattr(cells.Cells, "visits", lambda self, *a, _visits=cells.Cells.visits, **k: (sent.append(1), _visits(self, *a, **k))[1])
    got = {(r["id"], r["neighbour"]) for r in vectors.nearest(df, df, 2, 0.6, block=16, rows_a_cell=20).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 6)
    want = set()
    for i in range(300):
        may = [(-scores[i, j], j) for j in range(300) if j != i and j % 4 <= i % 4 and scores[i, j] >= 0.6]
        want |= {(i, j) for _, j in sorted(may)[:2]}
    assert got == want and len(sent) == 1


def test_clusters_bring_their_means(spark):
    """What seq_11 compares with topics is the mean of each cluster's unit vectors, on one row a cluster."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 8)), 4, axis=0) + 0.2 * rng.normal(size=(120, 8))
    pdf = pd.DataFrame({"article_id": np.arange(120) * 3, "vec": list(x)})
    label = dict(folds.cluster_step(pdf).itertuples(index=False))
    rows = spark.createDataFrame(folds.centred_step(pdf).astype({"size": object}).replace({np.nan: None}), folds.CENTRED).collect()
    assert {r["article_id"]: r["cluster_id"] for r in rows} == label and 5 < len(set(label.values())) < 100
    for r in rows:
        members = [v / np.linalg.norm(v) for a, v in zip(pdf["article_id"], x, strict=True) if label[a] == r["article_id"]]
        assert r["size"] == (len(members) or None) and (r["centroid"] is None) == (len(members) < 2)
        if len(members) > 1:
            mean = np.mean(members, axis=0)
            assert np.allclose(r["centroid"], mean / np.linalg.norm(mean))


def test_references_in_sql_are_those_of_html():
    """The SQL of fn_25 resolves names, numbers and cut references as the page parser does."""
    import html

    import duckdb

    texts = ["a &quot;b&quot; c", "cut &amp", "&amp;&lt;&amp;amp;", "&notit; &notin; &bogus;", "&#65;&#x41;&#x80;&#0;&#xD800;&#99999999999999999999;&#11;", "& &; &#; &#x;", "", "it's&nbsp;é"]
    con = duckdb.connect()
    con.execute("CREATE TABLE h (i INT, s VARCHAR)")
    con.executemany("INSERT INTO h VALUES (?, ?)", list(enumerate(texts)))
    got = con.execute(f"SELECT s, {documents._references('s')} FROM h ORDER BY i").fetchall()
    assert [r[1] or "" for r in got] == [html.unescape(s) for s in texts]
