"""Registered queries without SQL, each run over its tables and held against what it must satisfy."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch import registry
from tidewatch.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda key: registry.queries()[key](spark, SF)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_every_query_without_sql_runs(run):
    for key in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        df = run(key)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0, key


def test_pages_keep_their_rows(run, tables):
    n = tables.pages.count()
    texts = run("fn_24")
    assert texts.count() == n and {r[0] for r in texts.select("status").distinct().collect()} <= {"full", "partial", "failed"}
    assert all((len(r["text"]) >= 10) == (r["status"] != "failed") and (r["status"] == "full") == (r["method"] in ("density", "blocks")) for r in texts.collect())
    crawled = run("src_03").collect()
    assert len({r["page_id"] for r in crawled}) == len(crawled) > 0 and {r["discoverer"] for r in crawled} <= {"sitemap", "list_page", "given"}
    preview = run("src_26").collect()
    assert len(preview) == 5 and all((r["warning"] == "short") <= (r["status"] != "full") for r in preview)


def test_links_stay_on_their_host(run):
    links = run("fn_26").collect()
    assert links and all(r["link"].split("/")[2].split(":")[0] == r["host"] and r["signature"].endswith("a") for r in links)
    groups = run("src_05").collect()
    assert groups and all(r["links"] >= 5 for r in groups) and len({r["page_id"] for r in groups}) == len(groups)


def test_entities(run):
    kinds = {r["kind"]: r for r in run("fn_07").collect()}
    assert set(kinds) <= {"ORG", "LOCATION", "PEOPLE", "OTHER"} and all(r["mentions"] >= r["entities"] for r in kinds.values())
    topics = run("seq_35")
    assert topics.groupBy("topic_id").count().where("count > 20").count() == 0 and topics.where("entity_type NOT IN ('person', 'thinktank')").count() == 0
    assert run("fn_34").where("mentions < 1").count() == 0 and run("fn_08").where("n < 1").count() == 0


def test_assignment_is_one_topic_a_report(run):
    rows = run("seq_04").collect()
    topic = {r["article_id"]: r["topic_id"] for r in rows}
    assert len(topic) == len(rows)
    assert all(topic[r["duplicate_of"]] == r["topic_id"] for r in rows if r["duplicate_of"] is not None)
    state = run("seq_05").collect()
    assert sum(r["size"] for r in state) == sum(r["duplicate_of"] is None for r in rows)
    assert all(r["lifecycle"] == ("nascent" if r["size"] <= 1 else "forming" if r["size"] < 10 else "confirmed") for r in state)


def test_echoes_point_at_nodes(run):
    rows = run("seq_03").collect()
    nodes = {r["article_id"]: r for r in rows if not r["is_duplicate"]}
    assert all(r["node_id"] in nodes for r in rows) and sum(n["related"] for n in nodes.values()) == len(rows) - len(nodes)
    assert all(r["similarity"] >= (0.65 if r["rule"] == "same_day" else 0.85) for r in rows if r["is_duplicate"])


def test_merges_end_in_live_topics(run):
    rows = {r["id"]: r for r in run("seq_07").collect()}
    assert all(rows[r["root"]]["root"] == r["root"] for r in rows.values())
    assert all(r["root"] == i for i, r in rows.items() if i % 13 == 0 or i % 7 == 0)


def test_recluster_moves(run):
    rows = run("seq_11").collect()
    assert {r["action"] for r in rows} <= {"moved", "kept", "noise"} and all((r["topic_id"] is None) == (r["action"] == "noise") for r in rows)
    verdicts = run("seq_13").collect()
    assert sum(r["size"] for r in verdicts) == len(rows) and all(r["size"] >= 10 for r in verdicts if r["verdict"] != "noise")


def test_replays_are_isolated(run):
    rows = run("seq_42").collect()
    assert len({r["case_id"] for r in rows}) == len(rows) and all(1 <= r["topics"] <= r["articles"] for r in rows)


def test_published_version_is_whole(run, tables):
    assert run("src_18").count() == tables.topics.count()


def test_statistics_are_probabilities(run):
    for key in ("sta_03", "sta_04"):
        df = run(key)
        p = [c for c in df.columns if c.endswith("_p")]
        assert p and df.where(" OR ".join(f"{c} < 0 OR {c} > 1" for c in p)).count() == 0
    assert run("seq_41").where("common > n").count() == 0


def test_tables_of_ones_own_need_no_topic_numbers(spark, tables):
    from tidewatch.operators import aggregates, graphs, joins, reads

    own = Tables(
        spark, articles=tables.articles.drop("topic_no"), topics=tables.topics.drop("topic_no"), sources=tables.sources, entities=tables.entities, texts=tables.texts, topic_keywords=tables.topic_keywords, relations=tables.relations,
        article_entities=tables.article_entities, mentions=tables.mentions, revisions=tables.revisions, topic_countries=tables.topic_countries,
    )
    for f in (aggregates.label_keywords, aggregates.global_coverage, aggregates.cluster_list, aggregates.nearest_ranks, joins.topic_articles_sources, joins.evidence_page, joins.entity_articles, joins.keyword_match, graphs.ego_networks, reads.topic_dimensions, reads.entity_timeline, reads.revision_log):
        assert f(own).limit(1).count() == 1, f.__name__


def test_ranks_span_ranges(spark):
    from tidewatch.operators.aggregates import global_ranks

    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 5000).alias("v"))
    rows = global_ranks(df, ["k"], "v").collect()
    for k in range(3):
        own = sorted((r["v"], r["place"]) for r in rows if r["k"] == k)
        assert [p for _, p in own] == list(range(len(own)))
