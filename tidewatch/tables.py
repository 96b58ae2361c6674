"""Logical tables of the engine, and their binding to the driver's star schema.

Operators read a Tables object: give it DataFrames of the shapes below by name, or bind it to the
synthetic tables, where every logical table is a short query. The same texts are the common table
expressions of each operator's oracle SQL, so both engines start from equal rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LOGICAL = {
    "articles": """SELECT event_id AS article_id, concat(event_type, '-', topic_no) AS topic_id, event_type AS kind, topic_no, user_id AS source_id,
        concat('C', user_id % 12) AS country_code, CAST(ts AS TIMESTAMP) AS published_at, user_id % 5 = 0 AS is_wire, event_id % 11 = 0 AS is_duplicate,
        CASE WHEN event_id % 17 = 0 THEN 'crawled' ELSE 'feed' END AS time_source, CASE WHEN event_id % 7 = 0 THEN 'partial' ELSE 'full' END AS content_status,
        concat(event_type, ' Report ', user_id % 10) AS title, value, CASE WHEN event_id % 2 = 0 THEN 'merge' ELSE 'online' END AS assign_method,
        CAST(event_id % 1000 AS DOUBLE) / 1000 AS weight
        FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id % 8 ELSE 8 + (event_id * 7) % 180 END AS topic_no FROM {events}) x""",
    "sources": """SELECT source_id, concat('Source ', source_id) AS name, CASE WHEN source_id % 9 = 0 THEN concat('ZH ', source_id) END AS name_zh, country_code,
        concat('https://s', source_id, '.example.com/feed') AS feed_url, CASE WHEN source_id % 4 = 0 THEN 'rsshub' ELSE 'native' END AS collect_mode,
        CASE WHEN source_id % 5 = 0 THEN 'agency' WHEN source_id % 5 = 1 THEN 'broadcast' ELSE 'newspaper' END AS media_type,
        CAST(source_id % 20 + 1 AS INT) AS poll_interval_min, CASE WHEN source_id % 13 = 0 THEN NULL ELSE CAST(source_id % 100 AS DOUBLE) / 100 END AS audience_weight,
        CASE source_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' WHEN 2 THEN 'paused' ELSE 'active' END AS status,
        CASE WHEN source_id % 8 = 0 THEN concat('{{"focus": ', source_id % 3, '}}') END AS config,
        CASE WHEN source_id % 11 = 0 THEN NULL ELSE last_at END AS last_success_at
        FROM (SELECT source_id, country_code, max(published_at) AS last_at FROM {articles} GROUP BY source_id, country_code) x""",
    "topics": """SELECT topic_id, concat('Topic ', topic_id) AS name, topic_no, first_seen, last_seen, size,
        CASE WHEN topic_no % 17 = 5 THEN 'evolving' WHEN topic_no % 23 = 3 THEN 'archived' WHEN size <= 1 THEN 'nascent' WHEN size < 10 THEN 'forming' ELSE 'confirmed' END AS lifecycle,
        CASE WHEN topic_no % 17 = 5 THEN concat(kind, '-', (topic_no + 1) % 8) END AS merged_into, topic_no % 19 = 0 AS locked,
        CASE topic_no % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END AS naming_status
        FROM (SELECT topic_id, kind, topic_no, min(published_at) AS first_seen, max(published_at) AS last_seen, count(*) AS size FROM {articles} GROUP BY topic_id, kind, topic_no) x""",
    "topic_keywords": "SELECT topic_id, concat('kw', (topic_no * (k + 3) + k) % 50) AS keyword, k AS position FROM {topics} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k)",
    "topic_countries": "SELECT DISTINCT topic_id, country_code FROM {articles}",
    "no_merge": "SELECT topic_id AS a, concat(substring(topic_id, 1, length(topic_id) - length(CAST(topic_no AS STRING))), topic_no % 8) AS b FROM {topics} WHERE topic_no % 29 = 11",
    "snapshots": """SELECT country_code, topic_id, window_start, window_start + INTERVAL '1' DAY AS window_end, n AS article_count, sources, score,
        CAST(row_number() OVER (PARTITION BY country_code, window_start ORDER BY score DESC, n DESC, topic_id) AS INT) AS rank,
        CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(n % 10 AS DOUBLE) / 10 END AS negative
        FROM (SELECT country_code, topic_id, date_trunc('day', published_at) AS window_start, count(*) AS n, count(DISTINCT source_id) AS sources, round(sum(value), 4) AS score
        FROM {articles} GROUP BY country_code, topic_id, date_trunc('day', published_at)) x""",
    "firsts": """SELECT topic_id, country_code, source_id, article_id, published_at FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, country_code ORDER BY published_at, article_id) AS n
        FROM {articles} WHERE NOT is_duplicate) x WHERE n = 1""",
    "agenda_events": """SELECT concat('E-', f.topic_id) AS event_id, f.topic_id, t.name AS topic_name, CASE t.topic_no % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' WHEN 2 THEN 'watching' WHEN 3 THEN 'revised' ELSE 'dismissed' END AS status,
        CASE t.topic_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN t.topic_no % 6 = 0 THEN 'person' ELSE 'media' END AS origin_type, f.country_code AS origin_country, f.source_id AS origin_source_id, f.published_at AS origin_at,
        CAST((t.topic_no * 7) % 100 AS DOUBLE) / 100 AS xcorr_p, CAST((t.topic_no * 13) % 100 AS DOUBLE) / 100 AS granger_p, CAST((t.topic_no * 29) % 100 AS DOUBLE) / 100 AS qap_p,
        t.topic_no % 4 = 0 AS insufficient_data, CASE WHEN t.topic_no % 7 = 0 THEN NULL ELSE CAST(t.topic_no % 11 AS INT) END AS review_score, CASE WHEN t.topic_no % 5 = 4 THEN t.topic_no % 2 = 0 END AS is_false_positive,
        CASE WHEN t.topic_no % 7 = 0 THEN 'origin_country' WHEN t.topic_no % 7 = 3 THEN 'origin_at,confidence' ELSE '' END AS locked_fields
        FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published_at, article_id) AS n FROM {firsts}) f JOIN {topics} t ON f.topic_id = t.topic_id WHERE f.n = 1""",
    "followers": """SELECT e.event_id, e.topic_id, e.origin_country, f.country_code, f.source_id, f.article_id, f.published_at
        FROM {agenda_events} e JOIN {firsts} f ON e.topic_id = f.topic_id WHERE f.country_code <> e.origin_country AND f.published_at >= e.origin_at""",
    "revisions": """SELECT concat('E-', topic_id) AS event_id, topic_id, CAST(article_id % 40 AS INT) AS seq, CASE article_id % 4 WHEN 0 THEN 'origin_at' WHEN 1 THEN 'merge' WHEN 2 THEN 'confidence' ELSE 'status' END AS field,
        CASE WHEN article_id % 3 = 0 THEN 'human' ELSE 'machine' END AS actor, CASE WHEN article_id % 13 = 0 THEN 'unknown' ELSE substring(CAST(published_at AS STRING), 1, 19) END AS occurred_at, article_id,
        concat('v', article_id % 5) AS before_value, concat('v', CASE WHEN article_id % 19 = 0 THEN article_id % 5 ELSE article_id % 5 + 1 END) AS after_value, CASE WHEN article_id % 23 = 0 THEN '{{}}' WHEN article_id % 37 = 0 THEN NULL ELSE concat('{{"id": ', article_id, '}}') END AS evidence,
        CASE WHEN article_id % 3 <> 0 AND article_id % 29 <> 0 THEN 'rules' END AS model, CASE WHEN article_id % 3 <> 0 THEN 'p1' END AS prompt_version, CASE WHEN article_id % 3 = 0 AND article_id % 31 <> 0 THEN 'user7' END AS actor_id, article_id % 6 = 1 AS rejected
        FROM {articles}""",
    "aliases": "SELECT DISTINCT word AS name FROM (SELECT lower(split_part(title, ' ', 1)) AS word FROM {texts} UNION ALL SELECT lower(split_part(title, ' ', 2)) FROM {texts} UNION ALL SELECT lower(name) FROM {entities}) x WHERE regexp_replace(word, '[a-z0-9]+', '') = '' AND length(word) >= 4",
    "edge_origins": """SELECT a.article_id, a.topic_id, c.child AS origin_topic FROM {articles} a JOIN (SELECT topic_id AS child, merged_into, row_number() OVER (PARTITION BY merged_into ORDER BY topic_id) - 1 AS place, count(*) OVER (PARTITION BY merged_into) AS children
        FROM {topics} WHERE merged_into IS NOT NULL) c ON c.merged_into = a.topic_id AND a.article_id % c.children = c.place WHERE a.assign_method = 'merge'""",
    "known_events": "SELECT DISTINCT topic_id FROM {revisions} WHERE field = 'status' AND actor = 'human'",
    "merge_candidates": """SELECT topic_id, other FROM (SELECT topic_id, lag(topic_id) OVER (PARTITION BY lifecycle ORDER BY first_seen, topic_id) AS other FROM {topics}) x WHERE other IS NOT NULL
        UNION SELECT topic_id, merged_into FROM {topics} WHERE merged_into <> topic_id UNION SELECT b, a FROM {no_merge} WHERE a <> b""",
    "entities": """SELECT c_custkey AS entity_id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN concat('ZH ', c_custkey) WHEN c_custkey % 6 = 1 THEN '' END AS name_zh, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'thinktank' ELSE 'party' END AS entity_type,
        concat('C', c_nationkey % 12) AS country_code, CAST(c_custkey % 5 AS INT) AS priority, c_custkey % 4 = 0 AS is_seed, CAST(c_custkey % 7 AS INT) AS utterances, c_custkey % 9 <> 0 AS monitored FROM {customer}""",
    "article_entities": "SELECT o_orderkey % 10000 AS article_id, o_custkey AS entity_id, o_orderkey % 2 = 0 AS is_primary FROM {orders}",
    "mentions": """SELECT o_custkey AS subject, o_custkey + 1 + o_orderkey % 5 AS object, CASE o_orderkey % 4 WHEN 0 THEN 'ally' WHEN 1 THEN 'criticises' WHEN 2 THEN 'funds' ELSE 'cites' END AS relation, o_orderkey AS article_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, CAST(o_orderdate AS TIMESTAMP) AS published_at FROM {orders}""",
    "relations": """SELECT subject, object, relation, count(*) AS evidence_count, min(published_at) AS first_seen, max(published_at) AS last_seen,
        max(CASE level WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.4 END) AS base_confidence FROM {mentions} GROUP BY subject, object, relation""",
    "jobs": """SELECT event_id AS job_id, user_id AS source_id, CASE user_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'crawl' ELSE 'gdelt' END AS channel, CAST(ts AS TIMESTAMP) AS scheduled_at, CAST(event_id % 4 AS INT) AS retry_count,
        CASE WHEN event_id % 9 = 0 THEN 'permanent_failure' WHEN event_id % 5 = 0 THEN 'temporary_failure' WHEN event_id % 31 = 0 THEN 'pending' ELSE 'success' END AS status, CAST(event_id % 50 AS INT) AS articles_found, CAST(event_id % 20 AS INT) AS articles_new,
        concat('{{"avg_delay_min": ', event_id % 60, '}}') AS latency_stats FROM {events}""",
    "latency": """SELECT event_id AS article_id, user_id AS source_id, CASE user_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'crawl' ELSE 'gdelt' END AS channel, CAST(event_id % 700 * 10000 AS BIGINT) AS latency_ms FROM {events}""",
    "rules": """SELECT * FROM (VALUES (1, 1, 'growth_rate', 50.0e0, 'C1,C2,C3', 'kw3', true), (2, 1, 'top_n', 5.0e0, 'C0,C4', '', true), (3, 2, 'neg_ratio', 0.3e0, 'C5,C6', 'kw7', true),
        (4, 2, 'growth_rate', 150.0e0, 'C7', '', true), (5, 3, 'top_n', 10.0e0, 'C8,C9,C10', 'kw12', true), (6, 3, 'top_n', 3.0e0, 'C11', '', false)) AS v(rule_id, user_id, condition, threshold, countries, keyword, enabled)""",
    "alerts": """SELECT event_id AS alert_id, CAST(event_id % 6 + 1 AS INT) AS rule_id, CAST(user_id % 5 AS INT) AS user_id, concat(event_type, '-', event_id % 8) AS topic_id, CAST(ts AS TIMESTAMP) AS created_at, event_id % 3 = 0 AS is_read,
        CAST(event_id % 4 AS INT) AS attempts, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'sent' END AS delivery FROM {events} WHERE event_id % 10 = 0""",
    "subscriptions": """SELECT user_id AS subscription_id, concat('C', user_id % 12) AS country_code, CASE WHEN user_id % 2 = 0 THEN 'daily' ELSE 'weekly' END AS period, user_id % 7 <> 0 AS enabled,
        CASE WHEN user_id % 6 = 0 THEN NULL ELSE last_at END AS last_sent_at FROM (SELECT user_id, min(CAST(ts AS TIMESTAMP)) + INTERVAL '1' DAY * (user_id % 31) AS last_at FROM {events} GROUP BY user_id) x""",
    "texts": """SELECT doc_id AS article_id, source AS source_id, lang AS language, text AS content, substring(split_part(text, chr(10), 1), 1, 80) AS title, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS published_at, n_chars, concat('topic-', doc_id % 40) AS topic_id FROM {documents}""",
    "feed_files": """SELECT source_id AS feed_id, CASE WHEN source_id IN ('src1', 'src3') THEN concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>', source_id, '</title>', array_join(transform(array_sort(collect_list(struct(n, article_id))), x -> concat('<entry><title>Item ', x.article_id, ' &amp; more</title><link rel="self" href="s"/><link href="https://', source_id, '.example.com/a/', x.article_id, '?a=1&amp;b=2"/><summary>s</summary></entry>')), ''), '</feed>')
        ELSE concat('<rss version="2.0"><channel><title>', source_id, '</title>', array_join(transform(array_sort(collect_list(struct(n, article_id))), x -> concat('<item><title>Item ', x.article_id, ' &amp; more</title><link>https://', source_id, '.example.com/a/', x.article_id, '?a=1&amp;b=2</link><description>d</description></item>')), ''), '</channel></rss>') END AS xml
        FROM (SELECT source_id, article_id, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id) AS n FROM {texts}) x WHERE n <= 50 GROUP BY source_id""",
    "sitemap_files": """SELECT host, url, xml, is_root FROM (SELECT host, concat('https://', host, '/sitemap.xml') AS url, concat('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://', host, '/part-0.xml</loc></sitemap><sitemap><loc>https://', host, '/part-1.xml</loc></sitemap><sitemap><loc>https://', host, '/sitemap.xml</loc></sitemap></sitemapindex>') AS xml, true AS is_root
        FROM (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM {pages}) h UNION ALL
        SELECT host, concat('https://', host, '/part-', part, '.xml'), concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', array_join(transform(array_sort(collect_list(struct(page_id, url))), x -> concat('<url><loc>', replace(x.url, '&', '&amp;'), '</loc></url>')), ''), '</urlset>'), false
        FROM (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, page_id % 2 AS part, page_id, url FROM {pages}) p GROUP BY host, part) x""",
    "audit": """SELECT event_id AS audit_id, concat('user', user_id) AS actor, event_type AS action, CASE WHEN event_id % 6 = 0 THEN 'denied' ELSE 'ok' END AS result, CAST(ts AS TIMESTAMP) AS at FROM {events}""",
    "judgements": """SELECT event_id AS judgement_id, event_type AS task, concat(event_type, '-', event_id % 8) AS topic_id, CASE event_id % 3 WHEN 0 THEN 'politics' WHEN 1 THEN 'economy' ELSE 'health' END AS label, event_id % 7 <> 0 AS ok, CAST(floor(value * 100) AS BIGINT) AS latency_ms, CAST(ts AS TIMESTAMP) AS created_at FROM {events}""",
    "stages": """SELECT event_id AS article_id, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'failed' END AS language, CASE event_id % 5 WHEN 0 THEN 'failed' ELSE 'done' END AS embedding, CASE event_id % 4 WHEN 0 THEN 'running' ELSE 'done' END AS cluster, CASE event_id % 7 WHEN 0 THEN 'skipped' ELSE 'done' END AS index, CASE event_id % 2 WHEN 0 THEN 'pending' ELSE 'done' END AS entity FROM {events}""",
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Tables:
    """Logical tables by attribute: those given, else those bound to the driver's tables in sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, **given: DataFrame):
        self.spark, self.sf_dir, self._known = spark, sf_dir, dict(given)

    def __getattr__(self, name: str) -> DataFrame:
        known = self.__dict__["_known"]
        if name not in known:
            if name in LOGICAL:
                text = LOGICAL[name]
                known[name] = self.spark.sql(text, **{n: getattr(self, n) for n in dict.fromkeys(_NAME.findall(text))})
            elif name in RAW:
                known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return known[name]

    @cached_property
    def now(self):
        from pyspark.sql import functions as F

        return F.expr(NOW)


def ctes(sql: str) -> str:
    """sql after the logical tables that it names, as DuckDB reads them."""
    found: dict[str, str] = {}

    def need(text: str) -> None:
        for name in LOGICAL:
            if name not in found and re.search(rf"\b{name}\b", text):
                body = LOGICAL[name]
                need(" ".join(n for n in _NAME.findall(body) if n in LOGICAL))
                found[name] = _NAME.sub(r"\1", body).replace("{{", "{").replace("}}", "}")

    need(sql)
    sql, own = sql.strip(), [f"{n} AS ({b})" for n, b in found.items()]
    if not own:
        return sql
    if sql.startswith("WITH "):
        return f"WITH RECURSIVE {', '.join(own)}, {sql[5:]}"
    return f"WITH {', '.join(own)} {sql}"
