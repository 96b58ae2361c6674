"""Read models of the dashboard and the open interface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.aggregates import country_coverage, follower_summary, source_health, topic_activity
from tidewatch.operators.filters import active
from tidewatch.operators.joins import origin_articles, page
from tidewatch.operators.windows import best_country
from tidewatch.tables import Tables

_ACT = "SELECT topic_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS media FROM articles WHERE published_at >= :now - INTERVAL '24' HOUR GROUP BY topic_id"
_BEST = "SELECT topic_id, country_code FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, country_code) AS n FROM (SELECT topic_id, country_code, round(sum(score), 3) AS score FROM snapshots GROUP BY ALL)) x WHERE n = 1"


@operator("rd_01", f"SELECT a.topic_id, a.articles, a.media, b.country_code, e.event_id IS NOT NULL AS has_event FROM ({_ACT}) a JOIN topics t ON a.topic_id = t.topic_id AND t.merged_into IS NULL AND t.lifecycle <> 'archived' LEFT JOIN ({_BEST}) b ON a.topic_id = b.topic_id LEFT JOIN agenda_events e ON a.topic_id = e.topic_id ORDER BY a.articles DESC, a.media DESC, a.topic_id LIMIT 20")
def hot_topics(t: Tables, k: int = 20) -> DataFrame:
    """Active topics with most articles of the last day, cut to k before anything is joined to them."""
    top = topic_activity(t).join(active(t.topics).select("topic_id"), "topic_id").orderBy(F.desc("articles"), F.desc("media"), "topic_id").limit(k)
    out = top.join(best_country(t), "topic_id", "left").join(t.agenda_events.select("topic_id", "event_id"), "topic_id", "left")
    return out.select("topic_id", "articles", "media", "country_code", F.col("event_id").isNotNull().alias("has_event"))


@operator("rd_02", "SELECT topic_id, size, CAST(count(*) OVER () AS BIGINT) AS total FROM topics WHERE merged_into IS NULL AND lifecycle IN ('forming', 'confirmed') AND name ILIKE '%click%' AND last_seen >= TIMESTAMP '2024-01-20' ORDER BY size DESC, topic_id LIMIT 10 OFFSET 10")
def topic_list(t: Tables, part: str = "click", number: int = 2, size: int = 10) -> DataFrame:
    rows = t.topics.where(F.col("merged_into").isNull() & F.col("lifecycle").isin("forming", "confirmed") & F.col("name").ilike(f"%{part}%") & (F.col("last_seen") >= F.lit("2024-01-20").cast("timestamp")))
    return page(rows.select("topic_id", "size"), F.desc("size"), "topic_id", number=number, size=size)


@operator("rd_03", "SELECT t.topic_id, coalesce(m.children, '') AS merged_from, coalesce(e.n, 0) AS events, t.merged_into AS redirect FROM topics t LEFT JOIN (SELECT merged_into, string_agg(topic_id, ',' ORDER BY topic_id) AS children FROM topics GROUP BY merged_into) m ON t.topic_id = m.merged_into LEFT JOIN (SELECT topic_id, count(*) AS n FROM agenda_events GROUP BY topic_id) e ON t.topic_id = e.topic_id")
def topic_details(t: Tables) -> DataFrame:
    children = t.topics.where("merged_into IS NOT NULL").groupBy("merged_into").agg(F.array_join(F.array_sort(F.collect_list("topic_id")), ",").alias("merged_from"))
    events = t.agenda_events.groupBy("topic_id").agg(F.count("*").alias("events"))
    own = t.topics.select("topic_id", F.col("merged_into").alias("redirect"))
    out = own.join(children.withColumnRenamed("merged_into", "topic_id"), "topic_id", "left").join(events, "topic_id", "left")
    return out.select("topic_id", F.coalesce("merged_from", F.lit("")).alias("merged_from"), F.coalesce("events", F.lit(0)).alias("events"), "redirect")


@operator("rd_04", "SELECT topic_id, CASE WHEN topic_id = 'click-3' THEN 'Renamed' ELSE name END AS name, locked OR topic_id = 'click-3' AS locked FROM topics")
def renamed(t: Tables, topic: str = "click-3", name: str = "Renamed") -> DataFrame:
    """Topics after a rename by hand, which locks the name."""
    mine = F.col("topic_id") == topic
    return t.topics.select("topic_id", F.when(mine, name).otherwise(F.col("name")).alias("name"), (F.col("locked") | mine).alias("locked"))


@operator("rd_05", "SELECT k.topic_id, k.keyword, k.position, c.countries FROM topic_keywords k JOIN (SELECT topic_id, count(*) AS countries FROM topic_countries GROUP BY topic_id) c ON k.topic_id = c.topic_id")
def topic_dimensions(t: Tables) -> DataFrame:
    c = t.topic_countries.groupBy("topic_id").agg(F.count("*").alias("countries"))
    return t.topic_keywords.join(c, "topic_id").select("topic_id", "keyword", "position", "countries")


@operator("rd_06", "SELECT e.entity_id, sec(date_trunc('day', a.published_at)) AS day, count(*) AS n FROM article_entities e JOIN articles a ON e.article_id = a.article_id GROUP BY ALL")
def entity_timeline(t: Tables) -> DataFrame:
    edges = t.article_entities.select("entity_id", "article_id")
    return edges.join(t.articles.select("article_id", "published_at"), "article_id").groupBy("entity_id", F.unix_timestamp(F.date_trunc("day", "published_at")).alias("day")).agg(F.count("*").alias("n"))


@operator("rd_07", "SELECT entity_id, utterances FROM entities WHERE entity_type = 'person' ORDER BY utterances DESC, entity_id LIMIT 20")
def entity_list(t: Tables, kind: str = "person", size: int = 20) -> DataFrame:
    return t.entities.where(F.col("entity_type") == kind).orderBy(F.desc("utterances"), "entity_id").limit(size).select("entity_id", "utterances")


_HEALTH = "SELECT source_id, count(*) AS jobs, count(*) FILTER (status = 'success') AS ok FROM jobs WHERE scheduled_at >= :now - INTERVAL '24' HOUR GROUP BY source_id"


@operator("rd_08", f"SELECT s.source_id, coalesce(h.jobs, 0) AS jobs, coalesce(h.ok, 0) AS ok, c.confidence FROM sources s LEFT JOIN ({_HEALTH}) h ON s.source_id = h.source_id JOIN (SELECT country_code, CASE WHEN count(*) FILTER (status = 'active') >= 0.85 * count(*) THEN 'high' WHEN count(*) FILTER (status = 'active') >= 0.7 * count(*) THEN 'medium' ELSE 'low' END AS confidence FROM sources GROUP BY country_code) c ON s.country_code = c.country_code ORDER BY s.audience_weight DESC NULLS LAST, s.source_id LIMIT 50")
def source_list(t: Tables, size: int = 50) -> DataFrame:
    top = t.sources.orderBy(F.desc_nulls_last("audience_weight"), "source_id").limit(size).select("source_id", "country_code")
    out = top.join(source_health(t).select("source_id", "jobs", "ok"), "source_id", "left").join(country_coverage(t).select("country_code", "confidence"), "country_code")
    return out.select("source_id", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("ok", F.lit(0)).alias("ok"), "confidence")


@operator("rd_09", "SELECT alert_id, is_read, (SELECT count(*) FROM alerts WHERE user_id = 1 AND NOT is_read) AS unread FROM alerts WHERE user_id = 1 ORDER BY created_at DESC, alert_id LIMIT 20")
def alert_list(t: Tables, user: int = 1, size: int = 20) -> DataFrame:
    own = t.alerts.where(F.col("user_id") == user)
    unread = own.agg(F.count_if(~F.col("is_read")).alias("unread"))
    return own.orderBy(F.desc("created_at"), "alert_id").limit(size).select("alert_id", "is_read").join(F.broadcast(unread))


_SUM = "SELECT event_id, count(*) AS followers, max(round((sec(f.published_at) - sec(e.origin_at)) / 3600.0e0, 4)) AS longest FROM followers f JOIN agenda_events e USING (event_id) GROUP BY event_id"


@operator("rd_10", f"SELECT e.event_id, e.status, coalesce(s.followers, 0) AS followers, s.longest, e.xcorr_p < 0.05 OR e.granger_p < 0.05 AS significant FROM agenda_events e LEFT JOIN ({_SUM}) s ON e.event_id = s.event_id WHERE e.status <> 'dismissed' ORDER BY CASE e.status WHEN 'confirmed' THEN 0 WHEN 'suspected' THEN 1 WHEN 'watching' THEN 2 ELSE 3 END, e.event_id LIMIT 40")
def event_list(t: Tables, size: int = 40) -> DataFrame:
    order = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "suspected", 1).when(F.col("status") == "watching", 2).otherwise(3)
    top = t.agenda_events.where("status <> 'dismissed'").orderBy(order, "event_id").limit(size)
    out = top.join(follower_summary(t), "event_id", "left")
    return out.select("event_id", "status", F.coalesce("followers", F.lit(0)).alias("followers"), "longest", ((F.col("xcorr_p") < 0.05) | (F.col("granger_p") < 0.05)).alias("significant"))


@operator("rd_11", """SELECT e.event_id, s.name AS source_name, o.article_id AS origin_article FROM agenda_events e JOIN sources s ON e.origin_source_id = s.source_id LEFT JOIN (SELECT event_id, article_id FROM (SELECT e.event_id, a.article_id, row_number() OVER (PARTITION BY e.event_id ORDER BY a.published_at, a.article_id) AS n FROM agenda_events e JOIN articles a
    ON e.topic_id = a.topic_id AND e.origin_source_id = a.source_id AND a.published_at BETWEEN e.origin_at - INTERVAL '6' HOUR AND e.origin_at + INTERVAL '6' HOUR) x WHERE n = 1) o ON e.event_id = o.event_id""")
def event_details(t: Tables) -> DataFrame:
    own = t.agenda_events.select("event_id", F.col("origin_source_id").alias("source_id")).join(t.sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return own.join(origin_articles(t), "event_id", "left").select("event_id", "source_name", F.col("article_id").alias("origin_article"))


@operator("rd_12", "SELECT event_id, seq, field, actor FROM revisions")
def revision_log(t: Tables) -> DataFrame:
    return t.revisions.select("event_id", "seq", "field", "actor")


@operator("rd_13", "SELECT e.entity_id, e.name, count(a.article_id) AS articles FROM entities e LEFT JOIN article_entities a ON e.entity_id = a.entity_id WHERE e.entity_id IN (7, 42, 99) GROUP BY e.entity_id, e.name")
def entity_details(t: Tables, ids: tuple[int, ...] = (7, 42, 99)) -> DataFrame:
    own = t.entities.where(F.col("entity_id").isin(*ids)).select("entity_id", "name")
    return own.join(t.article_entities.select("entity_id", "article_id"), "entity_id", "left").groupBy("entity_id", "name").agg(F.count("article_id").alias("articles"))
