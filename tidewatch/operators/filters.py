"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.tables import Tables


def active(topics: DataFrame, since: Column | None = None) -> DataFrame:
    """Topics neither merged away nor archived, last seen at since or later."""
    out = topics.where(F.col("merged_into").isNull() & (F.col("lifecycle") != "archived"))
    return out if since is None else out.where(F.col("last_seen") >= since)


def days_before(when: Column, days: int) -> Column:
    return when - F.expr(f"INTERVAL '{days}' DAY")


def hours_before(when: Column, hours: int) -> Column:
    return when - F.expr(f"INTERVAL '{hours}' HOUR")


@operator("flt_01", "SELECT topic_id, lifecycle FROM topics WHERE merged_into IS NULL AND lifecycle <> 'archived' AND last_seen >= :now - INTERVAL '7' DAY")
def active_topics(t: Tables) -> DataFrame:
    return active(t.topics, days_before(t.now, CONFIG.archive_days)).select("topic_id", "lifecycle")


@operator("flt_02", "SELECT topic_id, sec(last_seen) AS seen FROM topics WHERE merged_into IS NULL AND lifecycle <> 'archived' ORDER BY last_seen DESC, topic_id LIMIT 200")
def detection_batch(t: Tables) -> DataFrame:
    return active(t.topics).orderBy(F.desc("last_seen"), "topic_id").limit(CONFIG.detection_batch).select("topic_id", F.unix_timestamp("last_seen").alias("seen"))


@operator("flt_03", "SELECT article_id FROM articles WHERE value > 1 AND published_at >= least(:now - INTERVAL '24' HOUR, TIMESTAMP '2024-01-29 06:00:00')")
def window_documents(t: Tables, degraded_from: str | None = "2024-01-29 06:00:00") -> DataFrame:
    """Articles of the recluster window, stretched back to the start of a degradation."""
    cutoff = hours_before(t.now, CONFIG.recluster_hours)
    if degraded_from:
        cutoff = F.least(cutoff, F.lit(degraded_from).cast("timestamp"))
    return t.articles.where((F.col("value") > 1) & (F.col("published_at") >= cutoff)).select("article_id")


@operator("flt_04", "SELECT article_id FROM articles WHERE published_at >= :now - INTERVAL '3' DAY AND NOT is_duplicate AND content_status = 'full' ORDER BY published_at DESC, article_id LIMIT 500")
def relation_scan(t: Tables, days: int = 3, limit: int = 500) -> DataFrame:
    fresh = (F.col("published_at") >= days_before(t.now, days)) & ~F.col("is_duplicate") & (F.col("content_status") == "full")
    return t.articles.where(fresh).orderBy(F.desc("published_at"), "article_id").limit(limit).select("article_id")


@operator("flt_05", "SELECT topic_id FROM topics WHERE name ILIKE '%ERROR-1%'")
def named_like(t: Tables, part: str = "ERROR-1") -> DataFrame:
    return t.topics.where(F.col("name").ilike(f"%{part}%")).select("topic_id")


@operator("flt_06", """SELECT topic_id FROM (SELECT topic_id, list(country_code) AS scope FROM topic_countries GROUP BY topic_id) x
    WHERE list_contains(scope, 'C3') AND len(list_intersect(scope, ['C1', 'C5'])) > 0""")
def scope_contains(t: Tables, every: str = "C3", some: tuple[str, ...] = ("C1", "C5")) -> DataFrame:
    scope = t.topic_countries.groupBy("topic_id").agg(F.collect_set("country_code").alias("scope"))
    return scope.where(F.array_contains("scope", every) & F.arrays_overlap("scope", F.array(*map(F.lit, some)))).select("topic_id")


@operator("flt_07", "SELECT country_code, count(*) AS n FROM articles WHERE country_code IN ('C0', 'C1', 'C2') GROUP BY country_code")
def role_scope(t: Tables, countries: tuple[str, ...] = ("C0", "C1", "C2")) -> DataFrame:
    return t.articles.where(F.col("country_code").isin(*countries)).groupBy("country_code").agg(F.count("*").alias("n"))


@operator("flt_08", "SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-11'")
def calendar_day(t: Tables, day: str = "2024-01-10") -> DataFrame:
    start = F.lit(day).cast("timestamp")
    return t.articles.where((F.col("published_at") >= start) & (F.col("published_at") < start + F.expr("INTERVAL '1' DAY"))).select("article_id")


@operator("flt_09", "SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '2024-01-10 00:00:00' AND published_at <= TIMESTAMP '2024-01-10 23:59:59'")
def map_day(t: Tables, day: str = "2024-01-10") -> DataFrame:
    """The closed day of the map: what falls into its last second's fraction is left out, as there."""
    return t.articles.where(F.col("published_at").between(F.lit(f"{day} 00:00:00").cast("timestamp"), F.lit(f"{day} 23:59:59").cast("timestamp"))).select("article_id")


@operator("flt_10", "SELECT subject, object, relation FROM relations WHERE subject = 42 OR object = 42")
def edges_of(t: Tables, entity: int = 42) -> DataFrame:
    return t.relations.where((F.col("subject") == entity) | (F.col("object") == entity)).select("subject", "object", "relation")


@operator("flt_11", "SELECT entity_id, priority FROM entities WHERE is_seed AND monitored ORDER BY priority DESC, name")
def seeds(t: Tables, seed: bool = True) -> DataFrame:
    return t.entities.where((F.col("is_seed") == seed) & F.col("monitored")).orderBy(F.desc("priority"), "name").select("entity_id", "priority")


@operator("flt_12", "SELECT source_id FROM sources WHERE poll_interval_min <= 5 OR coalesce(json_extract_string(config, '$.focus'), '0') = '1'")
def focus_sources(t: Tables) -> DataFrame:
    flag = F.coalesce(F.get_json_object("config", "$.focus"), F.lit("0")) == "1"
    return t.sources.where((F.col("poll_interval_min") <= 5) | flag).select("source_id")


@operator("flt_13", "SELECT source_id FROM sources WHERE status IN ('active', 'degraded')")
def crawlable(t: Tables) -> DataFrame:
    return t.sources.where(F.col("status").isin("active", "degraded")).select("source_id")


@operator("flt_14", "SELECT topic_id FROM topics WHERE naming_status IN ('pending', 'failed') AND merged_into IS NULL ORDER BY last_seen DESC, topic_id LIMIT 50")
def pending_naming(t: Tables, limit: int = 50) -> DataFrame:
    open_ = F.col("naming_status").isin("pending", "failed") & F.col("merged_into").isNull()
    return t.topics.where(open_).orderBy(F.desc("last_seen"), "topic_id").limit(limit).select("topic_id")


def valid_entity(name: Column) -> Column:
    """Two characters or more, not digits alone, at least one letter or digit."""
    name = F.trim(name)
    return (F.length(name) >= 2) & ~name.rlike("^[0-9]+$") & name.rlike(r"(?U)[\p{L}\p{N}]")


@operator("flt_15", r"SELECT name, trim(name) IS NOT NULL AND length(trim(name)) >= 2 AND NOT regexp_full_match(trim(name), '[0-9]+') AND regexp_matches(trim(name), '[\p{L}\p{N}]') AS valid FROM (VALUES ('A'), ('UN'), ('2024'), ('--'), ('G20'), ('Éa'), (' x ')) AS v(name)")
def entity_names(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(x,) for x in ("A", "UN", "2024", "--", "G20", "Éa", " x ")], "name string")
    return names.select("name", valid_entity(F.col("name")).alias("valid"))


@operator("flt_16", """SELECT topic_id, list_aggregate(list(keyword ORDER BY position), 'string_agg', ',') AS kept FROM
    (SELECT topic_id, keyword, min(position) AS position FROM topic_keywords WHERE keyword NOT IN ('kw1', 'kw3', 'kw10') GROUP BY topic_id, keyword) x GROUP BY topic_id""")
def without_blacklist(t: Tables, blacklist: tuple[str, ...] = ("kw1", "kw3", "kw10")) -> DataFrame:
    """Keywords without blacklisted ones, distinct, in order of first occurrence."""
    words = t.topic_keywords.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "keyword"))), lambda x: x["keyword"]).alias("words"))
    kept = words.select("topic_id", F.array_except(F.array_distinct("words"), F.array(*map(F.lit, blacklist))).alias("kept"))
    return kept.where(F.size("kept") > 0).select("topic_id", F.array_join("kept", ",").alias("kept"))


def due(period: Column, last: Column, now: Column) -> Column:
    """Never sent, or daily and not yet today, or weekly and seven days ago or more."""
    days = F.datediff(F.to_date(now), F.to_date(last))
    return F.when(last.isNull(), True).when(period == "daily", days >= 1).otherwise((F.unix_timestamp(now) - F.unix_timestamp(last)) >= 7 * 86400)


@operator("flt_17", """SELECT subscription_id, CASE WHEN last_sent_at IS NULL THEN true WHEN period = 'daily' THEN CAST(last_sent_at AS DATE) < CAST(:now AS DATE)
    ELSE sec(:now) - sec(last_sent_at) >= 604800 END AS due FROM subscriptions WHERE enabled""")
def subscriptions_due(t: Tables) -> DataFrame:
    return t.subscriptions.where("enabled").select("subscription_id", due(F.col("period"), F.col("last_sent_at"), t.now).alias("due"))


@operator("flt_18", "SELECT alert_id, is_read OR created_at <= TIMESTAMP '2024-01-20' AS is_read FROM alerts WHERE user_id = 2")
def read_all_before(t: Tables, user: int = 2, before: str = "2024-01-20") -> DataFrame:
    """A user's alerts after marking as read all created up to a time."""
    return t.alerts.where(F.col("user_id") == user).select("alert_id", (F.col("is_read") | (F.col("created_at") <= F.lit(before).cast("timestamp"))).alias("is_read"))


@operator("prj_01", "SELECT article_id, " + ", ".join(f"length(substring(content, 1, {n})) AS n{n}, md5(substring(content, 1, {n})) AS h{n}" for n in (150, 500, 3000)) + " FROM texts")
def excerpts(t: Tables, sizes: tuple[int, ...] = (150, 500, 3000)) -> DataFrame:
    cut = lambda n: F.substring("content", 1, n)
    return t.texts.select("article_id", *[c for n in sizes for c in (F.length(cut(n)).alias(f"n{n}"), F.md5(cut(n)).alias(f"h{n}"))])


@operator("prj_02", "SELECT article_id, md5(concat(title, chr(10), coalesce(nullif(CASE WHEN article_id % 3 = 0 THEN substring(content, 1, 500) ELSE '' END, ''), substring(content, 1, 1000)))) AS h FROM texts")
def model_text(t: Tables) -> DataFrame:
    """Title and, on the next line, the summary or else the first 1000 characters."""
    summary = F.when(F.col("article_id") % 3 == 0, F.substring("content", 1, 500)).otherwise("")
    body = F.coalesce(F.nullif(summary, F.lit("")), F.substring("content", 1, 1000))
    return t.texts.select("article_id", F.md5(F.concat(F.col("title"), F.lit("\n"), body)).alias("h"))


def display_name(translated: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(translated, F.lit("")), name)


@operator("prj_03", "SELECT entity_id, coalesce(nullif(name_zh, ''), name) AS display FROM entities")
def display_names(t: Tables) -> DataFrame:
    return t.entities.select("entity_id", display_name(F.col("name_zh"), F.col("name")).alias("display"))


def masked(text: Column) -> Column:
    """Values of keys that look secret, and credentials in addresses, replaced by stars."""
    text = F.regexp_replace(text, r"(?i)((?:password|secret|token|api_?key)\s*[=:]\s*)\S+", "$1***")
    return F.regexp_replace(text, r"://[^/@\s:]+:[^/@\s]+@", "://***:***@")


@operator("prj_04", r"""SELECT article_id, md5(regexp_replace(regexp_replace(concat(title, ' token = abc', article_id, ' http://u:p@h/x'), '(?i)((?:password|secret|token|api_?key)\s*[=:]\s*)\S+', '\1***', 'g'), '://[^/@\s:]+:[^/@\s]+@', '://***:***@', 'g')) AS h FROM texts""")
def masked_lines(t: Tables) -> DataFrame:
    line = F.concat(F.col("title"), F.lit(" token = abc"), F.col("article_id").cast("string"), F.lit(" http://u:p@h/x"))
    return t.texts.select("article_id", F.md5(masked(line)).alias("h"))
