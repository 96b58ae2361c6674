"""Sources and sinks: feeds, buffers, ingest, upserts, search index, versioned publishing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.joins import first_per, page
from tidewatch.tables import Tables


def body_of(full: Column, fetched: Column, title: Column, summary: Column) -> Column:
    """Text of a feed entry: the feed's full text, else the fetched page, else title and summary."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(full), filled(fetched), F.concat_ws("\n", title, summary))


@operator("src_01", """SELECT source_id, sum(n) AS entries, min(delay) AS shortest, max(delay) AS longest, round(avg(delay), 2) AS mean_delay, md5(string_agg(md5(body), '' ORDER BY article_id)) AS h FROM (SELECT source_id, article_id, 1 AS n, (sec(:now) - sec(published_at)) / 60.0e0 AS delay, CASE WHEN article_id % 3 = 0 THEN trim(content) WHEN article_id % 3 = 1 THEN 'page' ELSE concat_ws(chr(10), title, substring(content, 1, 50)) END AS body
    FROM texts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id) <= 50) x GROUP BY source_id""")
def feed_poll(t: Tables, most: int = 50) -> DataFrame:
    """The latest entries of each feed with the best body there is, and how late they come."""
    entries = first_rows(t.texts, ["source_id"], most, F.desc("published_at"), "article_id")
    third = F.col("article_id") % 3
    body = body_of(F.when(third == 0, F.col("content")), F.when(third == 1, F.lit("page")), F.col("title"), F.substring("content", 1, 50))
    delay = (F.unix_timestamp(t.now) - F.unix_timestamp("published_at")) / 60.0
    rows = entries.select("source_id", "article_id", delay.alias("delay"), F.md5(body).alias("h"))
    return rows.groupBy("source_id").agg(F.count("*").alias("entries"), F.min("delay").alias("shortest"), F.max("delay").alias("longest"), F.round(F.avg("delay"), 2).alias("mean_delay"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "h"))), lambda x: x["h"]), "")).alias("h"))


def first_rows(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    from tidewatch.operators.windows import top_per

    return top_per(df, keys, k, *order).drop("rank")


@operator("src_02", "SELECT source_id, CASE WHEN collect_mode = 'rsshub' THEN concat('http://hub.local/route/', source_id) ELSE feed_url END AS url FROM sources")
def feed_urls(t: Tables, hub: str = "http://hub.local/route/") -> DataFrame:
    return t.sources.select("source_id", F.when(F.col("collect_mode") == "rsshub", F.concat(F.lit(hub), F.col("source_id").cast("string"))).otherwise(F.col("feed_url")).alias("url"))


def host_suffixes(host: Column) -> Column:
    """A host and its parent domains, so that a suffix match is an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@operator("src_08", r"SELECT p.page_id, d.domain FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages) p JOIN (VALUES ('example.com'), ('example.net'), ('m.ththth.example.net')) AS d(domain) ON p.host = d.domain OR p.host LIKE '%.' || d.domain QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(d.domain) DESC) = 1")
def domain_sources(t: Tables, domains: tuple[str, ...] = ("example.com", "example.net", "m.ththth.example.net")) -> DataFrame:
    """The source whose domain is the longest suffix of a page's host: exploded suffixes, no theta join."""
    known = t.spark.createDataFrame([(d,) for d in domains], "domain string")
    hosts = t.pages.select("page_id", F.explode(host_suffixes(F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)))).alias("domain"))
    return first_per(hosts.join(F.broadcast(known), "domain"), ["page_id"], F.desc(F.length("domain"))).select("page_id", "domain")


@operator("src_09", "SELECT kind, count(*) AS rows, CAST(96 AS INT) AS files FROM articles WHERE published_at >= :now - INTERVAL '1' DAY AND article_id % 2 = 1 GROUP BY kind")
def buffer_files(t: Tables) -> DataFrame:
    """A rolling buffer of delimited files: the last 96 pulls stay, and the latest whole one is read."""
    from tidewatch.sources.files import Buffer

    fresh = t.articles.where(F.col("published_at") >= t.now - F.expr("INTERVAL '1' DAY")).select("kind", "article_id", "country_code")
    buffer = Buffer(t.spark, "kind string, article_id long, country_code string", keep=96)
    for i in range(96):
        buffer.touch(f"20240101T{i:06d}Z")
    buffer.add(fresh.where("article_id % 2 = 0"), "20240130T000000Z")
    buffer.add(fresh.where("article_id % 2 = 1"), "20240131T000000Z")
    buffer.touch("20240131T010000Z", whole=False)  # a pull that failed
    return buffer.latest().groupBy("kind").agg(F.count("*").alias("rows")).withColumn("files", F.lit(len(buffer.names())))


@operator("src_10", "SELECT article_id, CASE WHEN article_id % 9 = 0 THEN NULL ELSE sec(date_trunc('second', published_at)) END AS at_sec FROM articles")
def compact_times(t: Tables) -> DataFrame:
    """yyyyMMddTHHmmssZ; what does not parse is null."""
    text = F.when(F.col("article_id") % 9 == 0, "not a time").otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"))
    return t.articles.select("article_id", F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))).alias("at_sec"))


def ingested(raw: DataFrame, sources: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """New articles of known sources: one of each url hash, none that is stored already."""
    rows = raw.join(sources.select("source_id"), "source_id", "left_semi").join(known.select("url_hash"), "url_hash", "left_anti")
    rows = first_per(rows, ["url_hash"], "article_id")
    return rows.withColumns({"published_at": F.coalesce("published_at", now), "time_source": F.when(F.col("published_at").isNull(), "crawled").otherwise("feed"), "summary": F.substring("content", 1, 500)})


@operator("src_11", """SELECT article_id, time_source, length(summary) AS n FROM (SELECT article_id, CASE WHEN article_id % 7 = 0 THEN 'crawled' ELSE 'feed' END AS time_source, substring(content, 1, 500) AS summary, row_number() OVER (PARTITION BY sha256(title) ORDER BY article_id) AS r FROM texts WHERE source_id <> 'src3'
    AND sha256(title) NOT IN (SELECT sha256(title) FROM texts WHERE article_id % 100 = 5)) x WHERE r = 1""")
def ingest(t: Tables) -> DataFrame:
    raw = t.texts.withColumn("url_hash", F.sha2("title", 256)).withColumn("published_at", F.when(F.col("article_id") % 7 != 0, F.col("published_at")))
    out = ingested(raw, t.texts.where("source_id <> 'src3'").select("source_id").distinct(), raw.where("article_id % 100 = 5"), t.now)
    return out.select("article_id", "time_source", F.char_length("summary").alias("n"))


@operator("src_13", r"""SELECT word, count(*) AS texts FROM (SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS word FROM texts UNION SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) FROM texts) x GROUP BY word""")
def search_index(t: Tables) -> DataFrame:
    """The index written in two batches, the first of them twice, then read: postings of each word."""
    from tidewatch.sources.files import new_folder, read_index, write_index

    base, late = new_folder(t.spark, "index"), F.col("article_id") % 10 == 0
    write_index(t.texts, base, 0)
    write_index(t.texts, base, 0)
    write_index(t.texts.where(late), base, 1)
    return read_index(t.spark, base).groupBy("word").agg(F.sum(F.size("ids")).alias("texts"))


@operator("src_14", r"""SELECT article_id, round(sum(best + 0.3e0 * (total - best)), 4) AS score FROM (SELECT word, article_id, max(weight) AS best, sum(weight) AS total FROM (SELECT DISTINCT article_id, 2.0e0 AS weight, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS word FROM texts
    UNION ALL SELECT DISTINCT article_id, 1.0e0, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) FROM texts) x WHERE word IN ('token', 'license', 'the') GROUP BY word, article_id) y GROUP BY article_id ORDER BY score DESC, article_id LIMIT 20""")
def search(t: Tables, words: tuple[str, ...] = ("token", "license", "the"), k: int = 20) -> DataFrame:
    """Best texts for some words: a word's best field and 0.3 of its others, from the index in blocks."""
    from tidewatch.sources.blocks import best_texts, write_texts
    from tidewatch.sources.files import new_folder

    base = new_folder(t.spark, "blocks")
    write_texts(t.texts, base)
    return best_texts(t.spark, base, list(words), k)


@operator("src_15", "SELECT article_id, length(substring(content, 1, 150)) AS n FROM texts WHERE (title ILIKE '%license%' OR content ILIKE '%license%') AND language = 'en' ORDER BY published_at DESC, article_id LIMIT 10 OFFSET 2")
def fallback_search(t: Tables, part: str = "license", size: int = 10, skip: int = 2) -> DataFrame:
    hit = F.col("title").ilike(f"%{part}%") | F.col("content").ilike(f"%{part}%")
    return t.texts.where(hit & (F.col("language") == "en")).orderBy(F.desc("published_at"), "article_id").offset(skip).limit(size).select("article_id", F.char_length(F.substring("content", 1, 150)).alias("n"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys: one of each key."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return first_per(rows, keys, F.desc("_v")).drop("_v")


@operator("src_16", "SELECT s.country_code, s.topic_id, g.granularity, sec(s.window_start) AS at_sec, CASE WHEN g.granularity = 'day' AND s.window_start = TIMESTAMP '2024-01-30' THEN s.article_count + 1 ELSE s.article_count END AS article_count FROM snapshots s CROSS JOIN (VALUES ('day'), ('hour')) AS g(granularity)")
def snapshot_upsert(t: Tables) -> DataFrame:
    keys = ["country_code", "topic_id", "window_start", "granularity"]
    grains = t.snapshots.withColumn("granularity", F.explode(F.array(F.lit("day"), F.lit("hour"))))
    own = grains.select(*keys, "article_count")
    new = own.where((F.col("window_start") == F.lit("2024-01-30").cast("timestamp")) & (F.col("granularity") == "day")).withColumn("article_count", F.col("article_count") + 1)
    return upserted(own, new, keys).select("country_code", "topic_id", "granularity", F.unix_timestamp("window_start").alias("at_sec"), "article_count")


@operator("src_17", "SELECT article_id, latency_ms FROM latency WHERE article_id NOT IN (SELECT article_id FROM texts)")
def latency_insert(t: Tables) -> DataFrame:
    """Samples of articles that have none yet."""
    return t.latency.join(t.texts.select("article_id"), "article_id", "left_anti").select("article_id", "latency_ms")


@operator("src_18")
def published(t: Tables) -> DataFrame:
    """The clusters as a reader sees them: the version that the pointer names, whole."""
    from tidewatch.sources.files import publish, read_published

    base = publish(t.topics.select("topic_id", "size"), "clusters")
    return read_published(t.spark, base, "topic_id string, size long")


@operator("src_19", "SELECT CASE WHEN topic_id IS NULL OR article_id % 50 = 0 THEN 'dead' ELSE 'ok' END AS route, count(*) AS n FROM articles GROUP BY 1")
def routed(t: Tables) -> DataFrame:
    """Messages split into good ones and dead letters (payloads that do not parse)."""
    payload = F.when(F.col("article_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct("article_id", "topic_id")))
    parsed = F.from_json(payload, "article_id long, topic_id string")
    return t.articles.select(F.when(parsed["topic_id"].isNull(), "dead").otherwise("ok").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@operator("src_22", "SELECT audit_id, actor FROM audit WHERE \"at\" >= TIMESTAMP '2024-01-05' AND \"at\" < TIMESTAMP '2024-01-12' AND action = 'purchase' AND result = 'denied' ORDER BY \"at\" DESC, audit_id LIMIT 10000")
def audit_query(t: Tables, most: int = 10_000) -> DataFrame:
    span = (F.col("at") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("at") < F.lit("2024-01-12").cast("timestamp"))
    return t.audit.where(span & (F.col("action") == "purchase") & (F.col("result") == "denied")).orderBy(F.desc("at"), "audit_id").limit(most).select("audit_id", "actor")


@operator("src_23", "SELECT article_id, CAST(count(*) OVER () AS BIGINT) AS total FROM articles WHERE country_code = 'C3' ORDER BY published_at DESC, article_id LIMIT 20 OFFSET 40")
def paged(t: Tables, number: int = 3, size: int = 20) -> DataFrame:
    rows = t.articles.where("country_code = 'C3'").select("article_id", "published_at")
    return page(rows, F.desc("published_at"), "article_id", number=number, size=size).drop("published_at")


CASE = """case_id string, label string, ground_truth struct<origin_country: string, origin_source_name: string, origin_at: timestamp, follower_sequence: array<struct<country_code: string, first_media: string, lag_hours: double>>, should_be_agenda_event: boolean>,
    articles array<struct<article_id: string, title: string, content: string, url: string, country_code: string, source_name: string, language: string, published_at: timestamp, source_media_type: string, time_source: string>>"""


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Replay cases with the faults of each: missing keys, repeated article ids, unknown media types."""
    cases = spark.read.schema(CASE).json(path, multiLine=True)
    ids = F.transform("articles", lambda a: a["article_id"])
    lacking = F.exists("articles", lambda a: a["article_id"].isNull() | a["title"].isNull() | a["url"].isNull() | a["published_at"].isNull() | a["source_name"].isNull())
    known = ("newspaper", "agency", "broadcast", "online")
    faults = F.array(
        F.when(F.col("case_id").isNull() | F.col("articles").isNull() | F.col("ground_truth").isNull(), "missing"), F.when(F.col("ground_truth.origin_country").isNull(), "origin"), F.when(lacking, "article"),
        F.when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated"), F.when(F.exists("articles", lambda a: ~F.coalesce(a["source_media_type"], F.lit("online")).isin(*known)), "media type"),
    )
    return cases.withColumn("faults", F.array_compact(faults))


@operator("src_20")
def replay_cases(t: Tables) -> DataFrame:
    """Cases made from a few events, written as JSON, read back and checked."""
    from tidewatch.sources.files import new_folder

    article = {"title": "t", "content": "c", "url": "u", "country_code": "C1", "source_name": "s", "language": "en", "published_at": "2024-01-01T00:00:00Z"}
    truth = {"origin_country": "C1", "origin_source_name": "s", "origin_at": "2024-01-01T00:00:00Z", "follower_sequence": [], "should_be_agenda_event": True}
    cases = [{"case_id": f"k{i}", "label": "positive", "ground_truth": truth, "articles": [article | {"article_id": f"a{j % (3 - (i == 2))}"} for j in range(3)]} for i in range(3)]
    folder = new_folder(t.spark, "cases")
    lines = t.spark.createDataFrame([(json.dumps(c),) for c in cases], "value string")
    lines.write.text(folder)
    return load_cases(t.spark, folder).select("case_id", F.size("articles").alias("articles"), F.array_join("faults", ",").alias("faults"))


