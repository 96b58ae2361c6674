"""Ranking, first-per-group, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.joins import first_per
from tidewatch.tables import Tables


def top_per(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key in a total order, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


@operator("win_01", "SELECT country_code, topic_id, CAST(row_number() OVER (PARTITION BY country_code ORDER BY score DESC, article_count DESC, topic_id) AS INT) AS rank FROM snapshots WHERE window_start = TIMESTAMP '2024-01-28'")
def country_ranks(t: Tables, most: int | None = None) -> DataFrame:
    day = t.snapshots.drop("rank").where(F.col("window_start") == F.lit("2024-01-28").cast("timestamp"))
    return top_per(day, ["country_code"], most or 1 << 30, F.desc("score"), F.desc("article_count"), "topic_id").select("country_code", "topic_id", "rank")


@operator("win_02", """SELECT topic_id, country_code, sec(window_start) AS at_sec, score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, country_code ORDER BY window_start DESC) AS n FROM snapshots WHERE window_start >= :now - INTERVAL '48' HOUR) x WHERE n = 1""")
def latest_snapshots(t: Tables) -> DataFrame:
    fresh = t.snapshots.where(F.col("window_start") >= t.now - F.expr("INTERVAL '48' HOUR"))
    return first_per(fresh, ["topic_id", "country_code"], F.desc("window_start")).select("topic_id", "country_code", F.unix_timestamp("window_start").alias("at_sec"), "score")


@operator("win_03", "SELECT kind, event_id FROM (SELECT split_part(topic_id, '-', 1) AS kind, event_id, row_number() OVER (PARTITION BY split_part(topic_id, '-', 1) ORDER BY origin_at DESC, event_id) AS n FROM agenda_events) x WHERE n = 1")
def latest_events(t: Tables) -> DataFrame:
    e = t.agenda_events.withColumn("kind", F.split_part("topic_id", F.lit("-"), F.lit(1)))
    return first_per(e, ["kind"], F.desc("origin_at"), "event_id").select("kind", "event_id")


@operator("win_04", "SELECT topic_id, country_code FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, country_code) AS n FROM (SELECT topic_id, country_code, round(sum(score), 3) AS score FROM snapshots GROUP BY ALL)) x WHERE n = 1")
def best_country(t: Tables) -> DataFrame:
    sums = t.snapshots.groupBy("topic_id", "country_code").agg(F.round(F.sum("score"), 3).alias("score"))
    return first_per(sums, ["topic_id"], F.desc("score"), "country_code").select("topic_id", "country_code")


@operator("win_05", "SELECT country_code, topic_id, rank FROM snapshots WHERE window_start = TIMESTAMP '2024-01-30' AND rank <= 5")
def country_top(t: Tables, k: int = 5) -> DataFrame:
    day = t.snapshots.drop("rank").where(F.col("window_start") == F.lit("2024-01-30").cast("timestamp"))
    return top_per(day, ["country_code"], k, F.desc("score"), F.desc("article_count"), "topic_id").select("country_code", "topic_id", "rank")


@operator("win_06", "SELECT topic_id, country_code, article_id FROM firsts")
def first_articles(t: Tables) -> DataFrame:
    return first_per(t.articles.where(~F.col("is_duplicate")), ["topic_id", "country_code"], "published_at", "article_id").select("topic_id", "country_code", "article_id")


@operator("win_07", "SELECT sec(w) AS latest, sec(p) AS previous FROM (SELECT window_start AS w, lag(window_start) OVER (ORDER BY window_start) AS p FROM (SELECT DISTINCT window_start FROM snapshots)) x ORDER BY w DESC LIMIT 1")
def latest_windows(t: Tables) -> DataFrame:
    """The latest window and the one before it: a top-2 over distinct windows, without a global sort."""
    two = t.snapshots.select("window_start").distinct().orderBy(F.desc("window_start")).limit(2).agg(F.max("window_start").alias("a"), F.min("window_start").alias("b"), F.count("*").alias("n"))
    return two.select(F.unix_timestamp("a").alias("latest"), F.when(F.col("n") > 1, F.unix_timestamp("b")).alias("previous"))


@operator("win_08", "SELECT country_code, topic_id, rank FROM (SELECT country_code, topic_id, rank, row_number() OVER (PARTITION BY country_code, topic_id ORDER BY rank, window_start) AS n FROM snapshots) x WHERE n = 1 ORDER BY rank, country_code, topic_id LIMIT 10")
def digest_dedupe(t: Tables, k: int = 10) -> DataFrame:
    return first_per(t.snapshots, ["country_code", "topic_id"], "rank", "window_start").orderBy("rank", "country_code", "topic_id").limit(k).select("country_code", "topic_id", "rank")


@operator("win_09", "SELECT topic_id, string_agg(title, '|' ORDER BY n) AS titles FROM (SELECT topic_id, title, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, published_at, article_id) AS n FROM articles) x WHERE n <= 3 GROUP BY topic_id")
def representative_titles(t: Tables, n: int = 3) -> DataFrame:
    best = top_per(t.articles, ["topic_id"], n, F.desc("weight"), "published_at", "article_id")
    return best.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "|").alias("titles"))


@operator("win_10", "SELECT topic_id, article_id, n AS rank FROM (SELECT topic_id, article_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY published_at, article_id) AS INT) AS n FROM articles) x WHERE n <= 5")
def background_titles(t: Tables, n: int = 5) -> DataFrame:
    return top_per(t.articles, ["topic_id"], n, "published_at", "article_id").select("topic_id", "article_id", "rank")


@operator("win_11", "SELECT topic_id, label FROM (SELECT topic_id, label, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC, judgement_id) AS n FROM judgements WHERE ok) x WHERE n = 1")
def latest_labels(t: Tables) -> DataFrame:
    return first_per(t.judgements.where("ok"), ["topic_id"], F.desc("created_at"), "judgement_id").select("topic_id", "label")


@operator("win_12", """SELECT f.event_id, f.country_code, CAST(row_number() OVER (PARTITION BY f.event_id ORDER BY f.published_at, f.country_code) AS INT) AS sequence_no, sec(f.published_at) - sec(e.origin_at) AS lag_sec FROM followers f JOIN agenda_events e ON f.event_id = e.event_id""")
def follower_ordinals(t: Tables) -> DataFrame:
    both = t.followers.join(t.agenda_events.select("event_id", "origin_at"), "event_id")
    number = F.row_number().over(W.partitionBy("event_id").orderBy("published_at", "country_code"))
    return both.select("event_id", "country_code", number.alias("sequence_no"), (F.unix_timestamp("published_at") - F.unix_timestamp("origin_at")).alias("lag_sec"))


@operator("win_13", "SELECT topic_id, keyword, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY position) AS INT) AS rank FROM topic_keywords")
def keyword_ranks(t: Tables) -> DataFrame:
    return top_per(t.topic_keywords, ["topic_id"], 1 << 30, "position").select("topic_id", "keyword", "rank")


@operator("win_14", "SELECT topic_id, size FROM topics ORDER BY size DESC, topic_id LIMIT 50")
def largest_topics(t: Tables, k: int = 50) -> DataFrame:
    return t.topics.orderBy(F.desc("size"), "topic_id").limit(k).select("topic_id", "size")


@operator("win_15", "SELECT topic_id, sec(arg_max(window_start, (n, -epoch(window_start)))) AS peak FROM (SELECT topic_id, window_start, sum(article_count) AS n FROM snapshots GROUP BY ALL) x GROUP BY topic_id")
def peaks(t: Tables) -> DataFrame:
    """When each topic had most articles; of equal days the first."""
    days = t.snapshots.groupBy("topic_id", "window_start").agg(F.sum("article_count").alias("n"))
    return days.groupBy("topic_id").agg(F.unix_timestamp(F.max_by("window_start", F.struct("n", -F.unix_timestamp("window_start")))).alias("peak"))


@operator("win_16", """SELECT topic_id, sec(date_trunc(CASE WHEN sec(last_seen) - sec(first_seen) > 20 * 86400 THEN 'week' ELSE 'day' END, last_seen)) AS bucket, CASE WHEN sec(last_seen) - sec(first_seen) > 20 * 86400 THEN 'week' ELSE 'day' END AS grain FROM topics""")
def chosen_grain(t: Tables, days: int = 20) -> DataFrame:
    """Weeks instead of days where a span passes days."""
    grain = F.when(F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen") > days * 86400, "week").otherwise("day")
    bucket = F.when(grain == "week", F.date_trunc("week", "last_seen")).otherwise(F.date_trunc("day", "last_seen"))
    return t.topics.select("topic_id", F.unix_timestamp(bucket).alias("bucket"), grain.alias("grain"))


@operator("set_01", "SELECT kind, string_agg(country_code, ',' ORDER BY country_code) AS scope FROM (SELECT DISTINCT kind, country_code FROM articles) x GROUP BY kind")
def country_union(t: Tables) -> DataFrame:
    return t.articles.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("country_code")), ",").alias("scope"))


def _keyword_sets(t: Tables) -> DataFrame:
    words = t.topic_keywords.groupBy("topic_id").agg(F.collect_set("keyword").alias("words"))
    near = t.topics.where("merged_into IS NOT NULL").select("topic_id", "merged_into")
    other = words.select(F.col("topic_id").alias("merged_into"), F.col("words").alias("others"))
    return near.join(words, "topic_id").join(other, "merged_into")


_PAIRS = "SELECT t.topic_id, k.keyword, EXISTS (SELECT 1 FROM topic_keywords o WHERE o.topic_id = t.merged_into AND o.keyword = k.keyword) AS hit FROM topics t JOIN (SELECT DISTINCT topic_id, keyword FROM topic_keywords) k ON t.topic_id = k.topic_id WHERE t.merged_into IN (SELECT topic_id FROM topics)"


@operator("set_02", f"SELECT topic_id, coalesce(string_agg(keyword, ',' ORDER BY keyword) FILTER (hit), '') AS shared FROM ({_PAIRS}) x GROUP BY topic_id")
def keyword_intersection(t: Tables) -> DataFrame:
    return _keyword_sets(t).select("topic_id", F.array_join(F.array_sort(F.array_intersect("words", "others")), ",").alias("shared"))


@operator("set_03", f"SELECT topic_id, coalesce(string_agg(keyword, ',' ORDER BY keyword) FILTER (NOT hit), '') AS own FROM ({_PAIRS}) x GROUP BY topic_id")
def keyword_difference(t: Tables) -> DataFrame:
    return _keyword_sets(t).select("topic_id", F.array_join(F.array_sort(F.array_except("words", "others")), ",").alias("own"))


@operator("set_04", "SELECT country_code FROM entities UNION SELECT country_code FROM articles UNION SELECT concat('C', n_nationkey) FROM nation")
def country_universe(t: Tables) -> DataFrame:
    dimension = t.nation.select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"))
    return t.entities.select("country_code").union(t.articles.select("country_code")).union(dimension).distinct()


@operator("set_05", f"SELECT topic_id, bool_and(hit) AS inside FROM ({_PAIRS}) x GROUP BY topic_id")
def keyword_subset(t: Tables) -> DataFrame:
    return _keyword_sets(t).select("topic_id", (F.size(F.array_except("words", "others")) == 0).alias("inside"))


@operator("set_06", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def distinct_urls(t: Tables) -> DataFrame:
    return t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()
