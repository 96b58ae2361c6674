"""Aggregations and time-bucketed roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.filters import active, hours_before
from tidewatch.operators.windows import top_per
from tidewatch.storage import checkpointed
from tidewatch.tables import Tables


def global_ranks(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """df with place, from 0 within keys in a total order, ranked in ranges of bounded size.

    Rows go to ranges of (keys, order); a row's place is its place in its range and the rows of its
    keys in earlier ranges, so only one row for each range and key is ever ordered in one task.
    """
    by = [*keys, *order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    parts = checkpointed(parts)
    heads = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = heads.select(*keys, "_part", (before - F.col("_first")).alias("_start"))
    return parts.join(starts, [*keys, "_part"]).withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], digits: int = 3) -> DataFrame:
    """Percentiles of value by keys, interpolated between neighbours, named as in shares; nulls are left out.

    Equal values are counted first; a running count over ranges of bounded size says which values stand at the two places next to
    a share, so no task holds all values of a key. A key without any value gives nulls.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = checkpointed(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    own = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    heads = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    whole = W.partitionBy(*keys)
    before = heads.select(*keys, "_part", F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("_all"))
    ranked = parts.join(before, [*keys, "_part"]).withColumn("_from", F.col("_start") + F.coalesce(F.sum("_n").over(own), F.lit(0)))

    def at(share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(share)
        low, part = F.floor(place), place - F.floor(place)
        holds = lambda k: (F.col("_from") <= k) & (k < F.col("_from") + F.col("_n"))
        weight = F.when(holds(low), 1 - part).otherwise(0.0) + F.when((part > 0) & holds(low + 1), part).otherwise(0.0)
        return F.round(F.sum(F.col(value) * weight), digits)

    found = ranked.groupBy(*keys).agg(*[at(q).alias(name) for name, q in shares.items()])
    return df.select(*keys).distinct().join(found, keys, "left")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole), digits)


@operator("agg_01", "SELECT topic_id, count(*) AS size FROM articles GROUP BY topic_id")
def topic_sizes(t: Tables) -> DataFrame:
    return t.articles.groupBy("topic_id").agg(F.count("*").alias("size"))


@operator("agg_02", "SELECT topic_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS media FROM articles WHERE published_at >= :now - INTERVAL '24' HOUR GROUP BY topic_id")
def topic_activity(t: Tables, hours: int = 24) -> DataFrame:
    fresh = t.articles.where(F.col("published_at") >= hours_before(t.now, hours))
    return fresh.groupBy("topic_id").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("source_id").alias("media"))


@operator("agg_03", "SELECT country_code, count(*) AS n FROM articles WHERE published_at >= :now - INTERVAL '7' DAY GROUP BY country_code ORDER BY n DESC, country_code LIMIT 120")
def country_counts(t: Tables, days: int = 7) -> DataFrame:
    fresh = t.articles.where(F.col("published_at") >= hours_before(t.now, 24 * days))
    return fresh.groupBy("country_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code").limit(CONFIG.snapshot_countries)


def salience(n: Column, lifetime: Column, lag_hours: Column, sources: Column) -> Column:
    """Articles, damped growth of the lifetime total, freshness and the share of different sources."""
    return n * (1 + F.log(1 + lifetime)) / (1 + F.greatest(lag_hours, F.lit(0.0))) * (sources / n)


@operator("agg_04", """SELECT country_code, topic_id, n, sources, lag_hours, score, CAST(row_number() OVER (PARTITION BY country_code ORDER BY score DESC, n DESC, topic_id) AS INT) AS rank FROM (
    SELECT w.country_code, w.topic_id, w.n, w.sources, round((sec(:now) - w.last_sec) / 3600.0e0, 4) AS lag_hours, l.size AS lifetime,
    round(w.n * (1 + ln(1 + l.size)) / (1 + greatest((sec(:now) - w.last_sec) / 3600.0e0, 0.0e0)) * (CAST(w.sources AS DOUBLE) / w.n), 4) AS score
    FROM (SELECT country_code, topic_id, count(*) AS n, count(DISTINCT source_id) AS sources, max(sec(published_at)) AS last_sec FROM articles WHERE published_at >= :now - INTERVAL '24' HOUR AND published_at <= :now GROUP BY ALL) w
    JOIN topics l ON w.topic_id = l.topic_id WHERE l.merged_into IS NULL AND l.lifecycle <> 'archived') x""")
def salience_snapshot(t: Tables, hours: int = CONFIG.snapshot_hours) -> DataFrame:
    """Score and rank of every active topic in every country over the trailing window."""
    fresh = t.articles.where(F.col("published_at").between(hours_before(t.now, hours), t.now))
    window = fresh.groupBy("country_code", "topic_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.max(F.unix_timestamp("published_at")).alias("last"))
    life = t.articles.groupBy("topic_id").agg(F.count("*").alias("lifetime"))
    both = window.join(active(t.topics).select("topic_id"), "topic_id").join(life, "topic_id")
    lag = (F.unix_timestamp(t.now) - F.col("last")) / 3600.0
    scored = both.withColumn("lag_hours", F.round(lag, 4)).withColumn("score", F.round(salience(F.col("n"), F.col("lifetime"), lag, F.col("sources")), 4))
    rank = F.row_number().over(W.partitionBy("country_code").orderBy(F.desc("score"), F.desc("n"), "topic_id"))
    return scored.select("country_code", "topic_id", "n", "sources", "lag_hours", "score", rank.alias("rank"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


#: Words whose frequencies are sent to all tasks.
HOT_WORDS = 2000
_WORDS = "SELECT article_id, language, unnest(regexp_extract_all(lower(content), '[a-z]{2,}')) AS w FROM texts"


@operator("agg_05", f"SELECT language, w, df, CAST(row_number() OVER (PARTITION BY language ORDER BY df DESC, w) AS INT) AS rank FROM (SELECT language, w, count(DISTINCT article_id) AS df FROM ({_WORDS}) x GROUP BY ALL) y QUALIFY rank <= 20")
def document_frequency(t: Tables, k: int = CONFIG.keywords) -> DataFrame:
    """Most frequent words of a class by the number of texts that hold them; ties by word."""
    w = t.texts.select("language", F.explode(F.array_distinct(words(F.col("content")))).alias("w"))
    return top_per(w.groupBy("language", "w").agg(F.count("*").alias("df")), ["language"], k, F.desc("df"), "w")


@operator("agg_06", f"""WITH tok AS ({_WORDS}), tf AS (SELECT language, w, count(*) AS f FROM tok GROUP BY ALL), len AS (SELECT language, sum(f) AS n FROM tf GROUP BY ALL), cf AS (SELECT w, sum(f) AS f FROM tf GROUP BY ALL),
    s AS (SELECT tf.language, tf.w, round(CAST(tf.f AS DOUBLE) / len.n * ln((SELECT avg(n) FROM len) / cf.f + 1), 8) AS score FROM tf JOIN len ON tf.language = len.language JOIN cf ON tf.w = cf.w)
    SELECT language, w, score, CAST(row_number() OVER (PARTITION BY language ORDER BY score DESC, w) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def class_tfidf(t: Tables, k: int = 10) -> DataFrame:
    """Words that set a class apart: share in the class times ln(mean class length / total count + 1)."""
    tf = checkpointed(t.texts.select("language", F.explode(words(F.col("content"))).alias("w")).groupBy("language", "w").agg(F.count("*").alias("f")))
    length = tf.groupBy("language").agg(F.sum("f").alias("n"))
    total = tf.groupBy("w").agg(F.sum("f").alias("cf"))
    both = tf.join(total, "w").join(length, "language").join(F.broadcast(length.agg(F.avg("n").alias("mean"))))
    scored = both.withColumn("score", F.round(F.col("f") / F.col("n") * F.log(F.col("mean") / F.col("cf") + 1), 8)).where("score > 0")
    return top_per(scored.select("language", "w", "score"), ["language"], k, F.desc("score"), "w")


@operator("agg_07", f"""WITH tok AS ({_WORDS}), f AS (SELECT article_id, w, count(*) AS f FROM tok GROUP BY ALL), df AS (SELECT w, count(DISTINCT article_id) AS df FROM f GROUP BY ALL),
    s AS (SELECT f.article_id, f.w, round(f.f * (ln(((SELECT count(*) FROM texts) + 1.0e0) / (df.df + 1)) + 1) * least(length(f.w), 4), 6) AS score FROM f JOIN df ON f.w = df.w)
    SELECT article_id, w, score FROM s QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, w) <= 5""")
def label_keywords(t: Tables, k: int = 5, hot: int = HOT_WORDS) -> DataFrame:
    """Fallback label words of a text: count, smoothed inverse frequency and length up to 4.

    Texts travel once, to where their words are counted. The frequencies of the hot most frequent words bound all others', so
    only words that can still be among a text's k best meet the table of frequencies.
    """
    texts = t.texts.select("article_id", "content").repartition("article_id")
    f = texts.select("article_id", F.explode_outer(words(F.col("content"))).alias("w")).where("w IS NOT NULL").groupBy("article_id", "w").agg(F.count("*").alias("f"))
    df = f.groupBy("w").agg(F.count("*").alias("df"))
    top = df.orderBy(F.desc("df"), "w").limit(hot)
    whole = t.texts.agg(F.count("*").alias("all")).join(top.agg(F.min("df").alias("most")))  # one row

    def score(n: Column) -> Column:
        return F.round(F.col("f") * (F.log((F.col("all") + 1.0) / (n + 1)) + 1) * F.least(F.length("w"), F.lit(4)), 6)

    own = W.partitionBy("article_id")
    bounds = f.join(F.broadcast(top), "w", "left").join(F.broadcast(whole)).withColumns({"low": score(F.coalesce("df", "most")), "high": score(F.coalesce("df", F.lit(1)))})
    ranked = bounds.withColumn("place", F.row_number().over(own.orderBy(F.desc("low"), "w"))).withColumn("kth", F.min(F.when(F.col("place") <= k, F.col("low"))).over(own))
    both = ranked.where("high >= kth").select("article_id", "w", "f", "all").join(df, "w")
    return top_per(both.withColumn("score", score(F.col("df"))), ["article_id"], k, F.desc("score"), "w").select("article_id", "w", "score")


@operator("agg_08", "SELECT entity_id, count(DISTINCT article_id) AS df FROM article_entities GROUP BY entity_id ORDER BY df DESC, entity_id LIMIT 50")
def entity_blacklist(t: Tables, k: int = CONFIG.blacklist_size) -> DataFrame:
    return t.article_entities.groupBy("entity_id").agg(F.countDistinct("article_id").alias("df")).orderBy(F.desc("df"), "entity_id").limit(k)


def daily_counts(articles: DataFrame, keys: list[str], start: str, days: int) -> DataFrame:
    """Articles per key and UTC day of a calendar, zero where there are none."""
    day = F.to_date("published_at")
    counts = articles.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"))
    first = F.lit(start).cast("date")
    calendar = articles.select(*keys).distinct().withColumn("day", F.explode(F.sequence(first, F.date_add(first, days - 1))))
    return calendar.join(counts, [*keys, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@operator("agg_09", """SELECT c.country_code, strftime(d.day, '%Y-%m-%d') AS day, count(a.article_id) AS n FROM (SELECT DISTINCT country_code FROM articles WHERE kind = 'error') c CROSS JOIN (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN articles a ON a.country_code = c.country_code AND CAST(a.published_at AS DATE) = d.day AND a.kind = 'error' GROUP BY c.country_code, d.day""")
def daily_matrix(t: Tables, kind: str = "error") -> DataFrame:
    out = daily_counts(t.articles.where(F.col("kind") == kind), ["country_code"], "2024-01-01", CONFIG.stats_days)
    return out.select("country_code", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@operator("agg_10", """SELECT source_id, count(*) AS jobs, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status LIKE '%failure') AS failed, CAST(coalesce(sum(articles_new), 0) AS BIGINT) AS articles_new,
    round(avg(CAST(json_extract(latency_stats, '$.avg_delay_min') AS DOUBLE)), 6) AS delay FROM jobs WHERE scheduled_at >= :now - INTERVAL '24' HOUR GROUP BY source_id""")
def source_health(t: Tables, hours: int = 24) -> DataFrame:
    fresh = t.jobs.where(F.col("scheduled_at") >= hours_before(t.now, hours))
    return fresh.groupBy("source_id").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status").like("%failure")).alias("failed"),
        F.coalesce(F.sum("articles_new"), F.lit(0)).alias("articles_new"), F.round(F.avg(F.get_json_object("latency_stats", "$.avg_delay_min").cast("double")), 6).alias("delay"),
    )


@operator("agg_11", """SELECT country_code, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'paused') AS paused,
    CASE WHEN count(*) FILTER (status = 'active') >= 0.85 * count(*) THEN 'high' WHEN count(*) FILTER (status = 'active') >= 0.7 * count(*) THEN 'medium' ELSE 'low' END AS confidence FROM sources GROUP BY country_code""")
def country_coverage(t: Tables) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("active", "degraded", "failed", "paused")]
    out = t.sources.groupBy("country_code").agg(F.count("*").alias("total"), *counts)
    rate = F.col("active") / F.col("total")
    return out.withColumn("confidence", F.when(rate >= 0.85, "high").when(rate >= 0.7, "medium").otherwise("low"))


@operator("agg_12", "SELECT source_id, round(count(*) FILTER (status LIKE '%failure') * 1.0e0 / nullif(count(*) FILTER (status <> 'pending'), 0), 6) AS fail_rate FROM jobs WHERE scheduled_at >= :now - INTERVAL '24' HOUR GROUP BY source_id")
def failure_rates(t: Tables) -> DataFrame:
    fresh = t.jobs.where(F.col("scheduled_at") >= hours_before(t.now, 24))
    return fresh.groupBy("source_id").agg(share(F.count_if(F.col("status").like("%failure")), F.count_if(F.col("status") != "pending")).alias("fail_rate"))


@operator("agg_13", """SELECT round(count(DISTINCT e.country_code) FILTER (s.country_code IS NOT NULL) * 1.0e0 / count(DISTINCT e.country_code), 6) AS ratio, coalesce(string_agg(DISTINCT e.country_code ORDER BY e.country_code) FILTER (s.country_code IS NULL), '') AS uncovered
    FROM entities e LEFT JOIN (SELECT DISTINCT country_code FROM sources WHERE status = 'active') s ON e.country_code = s.country_code""")
def global_coverage(t: Tables) -> DataFrame:
    covered = t.sources.where("status = 'active'").select("country_code").distinct().withColumn("hit", F.lit(True))
    both = t.entities.select("country_code").distinct().join(covered, "country_code", "left")
    return both.agg(share(F.count("hit"), F.count("*")).alias("ratio"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit").isNull(), F.col("country_code")))), ",").alias("uncovered"))


@operator("agg_14", "SELECT channel, round(quantile_cont(latency_ms, 0.5), 3) AS p50, round(quantile_cont(latency_ms, 0.95), 3) AS p95, round(quantile_cont(latency_ms, 0.99), 3) AS p99, max(latency_ms) AS most, count(*) FILTER (latency_ms > 1800000) AS late FROM latency GROUP BY channel")
def latency_percentiles(t: Tables) -> DataFrame:
    rest = t.latency.groupBy("channel").agg(F.max("latency_ms").alias("most"), F.count_if(F.col("latency_ms") > 1_800_000).alias("late"))
    return exact_percentiles(t.latency, ["channel"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).join(rest, "channel")


@operator("agg_15", "SELECT task, round(quantile_cont(latency_ms, 0.5), 3) AS p50, round(quantile_cont(latency_ms, 0.95), 3) AS p95, count(*) FILTER (NOT ok) AS failed FROM judgements GROUP BY task")
def judgement_percentiles(t: Tables) -> DataFrame:
    failed = t.judgements.groupBy("task").agg(F.count_if(~F.col("ok")).alias("failed"))
    return exact_percentiles(t.judgements, ["task"], "latency_ms", {"p50": 0.5, "p95": 0.95}).join(failed, "task")


BUCKETS = ((60_000, "<=1m"), (300_000, "<=5m"), (900_000, "<=15m"), (1_800_000, "<=30m"), (3_600_000, "<=1h"))


def latency_bucket(ms: Column) -> Column:
    """The first bucket whose upper edge, itself included, is not passed."""
    out = F.when(ms <= BUCKETS[0][0], BUCKETS[0][1])
    for edge, name in BUCKETS[1:]:
        out = out.when(ms <= edge, name)
    return out.otherwise(">1h")


@operator("agg_16", "SELECT channel, CASE " + " ".join(f"WHEN latency_ms <= {e} THEN '{n}'" for e, n in BUCKETS) + " ELSE '>1h' END AS bucket, count(*) AS n FROM latency GROUP BY ALL")
def latency_histogram(t: Tables) -> DataFrame:
    return t.latency.groupBy("channel", latency_bucket(F.col("latency_ms")).alias("bucket")).agg(F.count("*").alias("n"))


STAGES = ("language", "embedding", "cluster", "index", "entity")


@operator("agg_17", "SELECT stage, state, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, \"{s}\" AS state FROM stages" for s in STAGES) + ") x GROUP BY ALL")
def stage_counts(t: Tables) -> DataFrame:
    """One pass for all stages and states."""
    return t.stages.unpivot(["article_id"], list(STAGES), "stage", "state").groupBy("stage", "state").agg(F.count("*").alias("n"))


@operator("agg_18", "SELECT topic_id, sec(date_trunc('week', window_start)) AS week, CAST(sum(article_count) AS BIGINT) AS n, round(sum(score), 3) AS score, sec(arg_max(window_start, (score, -epoch(window_start)))) AS best FROM (SELECT topic_id, window_start, sum(article_count) AS article_count, round(sum(score), 3) AS score FROM snapshots GROUP BY ALL) x GROUP BY topic_id, date_trunc('week', window_start)")
def timeline(t: Tables, grain: str = "week") -> DataFrame:
    """Roll-up of day windows to a grain, with the best day of each; of equal ones the first."""
    days = t.snapshots.groupBy("topic_id", "window_start").agg(F.sum("article_count").alias("article_count"), F.round(F.sum("score"), 3).alias("score"))
    at = F.unix_timestamp("window_start")
    out = days.groupBy("topic_id", F.date_trunc(grain, "window_start").alias("w")).agg(F.sum("article_count").alias("n"), F.round(F.sum("score"), 3).alias("score"), F.max_by(at, F.struct("score", -at)).alias("best"))
    return out.select("topic_id", F.unix_timestamp("w").alias("week"), "n", "score", "best")


_TOPS = "SELECT country_code, window_start, sum(article_count) AS n, arg_max(topic_id, (score, topic_id)) AS top FROM snapshots WHERE country_code IN ('C0', 'C1', 'C2', 'C3') GROUP BY country_code, window_start"


@operator("agg_19", f"SELECT country_code, string_agg(n, ',' ORDER BY window_start) AS curve, CAST(sum(n) AS BIGINT) AS total, arg_max(top, (n, window_start)) AS top FROM ({_TOPS}) x GROUP BY country_code")
def country_compare(t: Tables, countries: tuple[str, ...] = ("C0", "C1", "C2", "C3")) -> DataFrame:
    days = t.snapshots.where(F.col("country_code").isin(*countries[:4])).groupBy("country_code", "window_start").agg(F.sum("article_count").alias("n"), F.max_by("topic_id", F.struct("score", "topic_id")).alias("top"))
    curve = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_start", "n"))), lambda x: x["n"].cast("string")), ",")
    return days.groupBy("country_code").agg(curve.alias("curve"), F.sum("n").alias("total"), F.max_by("top", F.struct("n", "window_start")).alias("top"))


@operator("agg_20", "SELECT country_code, string_agg(concat(strftime(window_start, '%m%d'), ':', topic_id), ',' ORDER BY window_start) AS line FROM snapshots WHERE rank = 1 GROUP BY country_code")
def country_lines(t: Tables) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("window_start", "topic_id")))
    line = F.transform(points, lambda x: F.concat(F.date_format(x["window_start"], "MMdd"), F.lit(":"), x["topic_id"]))
    return t.snapshots.where("rank = 1").groupBy("country_code").agg(F.array_join(line, ",").alias("line"))


@operator("agg_21", """SELECT coalesce(d.country_code, c.country_code) AS country_code, coalesce(c.n, 0) AS n, coalesce(p.topics, '') AS topics, coalesce(v.rate, 0) < 0.7 AS degraded FROM (SELECT DISTINCT concat('C', n_nationkey) AS country_code FROM nation) d
    FULL JOIN (SELECT country_code, count(*) AS n FROM articles WHERE published_at >= TIMESTAMP '2024-01-30' AND published_at <= TIMESTAMP '2024-01-30 23:59:59' GROUP BY ALL) c ON d.country_code = c.country_code
    LEFT JOIN (SELECT country_code, string_agg(topic_id, ',' ORDER BY rank) AS topics FROM snapshots WHERE window_start = TIMESTAMP '2024-01-30' AND rank <= 5 GROUP BY ALL) p ON coalesce(d.country_code, c.country_code) = p.country_code
    LEFT JOIN (SELECT country_code, count(*) FILTER (status = 'active') * 1.0e0 / count(*) AS rate FROM sources GROUP BY ALL) v ON coalesce(d.country_code, c.country_code) = v.country_code""")
def world_map(t: Tables, day: str = "2024-01-30") -> DataFrame:
    at = F.lit(day).cast("timestamp")
    dimension = t.nation.select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code")).distinct()
    counts = t.articles.where(F.col("published_at").between(at, F.lit(f"{day} 23:59:59").cast("timestamp"))).groupBy("country_code").agg(F.count("*").alias("n"))
    top = t.snapshots.where((F.col("window_start") == at) & (F.col("rank") <= 5)).groupBy("country_code")
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic_id"))), lambda x: x["topic_id"]), ",").alias("topics"))
    rate = t.sources.groupBy("country_code").agg((F.count_if(F.col("status") == "active") / F.count("*")).alias("rate"))
    out = dimension.join(counts, "country_code", "full").join(top, "country_code", "left").join(rate, "country_code", "left")
    return out.select("country_code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("topics", F.lit("")).alias("topics"), (F.coalesce("rate", F.lit(0.0)) < 0.7).alias("degraded"))


@operator("agg_22", "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM topics WHERE merged_into IS NULL) AS topics, (SELECT count(*) FROM sources WHERE status = 'active') AS sources, (SELECT count(*) FROM agenda_events WHERE status = 'confirmed') AS events")
def overview(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(t.articles, "articles")
    for df, name in ((t.topics.where("merged_into IS NULL"), "topics"), (t.sources.where("status = 'active'"), "sources"), (t.agenda_events.where("status = 'confirmed'"), "events")):
        out = out.join(F.broadcast(one(df, name)))
    return out


@operator("agg_23", "SELECT event_id, count(*) AS followers, max(round((sec(f.published_at) - sec(e.origin_at)) / 3600.0e0, 4)) AS longest FROM followers f JOIN agenda_events e USING (event_id) GROUP BY event_id")
def follower_summary(t: Tables) -> DataFrame:
    """Count and longest lag of each event's followers."""
    both = t.followers.join(t.agenda_events.select("event_id", "origin_at"), "event_id")
    lag = F.round((F.unix_timestamp("published_at") - F.unix_timestamp("origin_at")) / 3600.0, 4)
    return both.groupBy("event_id").agg(F.count("*").alias("followers"), F.max(lag).alias("longest"))


@operator("agg_24", "SELECT user_id, count(*) FILTER (created_at > :now - INTERVAL '24' HOUR) AS fresh, arg_max(alert_id, (created_at, alert_id)) AS latest FROM alerts GROUP BY user_id")
def user_alerts(t: Tables) -> DataFrame:
    fresh = F.count_if(F.col("created_at") > hours_before(t.now, 24))
    return t.alerts.groupBy("user_id").agg(fresh.alias("fresh"), F.max_by("alert_id", F.struct("created_at", "alert_id")).alias("latest"))


@operator("agg_25", "SELECT event_id, count(*) FILTER (actor = 'machine' AND try_cast(occurred_at AS TIMESTAMP) > TIMESTAMP '2024-01-25' - INTERVAL '24' HOUR AND try_cast(occurred_at AS TIMESTAMP) <= TIMESTAMP '2024-01-25') AS edits FROM revisions GROUP BY event_id")
def machine_edits(t: Tables, now: str = "2024-01-25", hours: int = CONFIG.storm_hours) -> DataFrame:
    """Machine revisions of the last hours in each event's log; times that do not parse are skipped."""
    end = F.lit(now).cast("timestamp")
    at = F.try_to_timestamp("occurred_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    fresh = (F.col("actor") == "machine") & (at > hours_before(end, hours)) & (at <= end)
    return t.revisions.groupBy("event_id").agg(F.count_if(fresh).cast("int").alias("edits"))


@operator("agg_27", """SELECT CAST(row_number() OVER (ORDER BY size DESC, topic_id) AS INT) AS number, topic_id, size, round(size * 1.0e0 / sum(size) OVER (), 6) AS share FROM topics WHERE size > 1""")
def cluster_list(t: Tables) -> DataFrame:
    """Clusters by size with their share; single members count as noise and stay out."""
    own = t.topics.where("size > 1").select("topic_id", "size")
    total = own.agg(F.sum("size").alias("total"))
    ranked = global_ranks(own, [], F.desc("size"), "topic_id")
    return ranked.join(F.broadcast(total)).select((F.col("place") + 1).cast("int").alias("number"), "topic_id", "size", share(F.col("size"), F.col("total")).alias("share"))


@operator("agg_29", "SELECT topic_id, string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS scope FROM articles GROUP BY topic_id")
def country_scope(t: Tables) -> DataFrame:
    return t.articles.groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_set("country_code")), ",").alias("scope"))


@operator("agg_30", """SELECT kind, count(*) AS cases, round(avg(CASE WHEN status IN ('confirmed', 'suspected') THEN 1.0e0 ELSE 0 END), 6) AS recall, round(count(*) FILTER (is_false_positive) * 1.0e0 / nullif(count(*) FILTER (status = 'dismissed'), 0), 6) AS false_rate,
    CASE WHEN count(*) FILTER (status = 'dismissed') = 0 THEN 'FAIL' WHEN count(*) FILTER (is_false_positive) <= 0.2 * count(*) FILTER (status = 'dismissed') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT *, split_part(topic_id, '-', 1) AS kind FROM agenda_events) x GROUP BY kind""")
def replay_metrics(t: Tables, most: float = 0.2) -> DataFrame:
    """Rates of a replay by group; without a sample the verdict is a failure."""
    e = t.agenda_events.withColumn("kind", F.split_part("topic_id", F.lit("-"), F.lit(1)))
    wrong, judged = F.count_if(F.col("is_false_positive")), F.count_if(F.col("status") == "dismissed")
    verdict = F.when(judged == 0, "FAIL").when(wrong <= most * judged, "PASS").otherwise("FAIL")
    return e.groupBy("kind").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("status").isin("confirmed", "suspected").cast("double")), 6).alias("recall"), share(wrong, judged).alias("false_rate"), verdict.alias("verdict"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class from one confusion table; 0 where undefined."""
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_truth")))).alias("s"), "n", (F.col("truth") == F.col("predicted")).alias("hit")).select("s.*", "n", "hit")
    sums = both.groupBy("label").agg(F.sum(F.when(F.col("is_truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_truth"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(~F.col("is_truth"), F.col("n")).otherwise(0)).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumn("precision", zero(F.try_divide("tp", "p"))).withColumn("recall", zero(F.try_divide("tp", "t")))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


@operator("agg_31", """WITH x AS (SELECT quality AS truth, CASE WHEN d.n_chars % 5 = 0 THEN 0 ELSE 1 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT c.label, count(*) FILTER (truth = c.label AND predicted = c.label) AS tp, count(*) FILTER (truth = c.label) AS t, count(*) FILTER (predicted = c.label) AS p FROM x CROSS JOIN (VALUES (0), (1)) AS c(label) GROUP BY c.label),
    f AS (SELECT label, coalesce(tp * 1.0e0 / nullif(p, 0), 0) AS pr, coalesce(tp * 1.0e0 / nullif(t, 0), 0) AS re FROM c) SELECT round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS macro_f1 FROM f""")
def macro_f1(t: Tables) -> DataFrame:
    both = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("quality", F.when(F.col("n_chars") % 5 == 0, 0).otherwise(1).alias("predicted"))
    return class_scores(both, "quality", "predicted").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@operator("agg_32", """SELECT round(count(*) FILTER (x.kind = y.kind) * 1.0e0 / nullif(count(*), 0), 6) AS merge_precision, count(*) AS pairs FROM (SELECT topic_id, merged_into, split_part(topic_id, '-', 1) AS kind FROM topics WHERE merged_into IS NOT NULL) x JOIN (SELECT topic_id, split_part(topic_id, '-', 1) AS kind FROM topics) y ON x.merged_into = y.topic_id""")
def merge_precision(t: Tables) -> DataFrame:
    kind = F.split_part("topic_id", F.lit("-"), F.lit(1))
    x = t.topics.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("target"), kind.alias("kind"))
    both = x.join(t.topics.select(F.col("topic_id").alias("target"), kind.alias("own")), "target")
    return both.agg(share(F.count_if(F.col("kind") == F.col("own")), F.count("*")).alias("merge_precision"), F.count("*").alias("pairs"))


@operator("agg_33", "SELECT kind, arg_min(value, CAST(n AS BIGINT)) FILTER (n > CAST(floor(0.25 * total) AS BIGINT)) AS p25, arg_min(value, CAST(n AS BIGINT)) FILTER (n > CAST(floor(0.5 * total) AS BIGINT)) AS p50, count(*) FILTER (value >= 20) AS over20, count(*) FILTER (value >= 100) AS over100 FROM (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS n, count(*) OVER (PARTITION BY kind) AS total FROM articles) x GROUP BY kind")
def nearest_ranks(t: Tables, thresholds: tuple[int, ...] = (20, 100)) -> DataFrame:
    """Nearest-rank quantiles (index int(p n)) and a sweep of thresholds.

    Rows are ranked in ranges of (kind, value), so that no kind is sorted in one task or held in one row.
    """
    own = t.articles.select("kind", "value")
    sums = own.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(F.col("value") >= x).alias(f"over{x}") for x in thresholds])
    ranked = global_ranks(own, ["kind"], "value").join(sums, "kind")
    at = lambda p: F.max(F.when(F.col("place") == F.floor(F.col("n") * p), F.col("value")))
    return ranked.groupBy("kind").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), *[F.max(f"over{x}").alias(f"over{x}") for x in thresholds])


@operator("agg_34", "SELECT source_id, min(d) AS shortest, max(d) AS longest, round(avg(d), 6) AS mean FROM (SELECT source_id, CAST(json_extract(latency_stats, '$.avg_delay_min') AS DOUBLE) AS d FROM jobs) x GROUP BY source_id")
def delays(t: Tables) -> DataFrame:
    d = t.jobs.select("source_id", F.get_json_object("latency_stats", "$.avg_delay_min").cast("double").alias("d"))
    return d.groupBy("source_id").agg(F.min("d").alias("shortest"), F.max("d").alias("longest"), F.round(F.avg("d"), 6).alias("mean"))


@operator("agg_35", "SELECT 'articles' AS name, count(*) AS n FROM articles UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'relations', count(*) FROM relations")
def table_counts(t: Tables, names: tuple[str, ...] = ("articles", "sources", "relations")) -> DataFrame:
    counts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = counts[0]
    for df in counts[1:]:
        out = out.union(df)
    return out


@operator("agg_36", "SELECT task, round(avg(latency_ms % 5 + 1), 6) AS rating, count(*) AS n FROM judgements WHERE ok GROUP BY task")
def ratings(t: Tables) -> DataFrame:
    return t.judgements.where("ok").groupBy("task").agg(F.round(F.avg(F.col("latency_ms") % 5 + 1), 6).alias("rating"), F.count("*").alias("n"))


@operator("agg_37", "SELECT count(*) AS rows, sec(max(window_start)) AS latest FROM snapshots WHERE window_start >= TIMESTAMP '2024-01-25'")
def snapshot_freshness(t: Tables, since: str = "2024-01-25") -> DataFrame:
    fresh = t.snapshots.where(F.col("window_start") >= F.lit(since).cast("timestamp"))
    return fresh.agg(F.count("*").alias("rows"), F.unix_timestamp(F.max("window_start")).alias("latest"))
