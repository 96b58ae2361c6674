"""Alert rules, storms, digests and system alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.filters import due, hours_before
from tidewatch.operators.joins import against_baseline, rule_scope
from tidewatch.operators.scalars import growth_met
from tidewatch.operators.vectors import _CENT, cluster_quality
from tidewatch.tables import Tables

_SCOPE = """SELECT r.rule_id, r.user_id, r.condition, r.threshold, s.country_code, s.topic_id, s.article_count AS n, coalesce(p.article_count, 0) AS b, s.rank, s.negative FROM rules r JOIN snapshots s ON list_contains(string_split(r.countries, ','), s.country_code)
    LEFT JOIN snapshots p ON p.country_code = s.country_code AND p.topic_id = s.topic_id AND p.window_start = TIMESTAMP '2024-01-29' WHERE r.enabled AND s.window_start = TIMESTAMP '2024-01-30'
    AND (r.keyword = '' OR EXISTS (SELECT 1 FROM topic_keywords k WHERE k.topic_id = s.topic_id AND k.keyword = r.keyword))"""
_MET = f"SELECT *, CASE condition WHEN 'growth_rate' THEN CASE WHEN b > 0 THEN (n - b) * 100.0e0 / b >= threshold ELSE n > 0 AND threshold <= 100 END WHEN 'top_n' THEN rank <= threshold ELSE coalesce(negative > threshold, false) END AS met FROM ({_SCOPE}) x"


def evaluated(t: Tables) -> DataFrame:
    """Every rule against the rows it looks at, with whether its condition is met."""
    rows = rule_scope(t).join(against_baseline(t), ["country_code", "topic_id"])
    day = t.snapshots.where(F.col("window_start") == F.lit("2024-01-30").cast("timestamp")).select("country_code", "topic_id", "rank", "negative")
    rows = rows.join(day, ["country_code", "topic_id"]).join(t.rules.select("rule_id", "user_id", "condition", "threshold"), "rule_id")
    met = F.when(F.col("condition") == "growth_rate", growth_met(F.col("now_count"), F.col("before_count"), F.col("threshold"))).when(F.col("condition") == "top_n", F.col("rank") <= F.col("threshold"))
    return rows.withColumn("met", met.otherwise(F.coalesce(F.col("negative") > F.col("threshold"), F.lit(False))))


@operator("alr_01", f"SELECT rule_id, country_code, topic_id, bool_and(met) AS fired FROM ({_MET}) y GROUP BY ALL")
def rule_evaluation(t: Tables) -> DataFrame:
    return evaluated(t).groupBy("rule_id", "country_code", "topic_id").agg(F.bool_and("met").alias("fired"))


@operator("alr_02", f"""SELECT user_id, count(*) AS fired, count(*) FILTER (recent) AS suppressed, count(*) FILTER (NOT recent) >= 5 AS storm FROM (SELECT m.user_id, EXISTS (SELECT 1 FROM alerts a WHERE a.rule_id = m.rule_id AND a.topic_id = m.topic_id AND a.created_at > :now - INTERVAL '72' HOUR) AS recent FROM ({_MET}) m WHERE met) x GROUP BY user_id""")
def alert_round(t: Tables, hours: int = 72, storm: int = 5) -> DataFrame:
    """A round's alerts by user: those a recent alert suppresses, and whether the rest is a storm for one digest."""
    recent = t.alerts.where(F.col("created_at") > hours_before(t.now, hours)).select("rule_id", "topic_id").distinct().withColumn("recent", F.lit(True))
    fired = evaluated(t).where("met").join(recent, ["rule_id", "topic_id"], "left")
    fresh = F.count_if(F.col("recent").isNull())
    return fired.groupBy("user_id").agg(F.count("*").alias("fired"), F.count_if("recent").alias("suppressed"), (fresh >= storm).alias("storm"))


@operator("alr_03", f"SELECT m.rule_id, m.country_code, concat('E-', m.topic_id) AS event_id FROM ({_MET}) m WHERE met AND m.topic_id IN (SELECT topic_id FROM agenda_events WHERE status = 'confirmed')")
def event_alerts(t: Tables) -> DataFrame:
    confirmed = t.agenda_events.where("status = 'confirmed'").select("topic_id", "event_id")
    return evaluated(t).where("met").join(confirmed, "topic_id").select("rule_id", "country_code", "event_id")


WAITS = (60, 300, 900)


@operator("alr_04", "SELECT alert_id, sec(created_at) + CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END AS next_retry, CASE WHEN attempts = 2 THEN 'email' ELSE 'webhook' END AS channel FROM alerts WHERE delivery = 'failed' AND attempts < 3 AND sec(created_at) + CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END <= sec(:now)")
def retry_scan(t: Tables) -> DataFrame:
    """Failed deliveries that are due again; the last try falls back to e-mail."""
    at = F.unix_timestamp("created_at") + F.get(F.array(*map(F.lit, WAITS)), "attempts")
    rows = t.alerts.where((F.col("delivery") == "failed") & (F.col("attempts") < len(WAITS))).withColumn("next_retry", at)
    return rows.where(F.col("next_retry") <= F.unix_timestamp(t.now)).select("alert_id", "next_retry", F.when(F.col("attempts") == len(WAITS) - 1, "email").otherwise("webhook").alias("channel"))


@operator("alr_05", """SELECT s.subscription_id, string_agg(concat(d.rank, ':', d.topic_id), ' ' ORDER BY d.rank) AS digest FROM subscriptions s JOIN snapshots d ON s.country_code = d.country_code AND d.window_start = TIMESTAMP '2024-01-30' AND d.rank <= 3
    WHERE s.enabled AND CASE WHEN s.last_sent_at IS NULL THEN true WHEN s.period = 'daily' THEN CAST(s.last_sent_at AS DATE) < CAST(:now AS DATE) ELSE sec(:now) - sec(s.last_sent_at) >= 604800 END GROUP BY s.subscription_id""")
def digests(t: Tables, k: int = 3) -> DataFrame:
    ready = t.subscriptions.where("enabled").where(due(F.col("period"), F.col("last_sent_at"), t.now)).select("subscription_id", "country_code")
    rows = t.snapshots.where((F.col("window_start") == F.lit("2024-01-30").cast("timestamp")) & (F.col("rank") <= k)).select("country_code", "rank", "topic_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic_id"))), lambda x: F.concat_ws(":", x["rank"].cast("string"), x["topic_id"]))
    return ready.join(rows, "country_code").groupBy("subscription_id").agg(F.array_join(lines, " ").alias("digest"))


@operator("alr_06", "SELECT source_id, round(count(*) FILTER (status LIKE '%failure') * 1.0e0 / count(*), 6) AS rate FROM jobs WHERE status <> 'pending' AND scheduled_at >= :now - INTERVAL '48' HOUR GROUP BY source_id HAVING count(*) >= 3 AND count(*) FILTER (status LIKE '%failure') * 1.0e0 / count(*) > 0.5")
def source_alerts(t: Tables, most: float = 0.5) -> DataFrame:
    fresh = t.jobs.where((F.col("status") != "pending") & (F.col("scheduled_at") >= hours_before(t.now, 48)))
    rows = fresh.groupBy("source_id").agg(F.count("*").alias("n"), (F.count_if(F.col("status").like("%failure")) / F.count("*")).alias("rate"))
    return rows.where((F.col("n") >= 3) & (F.col("rate") > most)).select("source_id", F.round("rate", 6).alias("rate"))


@operator("alr_07", f"SELECT cohesion, cohesion < 0.5e0 AS alarm FROM (SELECT round((SELECT avg(cohesion) FROM ({_CENT}) e), 6) AS cohesion) z")
def quality_alert(t: Tables, least: float = 0.5) -> DataFrame:
    """Whether clusters have grown too loose."""
    return cluster_quality(t).select("cohesion", (F.col("cohesion") < least).alias("alarm"))


@operator("alr_08", "SELECT source_id, count(*) AS alarms FROM (SELECT source_id, status LIKE '%failure' AND lag(status) OVER w LIKE '%failure' AND lag(status, 2) OVER w LIKE '%failure' AS bad FROM jobs WINDOW w AS (PARTITION BY source_id ORDER BY scheduled_at, job_id)) x WHERE bad GROUP BY source_id")
def consecutive_failures(t: Tables) -> DataFrame:
    """Runs whose last three jobs all failed."""
    w = W.partitionBy("source_id").orderBy("scheduled_at", "job_id")
    failed = lambda c: F.coalesce(c.like("%failure"), F.lit(False))
    bad = failed(F.col("status")) & failed(F.lag("status").over(w)) & failed(F.lag("status", 2).over(w))
    return t.jobs.select("source_id", bad.alias("bad")).where("bad").groupBy("source_id").agg(F.count("*").alias("alarms"))


@operator("alr_09", "SELECT rule_id, alert_id FROM (SELECT rule_id, alert_id, created_at, lag(created_at) OVER (PARTITION BY rule_id ORDER BY created_at, alert_id) AS before FROM alerts) x WHERE before IS NULL OR sec(created_at) - sec(before) >= 3600")
def debounced(t: Tables, minutes: int = CONFIG.debounce_minutes) -> DataFrame:
    """System alerts that no other of the same key precedes within the quiet time."""
    before = F.lag("created_at").over(W.partitionBy("rule_id").orderBy("created_at", "alert_id"))
    rows = t.alerts.withColumn("before", before)
    return rows.where(F.col("before").isNull() | (F.unix_timestamp("created_at") - F.unix_timestamp("before") >= minutes * 60)).select("rule_id", "alert_id")


@operator("alr_10", f"SELECT user_id, count(*) AS n, string_agg(DISTINCT topic_id, ',' ORDER BY topic_id) AS topics FROM ({_MET}) m WHERE met AND rank <= 5 GROUP BY user_id")
def storm_digests(t: Tables) -> DataFrame:
    fired = evaluated(t).where("met AND rank <= 5")
    return fired.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("topic_id")), ",").alias("topics"))


@operator("alr_11", f"SELECT rule_id, country_code, topic_id, concat(topic_id, ': ', n, ' after ', b) AS reason FROM ({_MET}) m WHERE met")
def alert_reasons(t: Tables) -> DataFrame:
    """The plain reason of an alert, which stands where no text service answers."""
    reason = F.concat(F.col("topic_id"), F.lit(": "), F.col("now_count").cast("string"), F.lit(" after "), F.col("before_count").cast("string"))
    return evaluated(t).where("met").select("rule_id", "country_code", "topic_id", reason.alias("reason"))


@operator("src_24", "SELECT alert_id, CASE WHEN user_id % 2 = 0 THEN 'webhook' ELSE 'in_app' END AS channel, CASE WHEN delivery = 'failed' AND attempts < 3 THEN sec(created_at) + CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END END AS next_retry_at, CASE WHEN user_id % 2 = 0 AND delivery = 'failed' AND attempts >= 2 THEN 'email' END AS fallback FROM alerts")
def notifications(t: Tables) -> DataFrame:
    """Rows for the senders, with the time of the next try of failed ones; a webhook's last try falls back to e-mail."""
    wait, hook = F.get(F.array(*map(F.lit, WAITS)), "attempts"), F.col("user_id") % 2 == 0
    again = F.when((F.col("delivery") == "failed") & (F.col("attempts") < len(WAITS)), F.unix_timestamp("created_at") + wait)
    return t.alerts.select("alert_id", F.when(hook, "webhook").otherwise("in_app").alias("channel"), again.alias("next_retry_at"), F.when(hook & (F.col("delivery") == "failed") & (F.col("attempts") >= len(WAITS) - 1), "email").alias("fallback"))
