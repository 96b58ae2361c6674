"""The event chain over all topics at once: detection, re-estimation, revisions, dismissal and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.filters import active, days_before
from tidewatch.operators.lifecycle import _ORIGIN, follower_sequences, may_move, media_origins, state_for_size
from tidewatch.tables import Tables

_FOLLOWING = f"""SELECT topic_id, count(*) AS n, string_agg(country_code, ',' ORDER BY lag, country_code) AS line FROM (SELECT f.topic_id, f.country_code, round((sec(f.published_at) - o.at) / 3600.0e0, 4) AS lag
    FROM firsts f JOIN ({_ORIGIN}) o ON f.topic_id = o.topic_id WHERE f.country_code <> o.country_code AND sec(f.published_at) - o.at BETWEEN 0 AND 14 * 86400) x GROUP BY topic_id"""
_VERDICTS = "SELECT DISTINCT topic_id FROM judgements WHERE ok AND label = 'politics' AND task = 'purchase'"
_WINDOW = "SELECT topic_id, count(*) AS n FROM articles WHERE published_at >= :now - INTERVAL '30' DAY GROUP BY topic_id"


def lowered(level: Column) -> Column:
    return F.when(level == "high", "medium").otherwise("low")


def person_verdicts(t: Tables) -> DataFrame:
    """Topics whose first utterance a judge gave to a person."""
    return t.judgements.where("ok AND label = 'politics' AND task = 'purchase'").select("topic_id").distinct()


@operator("seq_24", f"""WITH c AS (SELECT t.topic_id, o.topic_id IS NOT NULL AS found, CASE o.confidence WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS origin, v.topic_id IS NOT NULL AS person, coalesce(f.n, 0) AS followers,
      o.confidence IN ('medium', 'high') OR v.topic_id IS NOT NULL AS a, coalesce(f.n, 0) >= 3 AS b, coalesce(f.n, 0) = 0 OR coalesce(w.n, 0) < 100 OR e.event_id IS NULL AS insufficient, e.xcorr_p < 0.05 OR e.granger_p < 0.05 AS significant, t.lifecycle IN ('forming', 'confirmed') AS d, e.status
    FROM topics t LEFT JOIN ({_ORIGIN}) o ON t.topic_id = o.topic_id LEFT JOIN ({_FOLLOWING}) f ON t.topic_id = f.topic_id LEFT JOIN ({_VERDICTS}) v ON t.topic_id = v.topic_id LEFT JOIN ({_WINDOW}) w ON t.topic_id = w.topic_id LEFT JOIN agenda_events e ON t.topic_id = e.topic_id
    WHERE t.merged_into IS NULL AND t.lifecycle <> 'archived')
    SELECT topic_id, CASE WHEN NOT found THEN 'none' WHEN person THEN 'high' ELSE origin END AS origin_confidence, followers, coalesce(insufficient, true) AS insufficient,
      CASE WHEN NOT found THEN 'no_original_articles' WHEN NOT (a AND b AND d) THEN concat_ws(',', CASE WHEN NOT a THEN 'origin' END, CASE WHEN NOT b THEN 'followers' END, CASE WHEN NOT d THEN 'lifecycle' END) WHEN insufficient THEN 'pending' WHEN significant THEN 'opened' ELSE 'not_significant' END AS reason,
      CASE WHEN found AND a AND b AND d AND (insufficient OR significant) THEN coalesce(status, 'suspected') END AS status FROM c""")
def detection(t: Tables, judge: bool = True) -> DataFrame:
    """The detection chain for every active topic: origin, followers, statistics, conditions, event.

    Without a judge there is no person's origin and the media origin counts a level lower. Too few
    reports leave the third condition pending; a test that ran and failed keeps the event closed. An
    event that exists keeps its fields. A topic without an original report gets its reason and
    touches no other topic.
    """
    origin = media_origins(t).select("topic_id", "confidence")
    origin = origin if judge else origin.withColumn("confidence", lowered(F.col("confidence")))
    person = person_verdicts(t) if judge else person_verdicts(t).limit(0)
    followers = follower_sequences(t).groupBy("topic_id").agg(F.count("*").alias("followers"))
    sample = t.articles.where(F.col("published_at") >= days_before(t.now, CONFIG.stats_days)).groupBy("topic_id").agg(F.count("*").alias("sample"))
    stored = t.agenda_events.select("topic_id", "event_id", "status", "xcorr_p", "granger_p")
    rows = active(t.topics).select("topic_id", "lifecycle").join(origin, "topic_id", "left").join(person.withColumn("person", F.lit(True)), "topic_id", "left")
    rows = rows.join(followers, "topic_id", "left").join(sample, "topic_id", "left").join(stored, "topic_id", "left")
    found, is_person = F.col("confidence").isNotNull(), F.coalesce("person", F.lit(False))
    n = F.coalesce("followers", F.lit(0)).cast("long")
    a = F.coalesce(F.col("confidence").isin("medium", "high"), F.lit(False)) | is_person
    b, d = n >= CONFIG.follower_countries, F.col("lifecycle").isin("forming", "confirmed")
    insufficient = (n == 0) | (F.coalesce("sample", F.lit(0)) < CONFIG.stats_least_articles) | F.col("event_id").isNull()
    significant = F.coalesce((F.col("xcorr_p") < CONFIG.alpha) | (F.col("granger_p") < CONFIG.alpha), F.lit(False))
    missing = F.concat_ws(",", F.when(~a, "origin"), F.when(~b, "followers"), F.when(~d, "lifecycle"))
    reason = F.when(~found, "no_original_articles").when(~(a & b & d), missing).when(insufficient, "pending").when(significant, "opened").otherwise("not_significant")
    status = F.when(found & a & b & d & (insufficient | significant), F.coalesce("status", F.lit("suspected")))
    confidence = F.when(~found, "none").when(is_person, "high").otherwise(F.col("confidence"))
    return rows.select("topic_id", confidence.alias("origin_confidence"), n.alias("followers"), insufficient.alias("insufficient"), reason.alias("reason"), status.alias("status"))


CLOSED = ("confirmed", "dismissed", "archived")
_REST = f"""SELECT e.event_id, e.status, string_split(e.locked_fields, ',') AS locked, e.origin_country AS c0, o.country_code AS c1, CAST(e.origin_source_id AS VARCHAR) AS s0, CAST(o.source_id AS VARCHAR) AS s1, CAST(sec(e.origin_at) AS VARCHAR) AS a0, CAST(o.at AS VARCHAR) AS a1, e.confidence AS k0, o.confidence AS k1,
    coalesce(g.line, '') AS f0, coalesce(f.line, '') AS f1 FROM agenda_events e JOIN ({_ORIGIN}) o ON e.topic_id = o.topic_id LEFT JOIN ({_FOLLOWING}) f ON e.topic_id = f.topic_id LEFT JOIN (SELECT event_id, string_agg(country_code, ',' ORDER BY published_at, country_code) AS line FROM followers GROUP BY event_id) g ON e.event_id = g.event_id WHERE e.status <> 'archived'"""


@operator("seq_25", f"""SELECT event_id, field, old, new, CASE WHEN status IN ('confirmed', 'dismissed', 'archived') THEN status ELSE 'revised' END AS status FROM (SELECT event_id, status, locked, unnest([{{'field': 'origin_country', 'old': c0, 'new': c1}}, {{'field': 'origin_source_id', 'old': s0, 'new': s1}}, {{'field': 'origin_at', 'old': a0, 'new': a1}}, {{'field': 'confidence', 'old': k0, 'new': k1}}, {{'field': 'followers', 'old': f0, 'new': f1}}], recursive := true) FROM ({_REST}) r) x
    WHERE old IS DISTINCT FROM new AND NOT list_contains(locked, field)""")
def reestimated(t: Tables) -> DataFrame:
    """Log rows of a re-estimation: every field of an event that differs when all is computed anew.

    Locked fields and archived events stay; an event with a changed field is revised, unless it was
    confirmed or dismissed.
    """
    origin = media_origins(t).select("topic_id", F.col("country_code").alias("c1"), F.col("source_id").cast("string").alias("s1"), F.col("at").cast("string").alias("a1"), F.col("confidence").alias("k1"))
    ordered = lambda rows, by, *order: rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "country_code"))), lambda x: x["country_code"]), ",").alias("line"))
    after = ordered(follower_sequences(t), "topic_id", "lag_hours").withColumnRenamed("line", "f1")
    before = ordered(t.followers, "event_id", "published_at").withColumnRenamed("line", "f0")
    rows = t.agenda_events.where("status <> 'archived'").join(origin, "topic_id").join(after, "topic_id", "left").join(before, "event_id", "left")
    none = F.lit("")
    pairs = {"origin_country": (F.col("origin_country"), F.col("c1")), "origin_source_id": (F.col("origin_source_id").cast("string"), F.col("s1")), "origin_at": (F.unix_timestamp("origin_at").cast("string"), F.col("a1")), "confidence": (F.col("confidence"), F.col("k1")), "followers": (F.coalesce("f0", none), F.coalesce("f1", none))}
    fields = F.array(*[F.struct(F.lit(k).alias("field"), old.alias("old"), new.alias("new")) for k, (old, new) in pairs.items()])
    status = F.when(F.col("status").isin(*CLOSED), F.col("status")).otherwise("revised")
    out = rows.select("event_id", status.alias("status"), F.split("locked_fields", ",").alias("locked"), F.explode(fields).alias("r")).select("event_id", "status", "locked", "r.*")
    return out.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.array_contains("locked", F.col("field"))).select("event_id", "field", "old", "new", "status")


@operator("seq_26", """SELECT event_id, article_id, fault FROM (SELECT event_id, article_id, CASE WHEN before_value = after_value THEN 'unchanged' WHEN evidence IS NULL OR evidence IN ('', '{}') THEN 'evidence' WHEN actor = 'machine' AND (coalesce(model, '') = '' OR coalesce(prompt_version, '') = '') THEN 'model'
    WHEN actor = 'machine' AND actor_id IS NOT NULL THEN 'actor' WHEN actor = 'human' AND actor_id IS NULL THEN 'actor' WHEN actor NOT IN ('human', 'machine') THEN 'actor' WHEN try_cast(occurred_at AS TIMESTAMP) IS NULL THEN 'time' END AS fault FROM revisions) x WHERE fault IS NOT NULL""")
def revision_faults(t: Tables) -> DataFrame:
    """Log rows that may not be appended, with the first rule they break, for quarantine.

    A value changes; there is evidence; a machine names its model and prompt and no person, a
    person is named; the time parses.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fault = (
        F.when(F.col("before_value").eqNullSafe(F.col("after_value")), "unchanged").when(blank(F.col("evidence")) | (F.col("evidence") == "{}"), "evidence").when((F.col("actor") == "machine") & (blank(F.col("model")) | blank(F.col("prompt_version"))), "model")
        .when((F.col("actor") == "machine") & F.col("actor_id").isNotNull(), "actor").when((F.col("actor") == "human") & F.col("actor_id").isNull(), "actor").when(~F.col("actor").isin("human", "machine"), "actor").when(F.try_to_timestamp("occurred_at", F.lit("yyyy-MM-dd HH:mm:ss")).isNull(), "time")
    )
    return t.revisions.select("event_id", "article_id", fault.alias("fault")).where("fault IS NOT NULL")


@operator("seq_27", """WITH live AS (SELECT event_id, field, before_value, article_id FROM revisions WHERE actor = 'machine' AND NOT rejected), target AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY article_id DESC) = 1),
    others AS (SELECT l.event_id, count(*) FILTER (l.field <> 'status' AND l.article_id <> g.article_id) AS n FROM live l JOIN target g ON l.event_id = g.event_id GROUP BY l.event_id)
    SELECT e.event_id, CASE WHEN e.status IN ('confirmed', 'dismissed', 'archived') THEN 'invalid' ELSE 'confirmed' END AS confirmed, CASE WHEN e.status = 'archived' THEN 'archived' WHEN g.event_id IS NULL THEN 'none' ELSE 'rejected' END AS outcome, g.field, g.before_value AS restored,
      CASE WHEN g.field IS NULL OR list_contains(string_split(e.locked_fields, ','), g.field) THEN e.locked_fields WHEN e.locked_fields = '' THEN g.field ELSE concat(e.locked_fields, ',', g.field) END AS locked_fields,
      CASE WHEN g.field IS NULL THEN e.status WHEN (CASE WHEN g.field = 'status' THEN g.before_value ELSE e.status END) = 'revised' AND coalesce(o.n, 0) = 0 THEN 'suspected' WHEN g.field = 'status' THEN g.before_value ELSE e.status END AS status
    FROM agenda_events e LEFT JOIN target g ON e.event_id = g.event_id LEFT JOIN others o ON e.event_id = o.event_id""")
def decided_revisions(t: Tables) -> DataFrame:
    """For every event: what confirming it gives, and what rejecting its latest machine revision gives.

    A rejection restores the value before, locks the field, and takes a revised event back to
    suspected once no other machine revision stands. Closed events cannot be confirmed, archived
    ones not be changed.
    """
    live = t.revisions.where("actor = 'machine' AND NOT rejected").select("event_id", "field", "before_value", "article_id")
    counts = live.groupBy("event_id").agg(F.max(F.struct("article_id", "field", "before_value")).alias("g"), F.count_if(F.col("field") != "status").alias("n"))
    rows = t.agenda_events.join(counts, "event_id", "left")
    field, status = F.col("g.field"), F.col("status")
    left = F.col("n") - F.when(field != "status", 1).otherwise(0)
    now = F.when(field == "status", F.col("g.before_value")).otherwise(status)
    after = F.when(field.isNull(), status).when((now == "revised") & (left == 0), "suspected").otherwise(now)
    own = F.split("locked_fields", ",")
    locked = F.when(field.isNull() | F.array_contains(own, field), F.col("locked_fields")).when(F.col("locked_fields") == "", field).otherwise(F.concat_ws(",", "locked_fields", field))
    outcome = F.when(status == "archived", "archived").when(field.isNull(), "none").otherwise("rejected")
    return rows.select("event_id", F.when(status.isin(*CLOSED), "invalid").otherwise("confirmed").alias("confirmed"), outcome.alias("outcome"), field.alias("field"), F.col("g.before_value").alias("restored"), locked.alias("locked_fields"), after.alias("status"))


@operator("seq_28", "SELECT event_id, CASE WHEN status IN ('watching', 'suspected', 'revised') THEN 'dismissed' ELSE status END AS status, status IN ('watching', 'suspected', 'revised') AS done, CASE WHEN status IN ('watching', 'suspected', 'revised') THEN confidence = 'low' ELSE coalesce(is_false_positive, false) END AS is_false_positive FROM agenda_events")
def dismissals(t: Tables, false_positive: Column | None = None) -> DataFrame:
    """Every event after a request to dismiss it: done where the move is legal, with the request's flag."""
    flag = false_positive if false_positive is not None else F.col("confidence") == "low"
    may = may_move(F.col("status"), F.lit("dismissed"))
    kept = F.coalesce("is_false_positive", F.lit(False))
    return t.agenda_events.select("event_id", F.when(may, "dismissed").otherwise(F.col("status")).alias("status"), may.alias("done"), F.when(may, flag).otherwise(kept).alias("is_false_positive"))


_SIZE = "CASE WHEN {0} <= 1 THEN 'nascent' WHEN {0} < 10 THEN 'forming' ELSE 'confirmed' END"


@operator("seq_10", f"""WITH pairs AS (SELECT c.topic_id AS child, c.merged_into AS parent, c.first_seen FROM topics c JOIN topics p ON c.merged_into = p.topic_id WHERE p.lifecycle <> 'archived' AND p.merged_into IS NULL),
    marked AS (SELECT x.parent, x.child, a.country_code, a.topic_id = x.child OR o.origin_topic IS NOT NULL AS goes FROM pairs x JOIN articles a ON a.topic_id IN (x.child, x.parent) LEFT JOIN edge_origins o ON o.article_id = a.article_id AND o.origin_topic = x.child),
    sides AS (SELECT parent, child, count(*) FILTER (goes) AS child_size, count(*) FILTER (NOT goes) AS stay, coalesce(string_agg(DISTINCT country_code, ',' ORDER BY country_code) FILTER (goes), '') AS child_scope, coalesce(string_agg(DISTINCT country_code, ',' ORDER BY country_code) FILTER (NOT goes), '') AS parent_scope FROM marked GROUP BY parent, child),
    own AS (SELECT topic_id, count(*) AS n FROM articles GROUP BY topic_id)
    SELECT x.parent, x.child, least(x.parent, x.child) AS no_merge_low, greatest(x.parent, x.child) AS no_merge_high, s.child_size - coalesce(c.n, 0) AS moved_back, s.stay, s.child_size, {_SIZE.format('s.stay')} AS parent_state, {_SIZE.format('s.child_size')} AS child_state, s.parent_scope, s.child_scope, e.origin_at >= x.first_seen AS event_moves
    FROM pairs x JOIN sides s ON x.parent = s.parent AND x.child = s.child LEFT JOIN own c ON x.child = c.topic_id LEFT JOIN agenda_events e ON e.topic_id = x.parent""")
def splits(t: Tables) -> DataFrame:
    """Every merge, taken back: which edges go to the child, sizes, states and countries of both after it.

    The edges that came from this child go back to it, those of other children stay with the parent; the pair is
    barred from merging again; states follow the sizes and may go backward; an event moves with the
    child if it began no earlier. A parent that is archived or merged itself is left out. split_edges() has the
    edges themselves, of which repooled() makes both centroids anew.
    """
    pairs = _split_pairs(t)
    sides = split_edges(t).groupBy("parent", "child").agg(
        F.count_if("goes").alias("child_size"), F.count_if(~F.col("goes")).alias("stay"), F.count_if("back").alias("moved_back"),
        F.collect_set(F.when(F.col("goes"), F.col("country_code"))).alias("child_scope"), F.collect_set(F.when(~F.col("goes"), F.col("country_code"))).alias("parent_scope"),
    )
    rows = pairs.join(sides, ["parent", "child"]).join(t.agenda_events.select(F.col("topic_id").alias("parent"), "origin_at"), "parent", "left")
    joined = lambda s: F.array_join(F.array_sort(s), ",")
    return rows.select(
        "parent", "child", F.least("parent", "child").alias("no_merge_low"), F.greatest("parent", "child").alias("no_merge_high"), "moved_back", "stay", "child_size", state_for_size(F.col("stay")).alias("parent_state"),
        state_for_size(F.col("child_size")).alias("child_state"), joined("parent_scope").alias("parent_scope"), joined("child_scope").alias("child_scope"), (F.col("origin_at") >= F.col("first_seen")).alias("event_moves"),
    )


def _split_pairs(t: Tables) -> DataFrame:
    parents = t.topics.where("lifecycle <> 'archived' AND merged_into IS NULL").select(F.col("topic_id").alias("parent"))
    return t.topics.where("merged_into IS NOT NULL").select(F.col("topic_id").alias("child"), F.col("merged_into").alias("parent"), "first_seen").join(parents, "parent")


def split_edges(t: Tables) -> DataFrame:
    """(parent, child, article_id, country_code, goes, back) of every merge, taken back: goes where the edge is the child's
    afterwards, back where it was the parent's before."""
    pairs = _split_pairs(t).select("parent", "child")
    edges = t.articles.select(F.col("topic_id"), "article_id", "country_code")
    origin = t.edge_origins.select("article_id", F.col("origin_topic").alias("child"), F.lit(True).alias("back"))
    of_parent = pairs.join(edges.withColumnRenamed("topic_id", "parent"), "parent").join(origin, ["article_id", "child"], "left").withColumn("back", F.coalesce("back", F.lit(False)))
    of_child = pairs.join(edges.withColumnRenamed("topic_id", "child"), "child").withColumn("back", F.lit(False))
    columns = ("parent", "child", "article_id", "country_code")
    return of_parent.select(*columns, F.col("back").alias("goes"), "back").union(of_child.select(*columns, F.lit(True).alias("goes"), "back"))


def repooled(edges: DataFrame, reports: DataFrame) -> DataFrame:
    """The topics (TOPICS) that edges (topic, article_id) leave, each pooled anew over its reports (article_id, vec,
    country_code, published_at) in order of time; a topic without a report that has a vector gives no row, and keeps
    what it had."""
    from tidewatch.operators.folds import TOPICS, fold_by, maintain_step

    rows = edges.select("topic", "article_id").join(reports.where("vec IS NOT NULL").select("article_id", "vec", "country_code", "published_at"), "article_id")
    return fold_by(rows, ["topic"], ["published_at", "article_id"], maintain_step, TOPICS)
