"""Order-dependent operators that windows and aggregates can say: origins, followers, events, relations, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.filters import days_before, hours_before
from tidewatch.operators.joins import first_per
from tidewatch.operators.scalars import level_score
from tidewatch.operators.vectors import bound_once, normalized
from tidewatch.storage import checkpointed
from tidewatch.tables import Tables


def decay(hours: Column, half_life: float = CONFIG.half_life_hours) -> Column:
    return F.pow(F.lit(0.5), F.greatest(hours, F.lit(0.0)) / half_life)


def pooled(old: Column, new: Column, hours: Column) -> Column:
    """Time-decayed mean of two vectors, of unit length; at no distance in time the old one stays."""
    mean = lambda a: F.zip_with(old, new, lambda x, y: a * x.cast("double") + (1 - a) * y.cast("double"))
    return normalized(bound_once(decay(hours), mean))


def size_pooled(old: Column, new: Column, hours: Column, size: Column) -> Column:
    """As pooled, the new vector's share damped by size / (size + 1) and both renormalised."""
    share = lambda a: F.struct(a.alias("a"), ((1 - a) * size / (size + 1)).alias("b"))
    parts = lambda s: F.struct((s["a"] / (s["a"] + s["b"])).alias("a"), (s["b"] / (s["a"] + s["b"])).alias("b"))
    mean = lambda s: F.zip_with(old, new, lambda x, y: s["a"] * x.cast("double") + s["b"] * y.cast("double"))
    return normalized(bound_once(decay(hours), lambda a: bound_once(share(a), lambda s: bound_once(parts(s), mean))))


_TWO = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, a.vec_id % 49 AS h FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _two(t: Tables) -> DataFrame:
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return t.embeddings.select("vec_id", F.col("embedding").alias("x")).join(nxt, "vec_id").withColumn("h", F.col("vec_id") % 49)


def _ends(rows: DataFrame, v: Column) -> DataFrame:
    """First and last entry of a vector, which is made once a row."""
    ends = bound_once(v, lambda v: F.struct(F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last")))
    return rows.select("vec_id", ends.alias("ends")).select("vec_id", "ends.first", "ends.last")


@operator("seq_01", f"SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, [pow(0.5e0, h / 24.0e0) * x[i] + (1 - pow(0.5e0, h / 24.0e0)) * y[i] FOR i IN range(1, 65)] AS v FROM ({_TWO}) p) q) r")
def decay_pooling(t: Tables) -> DataFrame:
    return _ends(_two(t), pooled(F.col("x"), F.col("y"), F.col("h")))


@operator("seq_02", f"SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, [(a * x[i] + b * y[i]) / (a + b) FOR i IN range(1, 65)] AS v FROM (SELECT *, (1 - a) * s / (s + 1) AS b FROM (SELECT *, pow(0.5e0, h / 24.0e0) AS a, vec_id % 9 + 1 AS s FROM ({_TWO}) p) q) r) z) u")
def size_weighted_pooling(t: Tables) -> DataFrame:
    return _ends(_two(t), size_pooled(F.col("x"), F.col("y"), F.col("h"), F.col("vec_id") % 9 + 1))


def latest_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The upsert of an append log: the last write of each key."""
    return first_per(df, keys, *order)


@operator("seq_06", """SELECT article_id, topic_id, weight FROM (SELECT article_id % 5000 AS article_id, topic_id, CAST(round(least(greatest(weight * 1.2e0, 0), 1), 3) AS DOUBLE) AS weight, row_number() OVER (PARTITION BY article_id % 5000 ORDER BY published_at DESC, topic_id) AS n FROM articles) x WHERE n = 1""")
def assignments(t: Tables) -> DataFrame:
    """Current topic of each article after moves; weights clamped to 0-1 at three places."""
    log = t.articles.select((F.col("article_id") % 5000).alias("article_id"), "topic_id", F.round(F.least(F.greatest(F.col("weight") * 1.2, F.lit(0.0)), F.lit(1.0)), 3).alias("weight"), "published_at")
    return latest_per(log, ["article_id"], F.desc("published_at"), "topic_id").select("article_id", "topic_id", "weight")


@operator("seq_08", """WITH m AS (SELECT topic_id, merged_into FROM topics WHERE merged_into IN (SELECT topic_id FROM topics)), r AS (SELECT topic_id, merged_into AS root, 1 AS depth FROM m UNION ALL SELECT r.topic_id, m.merged_into, r.depth + 1 FROM r JOIN m ON r.root = m.topic_id WHERE r.depth < 16),
    roots AS (SELECT topic_id, arg_max(root, depth) AS root FROM r GROUP BY topic_id), g AS (SELECT coalesce(x.root, a.topic_id) AS topic_id, count(*) AS edges, count(*) FILTER (x.root IS NOT NULL) AS moved, string_agg(DISTINCT a.country_code, ',' ORDER BY a.country_code) AS scope FROM articles a LEFT JOIN roots x ON a.topic_id = x.topic_id GROUP BY 1)
    SELECT g.*, coalesce(v.events, 0) AS events, CASE WHEN t.lifecycle IN ('evolving', 'archived') OR list_position(['nascent', 'forming', 'confirmed'], t.lifecycle) >= list_position(['nascent', 'forming', 'confirmed'], w) THEN t.lifecycle ELSE w END AS lifecycle FROM (SELECT *, CASE WHEN edges <= 1 THEN 'nascent' WHEN edges < 10 THEN 'forming' ELSE 'confirmed' END AS w FROM g) g2
    JOIN g USING (topic_id) JOIN topics t ON g.topic_id = t.topic_id LEFT JOIN (SELECT x.root AS topic_id, count(*) AS events FROM agenda_events e JOIN roots x ON e.topic_id = x.topic_id GROUP BY 1) v ON g.topic_id = v.topic_id""")
def merged_edges(t: Tables) -> DataFrame:
    """Topics after all merges: edges under the last topic of each chain, its countries, the events that
    moved with them, and its state, which only goes forward."""
    known = t.topics.select(F.col("topic_id").alias("merged_into"))
    links = t.topics.select("topic_id", "merged_into").where("merged_into IS NOT NULL").join(known, "merged_into", "left_semi")
    roots = merge_roots(links)
    both = t.articles.select("topic_id", "country_code").join(roots, "topic_id", "left")
    edges = both.groupBy(F.coalesce("root", "topic_id").alias("topic_id")).agg(F.count("*").alias("edges"), F.count("root").alias("moved"), F.array_join(F.array_sort(F.collect_set("country_code")), ",").alias("scope"))
    events = t.agenda_events.select("topic_id").join(roots, "topic_id").groupBy(F.col("root").alias("topic_id")).agg(F.count("*").alias("events"))
    rows = edges.join(t.topics.select("topic_id", "lifecycle"), "topic_id").join(events, "topic_id", "left")
    return rows.select("topic_id", "edges", "moved", "scope", F.coalesce("events", F.lit(0)).alias("events"), forward(F.col("lifecycle"), state_for_size(F.col("edges"))).alias("lifecycle"))


def merge_roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(topic_id, root) by pointer doubling: chains of 2^k merges take k rounds."""
    now = checkpointed(links.where("topic_id <> merged_into").select("topic_id", F.col("merged_into").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("topic_id").alias("root"), F.col("root").alias("next"))
        stepped = checkpointed(now.join(ahead, "root", "left").select("topic_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            break
        now = stepped.select("topic_id", "root")
    return now


@operator("seq_09", """SELECT t.topic_id, string_agg(DISTINCT a.keyword, ',' ORDER BY a.keyword) AS overlap FROM topics t JOIN topic_keywords a ON a.topic_id = t.topic_id JOIN topic_keywords b ON b.topic_id = t.merged_into AND a.keyword = b.keyword WHERE a.keyword NOT IN ('kw0', 'kw10') GROUP BY t.topic_id""")
def keyword_overlap(t: Tables, blacklist: tuple[str, ...] = ("kw0", "kw10")) -> DataFrame:
    words = t.topic_keywords.groupBy("topic_id").agg(F.collect_set("keyword").alias("w"))
    both = t.topics.where("merged_into IS NOT NULL").select("topic_id", "merged_into").join(words, "topic_id").join(words.select(F.col("topic_id").alias("merged_into"), F.col("w").alias("o")), "merged_into")
    shared = F.array_sort(F.array_except(F.array_intersect("w", "o"), F.array(*map(F.lit, blacklist))))
    return both.select("topic_id", F.array_join(shared, ",").alias("overlap")).where("overlap <> ''")


def fallback_topics(t: Tables) -> DataFrame:
    """Topic of each text by shared keywords with recent topics (two at least), else by theme."""
    from tidewatch.operators.joins import keyword_match, theme_match

    history = keyword_match(t).select(F.col("a").alias("topic_id"), F.col("b").alias("target"), (F.col("overlap") / 5).alias("weight"))
    theme = theme_match(t).select("topic_id", F.concat(F.lit("theme-"), "theme").alias("target"), F.lit(0.5).alias("weight")).join(history, "topic_id", "left_anti")
    return history.union(theme)


_MATCH = """SELECT a AS topic_id, b AS target, overlap / 5.0e0 AS weight FROM (SELECT x.topic_id AS a, y.topic_id AS b, count(DISTINCT x.keyword) AS overlap, row_number() OVER (PARTITION BY x.topic_id ORDER BY count(DISTINCT x.keyword) DESC, y.topic_id) AS n
    FROM topic_keywords x JOIN topic_keywords y ON x.keyword = y.keyword AND x.topic_id <> y.topic_id GROUP BY x.topic_id, y.topic_id HAVING count(DISTINCT x.keyword) >= 2) z WHERE n = 1"""
_THEME = """SELECT topic_id, theme FROM (SELECT k.topic_id, h.theme, row_number() OVER (PARTITION BY k.topic_id ORDER BY count(DISTINCT k.keyword) DESC, h.ord) AS n FROM topic_keywords k JOIN
    (VALUES (0, 'politics', 'kw1'), (0, 'politics', 'kw5'), (0, 'politics', 'kw9'), (1, 'economy', 'kw2'), (1, 'economy', 'kw12'), (1, 'economy', 'kw22'), (2, 'health', 'kw3'), (2, 'health', 'kw13'), (2, 'health', 'kw33')) AS h(ord, theme, keyword)
    ON k.keyword = h.keyword GROUP BY k.topic_id, h.theme, h.ord) x WHERE n = 1"""
operator("seq_14", f"WITH hist AS ({_MATCH}), theme AS ({_THEME}) SELECT * FROM hist UNION ALL SELECT topic_id, concat('theme-', theme), 0.5e0 FROM theme WHERE topic_id NOT IN (SELECT topic_id FROM hist)")(fallback_topics)

STATES = ("nascent", "forming", "confirmed", "evolving", "archived")


def state_for_size(size: Column, confirmed: int = CONFIG.confirmed_size) -> Column:
    return F.when(size <= 1, "nascent").when(size < confirmed, "forming").otherwise("confirmed")


def forward(current: Column, wanted: Column) -> Column:
    """The later of two lifecycle states: a topic never goes back."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    return F.when(rank(wanted) > rank(current), wanted).otherwise(current)


@operator("seq_15", "SELECT topic_id, CASE WHEN list_position(['nascent', 'forming', 'confirmed', 'evolving', 'archived'], w) > list_position(['nascent', 'forming', 'confirmed', 'evolving', 'archived'], lifecycle) THEN w ELSE lifecycle END AS lifecycle FROM (SELECT *, CASE WHEN size + 4 <= 1 THEN 'nascent' WHEN size + 4 < 10 THEN 'forming' ELSE 'confirmed' END AS w FROM topics) x")
def advanced(t: Tables) -> DataFrame:
    return t.topics.select("topic_id", forward(F.col("lifecycle"), state_for_size(F.col("size") + 4)).alias("lifecycle"))


@operator("seq_16", "SELECT topic_id FROM topics WHERE last_seen < :now - INTERVAL '7' DAY AND NOT locked AND lifecycle <> 'archived' AND merged_into IS NULL")
def archive_sweep(t: Tables) -> DataFrame:
    idle = F.col("last_seen") < days_before(t.now, CONFIG.archive_days)
    return t.topics.where(idle & ~F.col("locked") & (F.col("lifecycle") != "archived") & F.col("merged_into").isNull()).select("topic_id")


@operator("seq_17", "SELECT topic_id FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM articles WHERE published_at >= TIMESTAMP '2024-01-25')")
def empty_topics(t: Tables) -> DataFrame:
    return t.topics.select("topic_id").join(t.articles.where(F.col("published_at") >= F.lit("2024-01-25").cast("timestamp")), "topic_id", "left_anti")


#: Legal moves of an event.
MOVES = {"watching": ("suspected", "dismissed", "archived"), "suspected": ("confirmed", "dismissed", "revised", "archived"), "confirmed": ("revised", "archived"), "dismissed": ("watching", "archived"), "revised": ("suspected", "confirmed", "dismissed", "archived"), "archived": ()}


def may_move(status: Column, target: Column) -> Column:
    """Whether an event may go from a status to another."""
    allowed = F.create_map(*[F.lit(x) for s, to in MOVES.items() for x in (s, ",".join(to))])
    return F.coalesce(F.array_contains(F.split(F.element_at(allowed, status), ","), target), F.lit(False))


@operator("seq_18", """SELECT e.event_id, m.target, CASE e.status WHEN 'watching' THEN m.target IN ('suspected', 'dismissed', 'archived') WHEN 'suspected' THEN m.target IN ('confirmed', 'dismissed', 'revised', 'archived') WHEN 'confirmed' THEN m.target IN ('revised', 'archived')
    WHEN 'dismissed' THEN m.target IN ('watching', 'archived') WHEN 'revised' THEN m.target IN ('suspected', 'confirmed', 'dismissed', 'archived') ELSE false END AS legal FROM agenda_events e CROSS JOIN (VALUES ('watching'), ('suspected'), ('confirmed'), ('dismissed'), ('revised'), ('archived')) AS m(target)""")
def legal_moves(t: Tables) -> DataFrame:
    """Every status an event could be asked to take, and whether it may."""
    rows = t.agenda_events.select("event_id", "status", F.explode(F.array(*map(F.lit, MOVES))).alias("target"))
    return rows.select("event_id", "target", may_move(F.col("status"), F.col("target")).alias("legal"))


_FOLLOWERS = "SELECT event_id, count(DISTINCT country_code) FILTER (at_sec - origin BETWEEN 0 AND 14 * 86400) AS n FROM (SELECT f.event_id, f.country_code, sec(f.published_at) AS at_sec, sec(e.origin_at) AS origin FROM followers f JOIN agenda_events e USING (event_id)) x GROUP BY event_id"


@operator("seq_19", f"""SELECT event_id, a, b, c, d, a AND b AND d AND (c OR insufficient_data) AS opened FROM (SELECT e.event_id, e.confidence IN ('medium', 'high') OR e.origin_type = 'person' AS a, coalesce(f.n, 0) >= 3 AS b,
    NOT e.insufficient_data AND (e.xcorr_p < 0.05 OR e.granger_p < 0.05) AS c, t.lifecycle IN ('forming', 'confirmed') AS d, e.insufficient_data FROM agenda_events e JOIN topics t ON e.topic_id = t.topic_id LEFT JOIN ({_FOLLOWERS}) f ON e.event_id = f.event_id) x""")
def event_conditions(t: Tables) -> DataFrame:
    """Origin trusted, enough followers, a significant lead and a grown topic; too few data waive the third."""
    e = t.agenda_events.join(t.topics.select("topic_id", "lifecycle"), "topic_id")
    lag = F.unix_timestamp("published_at") - F.unix_timestamp("origin_at")
    n = t.followers.join(t.agenda_events.select("event_id", "origin_at"), "event_id").where(lag.between(0, CONFIG.follower_days * 86400)).groupBy("event_id").agg(F.countDistinct("country_code").alias("n"))
    lead = ~F.col("insufficient_data") & ((F.col("xcorr_p") < CONFIG.alpha) | (F.col("granger_p") < CONFIG.alpha))
    out = e.join(n, "event_id", "left").withColumns({"a": F.col("confidence").isin("medium", "high") | (F.col("origin_type") == "person"), "b": F.coalesce("n", F.lit(0)) >= CONFIG.follower_countries, "c": lead, "d": F.col("lifecycle").isin("forming", "confirmed")})
    return out.select("event_id", "a", "b", "c", "d", (F.col("a") & F.col("b") & F.col("d") & (F.col("c") | F.col("insufficient_data"))).alias("opened"))


@operator("seq_20", "SELECT event_id, CASE WHEN origin_type = 'person' THEN 'high' ELSE confidence END AS confidence FROM agenda_events WHERE topic_id NOT IN (SELECT topic_id FROM known_events)")
def new_events(t: Tables) -> DataFrame:
    """Events of topics without one yet; a person's origin counts as high."""
    fresh = t.agenda_events.join(t.known_events, "topic_id", "left_anti")
    return fresh.select("event_id", F.when(F.col("origin_type") == "person", "high").otherwise(F.col("confidence")).alias("confidence"))


_ORIGIN = "SELECT topic_id, article_id, country_code, source_id, sec(published_at) AS at, CASE WHEN time_source = 'crawled' THEN 'low' WHEN is_wire THEN 'high' ELSE 'medium' END AS confidence, time_source = 'crawled' AS review FROM articles WHERE NOT is_duplicate QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY epoch(published_at) - CASE WHEN is_wire THEN 1800 ELSE 0 END, is_wire DESC, published_at, article_id) = 1"


def media_origins(t: Tables, boost_hours: float = CONFIG.wire_boost_hours) -> DataFrame:
    """Earliest canonical report of each topic, wires half an hour ahead; crawled times are trusted least."""
    anchor = F.unix_micros("published_at") - F.when(F.col("is_wire"), int(boost_hours * 3_600_000_000)).otherwise(0)
    first = first_per(t.articles.where(~F.col("is_duplicate")), ["topic_id"], anchor, F.desc("is_wire"), "published_at", "article_id")
    crawled = F.col("time_source") == "crawled"
    return first.select("topic_id", "article_id", "country_code", "source_id", F.unix_timestamp("published_at").alias("at"), F.when(crawled, "low").when(F.col("is_wire"), "high").otherwise("medium").alias("confidence"), crawled.alias("review"))


operator("seq_21", _ORIGIN)(media_origins)


@operator("seq_22", f"""SELECT topic_id, country_code, lag_hours, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY lag_hours, country_code) AS INT) AS sequence_no FROM (SELECT f.topic_id, f.country_code, round((sec(f.published_at) - o.at) / 3600.0e0, 4) AS lag_hours
    FROM firsts f JOIN ({_ORIGIN}) o ON f.topic_id = o.topic_id WHERE f.country_code <> o.country_code AND sec(f.published_at) - o.at BETWEEN 0 AND 14 * 86400) x""")
def follower_sequences(t: Tables, days: int = CONFIG.follower_days) -> DataFrame:
    """First report of every other country within days of the origin, in order of lag, then country."""
    first = first_per(t.articles.where(~F.col("is_duplicate")), ["topic_id", "country_code"], "published_at", "article_id").select("topic_id", "country_code", F.unix_timestamp("published_at").alias("first"))
    origin = media_origins(t).select("topic_id", F.col("country_code").alias("origin"), "at")
    lag = F.col("first") - F.col("at")
    both = first.join(origin, "topic_id").where((F.col("country_code") != F.col("origin")) & lag.between(0, days * 86400)).withColumn("lag_hours", F.round(lag / 3600.0, 4))
    return both.select("topic_id", "country_code", "lag_hours", F.row_number().over(W.partitionBy("topic_id").orderBy("lag_hours", "country_code")).alias("sequence_no"))


@operator("seq_23", "SELECT event_id, CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END AS confidence FROM agenda_events WHERE insufficient_data")
def lowered_confidence(t: Tables) -> DataFrame:
    return t.agenda_events.where("insufficient_data").select("event_id", F.when(F.col("confidence") == "high", "medium").otherwise("low").alias("confidence"))


@operator("seq_29", """SELECT event_id, CASE WHEN sig THEN CASE confidence WHEN 'low' THEN 'medium' ELSE 'high' END ELSE CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END END AS confidence FROM (SELECT *, xcorr_p < 0.05 OR granger_p < 0.05 OR qap_p < 0.05 AS sig FROM agenda_events) x""")
def escalated(t: Tables) -> DataFrame:
    """Up a level with any significant test, down a level without."""
    sig = (F.col("xcorr_p") < CONFIG.alpha) | (F.col("granger_p") < CONFIG.alpha) | (F.col("qap_p") < CONFIG.alpha)
    up = F.when(F.col("confidence") == "low", "medium").otherwise("high")
    down = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    return t.agenda_events.select("event_id", F.when(sig, up).otherwise(down).alias("confidence"))


@operator("seq_30", "SELECT event_id FROM revisions WHERE actor = 'machine' AND try_cast(occurred_at AS TIMESTAMP) > TIMESTAMP '2024-01-24' AND try_cast(occurred_at AS TIMESTAMP) <= TIMESTAMP '2024-01-25' GROUP BY event_id HAVING count(*) > 1")
def revision_storms(t: Tables, most: int = 1) -> DataFrame:
    from tidewatch.operators.aggregates import machine_edits

    return machine_edits(t).where(F.col("edits") > most).select("event_id")


@operator("seq_31", """SELECT event_id, after AS status, review_score IS NULL AS unavailable, CASE WHEN after <> status THEN coalesce(n, 0) + 1 END AS log_seq, CASE WHEN after <> status THEN 'status' END AS log_field, CASE WHEN after <> status THEN 'machine' END AS log_actor, CASE WHEN after <> status THEN status END AS log_before
    FROM (SELECT *, CASE WHEN review_score >= 7 THEN 'confirmed' WHEN review_score >= 5 THEN status WHEN review_score IS NULL THEN status ELSE 'watching' END AS after FROM agenda_events) e LEFT JOIN (SELECT event_id, max(seq) AS n FROM revisions GROUP BY event_id) r USING (event_id)""")
def final_review(t: Tables) -> DataFrame:
    """Events after their final review; where it changes the status, the row of the revision log: the next number of
    the event, field, actor and what stood before."""
    s = F.col("review_score")
    last = t.revisions.groupBy("event_id").agg(F.max("seq").alias("n"))
    after = F.when(s >= 7, "confirmed").when(s < 5, "watching").otherwise(F.col("status"))
    rows = t.agenda_events.withColumn("after", after).join(last, "event_id", "left")
    logged = lambda value: F.when(F.col("after") != F.col("status"), value)
    return rows.select("event_id", F.col("after").alias("status"), s.isNull().alias("unavailable"), logged(F.coalesce("n", F.lit(0)) + 1).alias("log_seq"), logged(F.lit("status")).alias("log_field"), logged(F.lit("machine")).alias("log_actor"), logged(F.col("status")).alias("log_before"))


@operator("seq_32", "SELECT subject, object, relation, count(*) AS evidence, sec(min(published_at)) AS first_sec, sec(max(published_at)) AS last_sec, max(CASE level WHEN 'high' THEN 0.9e0 WHEN 'medium' THEN 0.7e0 ELSE 0.4e0 END) AS base FROM mentions GROUP BY subject, object, relation")
def relation_upsert(t: Tables) -> DataFrame:
    """Relations from evidence, one of each article."""
    rows = t.mentions.dropDuplicates(["subject", "object", "relation", "article_id"])
    at = F.unix_timestamp("published_at")
    return rows.groupBy("subject", "object", "relation").agg(F.count("*").alias("evidence"), F.min(at).alias("first_sec"), F.max(at).alias("last_sec"), F.max(level_score(F.col("level"))).alias("base"))


def decayed(base: Column, last: Column, now: Column, days: float = CONFIG.relation_decay_days) -> Column:
    return base * F.exp(-(F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400.0 / days)


@operator("seq_33", "SELECT subject, object, relation, round(c, 6) AS confidence, CASE WHEN c < 0.2 THEN 'expired' ELSE 'active' END AS status FROM (SELECT *, base_confidence * exp(-(sec((SELECT max(last_seen) FROM relations)) - sec(last_seen)) / 86400.0e0 / 14) AS c FROM relations) x")
def relation_decay(t: Tables, now: str | None = None) -> DataFrame:
    """All relations as they stand at now, by default when the last of them was seen."""
    if now is None:
        rows = t.relations.join(F.broadcast(t.relations.agg(F.max("last_seen").alias("now"))))  # one row
    else:
        rows = t.relations.withColumn("now", F.lit(now).cast("timestamp"))
    rows = rows.withColumn("c", decayed(F.col("base_confidence").cast("double"), F.col("last_seen"), F.col("now")))
    return rows.select("subject", "object", "relation", F.round("c", 6).alias("confidence"), F.when(F.col("c") < CONFIG.relation_expired, "expired").otherwise("active").alias("status"))


@operator("seq_34", "SELECT entity_id, string_agg(article_id, ',' ORDER BY article_id) AS latest FROM (SELECT DISTINCT entity_id, article_id FROM article_entities QUALIFY dense_rank() OVER (PARTITION BY entity_id ORDER BY article_id DESC) <= 5) x GROUP BY entity_id")
def last_utterances(t: Tables, n: int = 5) -> DataFrame:
    """The last n first utterances of each entity, one an article, in order."""
    from tidewatch.operators.windows import top_per

    kept = top_per(t.article_entities.select("entity_id", "article_id").distinct(), ["entity_id"], n, F.desc("article_id"))
    last = F.transform(F.array_sort(F.collect_list("article_id")), lambda x: x.cast("string"))
    return kept.groupBy("entity_id").agg(F.array_join(last, ",").alias("latest"))


@operator("seq_37", "SELECT job_id, retry_count < 3 AS retry, CASE WHEN retry_count < 3 THEN CAST(300 * pow(2, greatest(retry_count - 1, 0)) AS BIGINT) END AS wait FROM jobs WHERE status = 'temporary_failure'")
def retries(t: Tables, most: int = 3, base: int = 300) -> DataFrame:
    again = F.col("retry_count") < most
    wait = (base * F.pow(F.lit(2.0), F.greatest(F.col("retry_count") - 1, F.lit(0)))).cast("long")
    return t.jobs.where("status = 'temporary_failure'").select("job_id", again.alias("retry"), F.when(again, wait).alias("wait"))


@operator("seq_38", """SELECT s.source_id FROM sources s LEFT JOIN (SELECT source_id, max(scheduled_at) AS last FROM jobs GROUP BY source_id) j ON s.source_id = j.source_id WHERE s.status IN ('active', 'degraded') AND (j.last IS NULL OR sec(:now) - sec(j.last) >= s.poll_interval_min * 60)
    AND s.source_id NOT IN (SELECT source_id FROM jobs WHERE status = 'pending' AND scheduled_at >= :now - INTERVAL '2' DAY)""")
def due_sources(t: Tables) -> DataFrame:
    last = t.jobs.groupBy("source_id").agg(F.max("scheduled_at").alias("last"))
    waiting = t.jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") >= hours_before(t.now, 48))).select("source_id")
    rows = t.sources.where(F.col("status").isin("active", "degraded")).join(last, "source_id", "left").join(waiting, "source_id", "left_anti")
    return rows.where(F.col("last").isNull() | (F.unix_timestamp(t.now) - F.unix_timestamp("last") >= F.col("poll_interval_min") * 60)).select("source_id")


@operator("seq_43", "SELECT t.topic_id, CASE WHEN t.locked OR n.a IS NOT NULL THEN t.topic_id ELSE coalesce(t.merged_into, t.topic_id) END AS target FROM topics t LEFT JOIN (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM no_merge) n ON least(t.topic_id, t.merged_into) = n.a AND greatest(t.topic_id, t.merged_into) = n.b")
def move_guard(t: Tables) -> DataFrame:
    """Where members go: they stay where the topic is locked or the pair is barred."""
    barred = t.no_merge.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("barred", F.lit(True))
    rows = t.topics.select("topic_id", "merged_into", "locked", F.least("topic_id", "merged_into").alias("lo"), F.greatest("topic_id", "merged_into").alias("hi")).join(barred, ["lo", "hi"], "left")
    stay = F.col("locked") | F.col("barred").isNotNull()
    return rows.select("topic_id", F.when(stay, F.col("topic_id")).otherwise(F.coalesce("merged_into", "topic_id")).alias("target"))


@operator("seq_44", "SELECT source_id, arg_max(status, (scheduled_at, job_id)) AS status FROM jobs GROUP BY source_id")
def job_states(t: Tables) -> DataFrame:
    return t.jobs.groupBy("source_id").agg(F.max_by("status", F.struct("scheduled_at", "job_id")).alias("status"))


@operator("seq_45", "SELECT t.topic_id, substring(repeat(t.name, 30), 1, 280) AS name, k.words FROM topics t JOIN (SELECT topic_id, string_agg(keyword, ',' ORDER BY position) AS words FROM topic_keywords WHERE position < 3 GROUP BY topic_id) k ON t.topic_id = k.topic_id")
def created_topics(t: Tables, name_size: int = 280, words: int = 3) -> DataFrame:
    k = t.topic_keywords.groupBy("topic_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "keyword"))), lambda x: x["keyword"]), 1, words).alias("words"))
    return t.topics.join(k, "topic_id").select("topic_id", F.substring(F.repeat("name", 30), 1, name_size).alias("name"), F.array_join("words", ",").alias("words"))


@operator("seq_46", "SELECT task, sec(min(created_at)) AS since FROM judgements WHERE NOT ok AND created_at >= TIMESTAMP '2024-01-28' GROUP BY task")
def degraded_since(t: Tables, cleared: str = "2024-01-28") -> DataFrame:
    """Start of a degradation: the first failure after the flag was last cleared."""
    failed = t.judgements.where(~F.col("ok") & (F.col("created_at") >= F.lit(cleared).cast("timestamp")))
    return failed.groupBy("task").agg(F.unix_timestamp(F.min("created_at")).alias("since"))


@operator("seq_47", """SELECT m.article_id, m.subject, m.object FROM (SELECT *, row_number() OVER (PARTITION BY article_id % 1000 ORDER BY article_id) AS n FROM mentions) m JOIN entities s ON m.subject = s.entity_id JOIN entities o ON m.object = o.entity_id
    WHERE n <= 5 AND m.subject <> m.object AND (s.is_seed OR o.is_seed) AND m.relation <> 'cites'""")
def relation_round(t: Tables, most: int = CONFIG.relation_items) -> DataFrame:
    """Items of an extraction round that stand: the first five of a batch, both ends known, no loop, one end a seed, evidence quoted."""
    from tidewatch.operators.windows import top_per

    items = t.mentions.select((F.col("article_id") % 1000).alias("batch"), "article_id", "subject", "object", "relation")
    rows = top_per(items, ["batch"], most, "article_id", "subject", "object", "relation").where("subject <> object AND relation <> 'cites'")
    s, o = t.entities.select(F.col("entity_id").alias("subject"), F.col("is_seed").alias("s")), t.entities.select(F.col("entity_id").alias("object"), F.col("is_seed").alias("o"))
    return rows.join(s, "subject").join(o, "object").where("s OR o").select("article_id", "subject", "object")


_FIELDS = "SELECT event_id, topic_id, 'confidence' AS field, confidence AS old, CASE WHEN granger_p < 0.5 THEN 'high' ELSE confidence END AS new FROM agenda_events UNION ALL SELECT event_id, topic_id, 'status', status, CASE WHEN qap_p < 0.5 THEN 'revised' ELSE status END FROM agenda_events"


@operator("seq_48", f"SELECT event_id, field, old, new FROM ({_FIELDS}) x JOIN topics t ON x.topic_id = t.topic_id WHERE old IS DISTINCT FROM new AND NOT t.locked")
def field_revisions(t: Tables) -> DataFrame:
    """Log rows of machine revisions: fields that differ and are not locked."""
    e = t.agenda_events.join(t.topics.where("NOT locked").select("topic_id"), "topic_id", "left_semi")
    row = lambda field, new: F.struct(F.lit(field).alias("field"), F.col(field).alias("old"), new.alias("new"))
    rows = F.array(row("confidence", F.when(F.col("granger_p") < 0.5, "high").otherwise(F.col("confidence"))), row("status", F.when(F.col("qap_p") < 0.5, "revised").otherwise(F.col("status"))))
    return e.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.*").where(~F.col("old").eqNullSafe(F.col("new")))
