"""Joins: equi, semi, anti, interval, set overlap and text containment. Vector joins are in vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.operators.filters import active, days_before, hours_before
from tidewatch.operators.names import name_hits
from tidewatch.tables import Tables


def page(df: DataFrame, *order, number: int = 1, size: int = 20) -> DataFrame:
    """One page of df in a total order, with the number of all rows as total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


@operator("joi_01", "SELECT t.topic_id, a.article_id, t.lifecycle FROM topics t JOIN articles a ON t.topic_id = a.topic_id WHERE a.published_at >= :now - INTERVAL '2' DAY")
def topic_articles(t: Tables, days: int = 2) -> DataFrame:
    fresh = t.articles.where(F.col("published_at") >= days_before(t.now, days)).select("topic_id", "article_id")
    return fresh.join(t.topics.select("topic_id", "lifecycle"), "topic_id").select("topic_id", "article_id", "lifecycle")


@operator("joi_02", "SELECT a.topic_id, a.article_id, s.name, s.media_type FROM articles a JOIN sources s ON a.source_id = s.source_id WHERE NOT a.is_duplicate")
def topic_articles_sources(t: Tables) -> DataFrame:
    own = t.articles.where(~F.col("is_duplicate")).select("topic_id", "article_id", "source_id")
    return own.join(t.sources.select("source_id", "name", "media_type"), "source_id").drop("source_id")


@operator("joi_03", """SELECT a.country_code, a.topic_id, count(*) AS n FROM articles a JOIN topics t ON a.topic_id = t.topic_id JOIN sources s ON a.source_id = s.source_id
    WHERE t.merged_into IS NULL AND t.lifecycle <> 'archived' AND s.status = 'active' AND a.published_at >= :now - INTERVAL '7' DAY GROUP BY ALL""")
def active_topic_countries(t: Tables) -> DataFrame:
    fresh = t.articles.where(F.col("published_at") >= days_before(t.now, 7)).select("article_id", "topic_id", "source_id", "country_code")
    both = fresh.join(active(t.topics).select("topic_id"), "topic_id").join(t.sources.where("status = 'active'").select("source_id"), "source_id")
    return both.groupBy("country_code", "topic_id").agg(F.count("*").alias("n"))


@operator("joi_04", "SELECT t.topic_id, coalesce(m.media, 0) AS media FROM topics t LEFT JOIN (SELECT topic_id, count(DISTINCT source_id) AS media FROM articles WHERE published_at >= :now - INTERVAL '1' DAY GROUP BY topic_id) m ON t.topic_id = m.topic_id")
def media_counts(t: Tables) -> DataFrame:
    media = t.articles.where(F.col("published_at") >= hours_before(t.now, 24)).groupBy("topic_id").agg(F.countDistinct("source_id").alias("media"))
    return t.topics.select("topic_id").join(media, "topic_id", "left").select("topic_id", F.coalesce("media", F.lit(0)).alias("media"))


@operator("joi_05", "SELECT article_id FROM articles WHERE article_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND published_at >= :now - INTERVAL '48' HOUR")
def unclassified_pool(t: Tables) -> DataFrame:
    assigned = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("article_id"))
    return t.articles.where(F.col("published_at") >= hours_before(t.now, 48)).join(assigned, "article_id", "left_anti").select("article_id")


@operator("joi_06", "SELECT article_id FROM articles WHERE article_id IN (SELECT article_id FROM followers)")
def follower_articles(t: Tables) -> DataFrame:
    return t.articles.join(t.followers, "article_id", "left_semi").select("article_id")


@operator("joi_07", """SELECT m.subject, m.object, m.article_id, a.title, s.name AS source_name, CAST(count(*) OVER () AS BIGINT) AS total FROM mentions m JOIN articles a ON m.article_id = a.article_id
    JOIN sources s ON a.source_id = s.source_id ORDER BY m.published_at DESC, m.article_id, m.subject, m.object LIMIT 20 OFFSET 20""")
def evidence_page(t: Tables, number: int = 2, size: int = 20) -> DataFrame:
    rows = t.mentions.select("subject", "object", "article_id", F.col("published_at").alias("at"))
    rows = rows.join(t.articles.select("article_id", "title", "source_id"), "article_id").join(t.sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return page(rows.drop("source_id"), F.desc("at"), "article_id", "subject", "object", number=number, size=size).drop("at")


@operator("joi_08", "SELECT f.event_id, f.country_code, s.name AS source_name, sec(f.published_at) AS at_sec FROM followers f JOIN sources s ON f.source_id = s.source_id ORDER BY f.published_at, f.country_code")
def follower_sources(t: Tables) -> DataFrame:
    out = t.followers.join(t.sources.select("source_id", F.col("name").alias("source_name")), "source_id").orderBy("published_at", "country_code")
    return out.select("event_id", "country_code", "source_name", F.unix_timestamp("published_at").alias("at_sec"))


@operator("joi_09", """SELECT e.entity_id, a.article_id, CAST(count(*) OVER () AS BIGINT) AS total FROM article_entities e JOIN articles a ON e.article_id = a.article_id
    WHERE e.is_primary ORDER BY a.published_at DESC, a.article_id, e.entity_id LIMIT 25""")
def entity_articles(t: Tables, primary_only: bool = True, size: int = 25) -> DataFrame:
    edges = t.article_entities.where("is_primary") if primary_only else t.article_entities
    rows = edges.join(t.articles.select("article_id", "published_at"), "article_id").select("entity_id", "article_id", "published_at")
    return page(rows, F.desc("published_at"), "article_id", "entity_id", size=size).drop("published_at")


@operator("joi_10", "SELECT s.country_code, s.topic_id, t.name, s.rank FROM snapshots s JOIN topics t ON s.topic_id = t.topic_id WHERE s.window_start = TIMESTAMP '2024-01-29' AND s.rank <= 10")
def digest_rows(t: Tables) -> DataFrame:
    day = t.snapshots.where((F.col("window_start") == F.lit("2024-01-29").cast("timestamp")) & (F.col("rank") <= 10))
    return day.select("country_code", "topic_id", "rank").join(t.topics.select("topic_id", "name"), "topic_id")


@operator("joi_11", "SELECT a.alert_id, r.condition FROM alerts a JOIN rules r ON a.rule_id = r.rule_id AND r.enabled WHERE a.created_at > :now - INTERVAL '1' DAY")
def alerts_with_rules(t: Tables, hours: int = 24) -> DataFrame:
    fresh = t.alerts.where(F.col("created_at") > hours_before(t.now, hours)).select("alert_id", "rule_id")
    return fresh.join(t.rules.where("enabled").select("rule_id", "condition"), "rule_id").drop("rule_id")


@operator("joi_12", "SELECT subject, object, relation FROM relations WHERE subject IN (SELECT entity_id FROM entities WHERE is_seed) AND object IN (SELECT entity_id FROM entities WHERE is_seed)")
def inner_edges(t: Tables) -> DataFrame:
    nodes = t.entities.where("is_seed").select("entity_id")
    edges = t.relations.select("subject", "object", "relation")
    edges = edges.join(nodes, edges["subject"] == nodes["entity_id"], "left_semi")
    return edges.join(nodes, edges["object"] == nodes["entity_id"], "left_semi")


@operator("joi_17", """SELECT event_id, article_id FROM (SELECT e.event_id, a.article_id, row_number() OVER (PARTITION BY e.event_id ORDER BY a.published_at, a.article_id) AS n FROM agenda_events e JOIN articles a
    ON e.topic_id = a.topic_id AND e.origin_source_id = a.source_id AND a.published_at BETWEEN e.origin_at - INTERVAL '6' HOUR AND e.origin_at + INTERVAL '6' HOUR) x WHERE n = 1""")
def origin_articles(t: Tables, hours: int = 6) -> DataFrame:
    """The earliest article of an event's origin source in its topic within hours of the origin."""
    span = F.expr(f"INTERVAL '{hours}' HOUR")
    e = t.agenda_events.select("event_id", "topic_id", F.col("origin_source_id").alias("source_id"), "origin_at")
    near = e.join(t.articles.select("topic_id", "source_id", "article_id", "published_at"), ["topic_id", "source_id"])
    near = near.where(F.col("published_at").between(F.col("origin_at") - span, F.col("origin_at") + span))
    return first_per(near, ["event_id"], "published_at", "article_id").select("event_id", "article_id")


def title_fingerprint(title: Column) -> Column:
    """Letters and digits of a title in lower case."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\p{M}]+", "")


@operator("joi_19", r"""SELECT b.article_id, min_by(a.article_id, (a.published_at, a.article_id)) AS original FROM (SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS fp FROM texts) b JOIN
    (SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS fp FROM texts) a ON a.fp = b.fp AND a.fp <> '' AND a.published_at < b.published_at AND a.published_at >= b.published_at - INTERVAL '24' HOUR GROUP BY b.article_id""")
def same_titles(t: Tables, hours: int = 24) -> DataFrame:
    """For each text the oldest one of the last hours with the same title fingerprint.

    One window over the fingerprint, ordered by time: no pair of equal titles is ever formed.
    """
    rows = t.texts.select("article_id", title_fingerprint(F.col("title")).alias("fp"), F.unix_timestamp("published_at").alias("at")).where("fp <> ''")
    before = W.partitionBy("fp").orderBy("at").rangeBetween(-hours * 3600, -1)
    found = rows.select("article_id", F.min(F.struct("at", "article_id")).over(before)["article_id"].alias("original"))
    return found.where(F.col("original").isNotNull())


@operator("joi_20", r"""SELECT e.name AS word, count(*) AS texts FROM (SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS word FROM texts) x JOIN aliases e ON x.word = e.name GROUP BY e.name""")
def aliases_in_texts(t: Tables) -> DataFrame:
    """How many texts hold each alias as a whole word: one pass of all aliases' automaton."""
    return name_hits(t.texts, t.aliases, whole=True).groupBy(F.col("name").alias("word")).agg(F.count("*").alias("texts"))


@operator("joi_21", "SELECT t.article_id, s.name AS seed FROM texts t JOIN aliases s ON contains(lower(t.content), s.name)")
def seed_hits(t: Tables) -> DataFrame:
    """Plain substring hits of all seeds: one pass over each text."""
    return name_hits(t.texts, t.aliases, whole=False).select("article_id", F.col("name").alias("seed"))


@operator("joi_22", "SELECT article_id, country FROM texts JOIN (VALUES ('FR', 'que'), ('DE', 'und'), ('ES', 'ñ')) AS h(country, hint) ON regexp_matches(content, '(?i)' || hint)")
def country_hints(t: Tables, hints: tuple[tuple[str, str], ...] = (("FR", "que"), ("DE", "und"), ("ES", "ñ"))) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.col("content").rlike("(?iu)" + h), F.lit(c)) for c, h in hints]), lambda x: x.isNotNull())
    return t.texts.select("article_id", F.explode(found).alias("country"))


@operator("joi_23", """SELECT a, b, overlap FROM (SELECT x.topic_id AS a, y.topic_id AS b, count(DISTINCT x.keyword) AS overlap, row_number() OVER (PARTITION BY x.topic_id ORDER BY count(DISTINCT x.keyword) DESC, y.topic_id) AS n
    FROM topic_keywords x JOIN topic_keywords y ON x.keyword = y.keyword AND x.topic_id <> y.topic_id GROUP BY x.topic_id, y.topic_id HAVING count(DISTINCT x.keyword) >= 2) z WHERE n = 1""")
def keyword_match(t: Tables, least: int = 2) -> DataFrame:
    """Best match of every topic by shared keywords, at least least of them (two or more); of equal ones the first id.

    Topics with the same keywords are one class, of which the two first ids stand for all; classes
    meet on pairs of keywords, whose postings are far shorter than those of single keywords.
    """
    if least < 2:
        raise ValueError("classes meet on pairs of keywords")
    sets = t.topic_keywords.groupBy("topic_id").agg(F.array_sort(F.collect_set("keyword")).alias("words")).where(F.size("words") >= least)
    low = sets.groupBy("words").agg(F.min("topic_id").alias("first"))
    low = low.join(sets, "words").groupBy("words", "first").agg(F.min(F.when(F.col("topic_id") != F.col("first"), F.col("topic_id"))).alias("second"))
    couples = F.flatten(F.transform("words", lambda x, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = low.select("words", "first", F.explode(couples).alias("couple"))
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, (F.col("x.couple") == F.col("y.couple")) & (F.col("x.first") != F.col("y.first"))).select(F.col("x.words").alias("words"), F.col("y.first").alias("b"), F.size(F.array_intersect("x.words", "y.words")).cast("long").alias("overlap")).distinct()
    other = first_per(pairs.where(F.col("overlap") >= least), ["words"], F.desc("overlap"), "b")
    # an own class shares all its keywords, so it beats any other class but one that holds it whole
    rows = sets.join(low, "words").join(other, "words", "left")
    own = F.when(F.col("topic_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    size = F.size("words").cast("long")
    pick = F.array_compact(F.array(F.when(own.isNotNull(), F.struct((-size).alias("n"), own.alias("b"))), F.when(F.col("b").isNotNull(), F.struct((-F.col("overlap")).alias("n"), F.col("b").alias("b")))))
    best = rows.select("topic_id", F.array_min(pick).alias("p")).where("p IS NOT NULL")
    return best.select(F.col("topic_id").alias("a"), F.col("p.b").alias("b"), (-F.col("p.n")).alias("overlap"))


THEMES = {"politics": ("kw1", "kw5", "kw9"), "economy": ("kw2", "kw12", "kw22"), "health": ("kw3", "kw13", "kw33")}


@operator("joi_24", """SELECT topic_id, theme FROM (SELECT k.topic_id, h.theme, row_number() OVER (PARTITION BY k.topic_id ORDER BY count(DISTINCT k.keyword) DESC, h.ord) AS n FROM topic_keywords k JOIN
    (VALUES (0, 'politics', 'kw1'), (0, 'politics', 'kw5'), (0, 'politics', 'kw9'), (1, 'economy', 'kw2'), (1, 'economy', 'kw12'), (1, 'economy', 'kw22'), (2, 'health', 'kw3'), (2, 'health', 'kw13'), (2, 'health', 'kw33')) AS h(ord, theme, keyword)
    ON k.keyword = h.keyword GROUP BY k.topic_id, h.theme, h.ord) x WHERE n = 1""")
def theme_match(t: Tables, themes: dict[str, tuple[str, ...]] = THEMES) -> DataFrame:
    lexicon = t.spark.createDataFrame([(i, k, w) for i, (k, ws) in enumerate(themes.items()) for w in ws], "ord int, theme string, keyword string")
    hits = t.topic_keywords.join(F.broadcast(lexicon), "keyword").groupBy("topic_id", "theme", "ord").agg(F.countDistinct("keyword").alias("n"))
    return first_per(hits, ["topic_id"], F.desc("n"), "ord").select("topic_id", "theme")


@operator("joi_25", """SELECT topic_id, other FROM merge_candidates c WHERE topic_id <> other AND NOT EXISTS
    (SELECT 1 FROM no_merge n WHERE least(n.a, n.b) = least(c.topic_id, c.other) AND greatest(n.a, n.b) = greatest(c.topic_id, c.other))""")
def allowed_pairs(t: Tables) -> DataFrame:
    """Candidate pairs without those barred from merging, whatever the order of the pair."""
    pairs = t.merge_candidates.where("topic_id <> other").withColumns({"lo": F.least("topic_id", "other"), "hi": F.greatest("topic_id", "other")})
    barred = t.no_merge.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return pairs.join(barred, ["lo", "hi"], "left_anti").select("topic_id", "other")


@operator("joi_26", """SELECT r.rule_id, s.country_code, s.topic_id FROM rules r JOIN snapshots s ON list_contains(string_split(r.countries, ','), s.country_code) WHERE r.enabled AND s.window_start = TIMESTAMP '2024-01-30'
    AND (r.keyword = '' OR EXISTS (SELECT 1 FROM topic_keywords k WHERE k.topic_id = s.topic_id AND k.keyword = r.keyword))""")
def rule_scope(t: Tables, window: str = "2024-01-30") -> DataFrame:
    """Snapshot rows of a window that each enabled rule looks at: its countries, and its keyword if any."""
    r = t.rules.where("enabled").select("rule_id", "keyword", F.explode(F.split("countries", ",")).alias("country_code"))
    s = t.snapshots.where(F.col("window_start") == F.lit(window).cast("timestamp")).select("country_code", "topic_id")
    both = s.join(r, "country_code")
    free = both.where("keyword = ''")
    bound = both.where("keyword <> ''").join(t.topic_keywords.select("topic_id", "keyword"), ["topic_id", "keyword"], "left_semi")
    return free.unionByName(bound).select("rule_id", "country_code", "topic_id")


@operator("joi_27", """SELECT c.country_code, c.topic_id, c.article_count AS now_count, coalesce(p.article_count, 0) AS before_count FROM snapshots c LEFT JOIN snapshots p
    ON c.country_code = p.country_code AND c.topic_id = p.topic_id AND p.window_start = TIMESTAMP '2024-01-29' WHERE c.window_start = TIMESTAMP '2024-01-30'""")
def against_baseline(t: Tables, window: str = "2024-01-30", before: str = "2024-01-29") -> DataFrame:
    at = lambda day, name: t.snapshots.where(F.col("window_start") == F.lit(day).cast("timestamp")).select("country_code", "topic_id", F.col("article_count").alias(name))
    both = at(window, "now_count").join(at(before, "before_count"), ["country_code", "topic_id"], "left")
    return both.withColumn("before_count", F.coalesce("before_count", F.lit(0)))


@operator("joi_28", "SELECT event_id, article_id, seq FROM revisions WHERE field = 'merge'")
def merges_from_log(t: Tables) -> DataFrame:
    """Merges recovered from the events' revision logs: rows of the log, filtered before anything is gathered."""
    return t.revisions.where("field = 'merge'").select("event_id", "article_id", "seq")


@operator("joi_29", """SELECT topic_id, label FROM (SELECT a.topic_id, j.label, row_number() OVER (PARTITION BY a.topic_id ORDER BY count(*) DESC, j.label) AS n FROM judgements j JOIN articles a ON j.judgement_id = a.article_id WHERE j.ok GROUP BY a.topic_id, j.label) x WHERE n = 1""")
def majority_labels(t: Tables) -> DataFrame:
    votes = t.judgements.where("ok").select(F.col("judgement_id").alias("article_id"), "label").join(t.articles.select("article_id", "topic_id"), "article_id")
    return first_per(votes.groupBy("topic_id", "label").agg(F.count("*").alias("n")), ["topic_id"], F.desc("n"), "label").select("topic_id", "label")
