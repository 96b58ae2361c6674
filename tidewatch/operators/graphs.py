"""One-hop graphs as joins on vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.tables import Tables


@operator("gra_01", """SELECT r.subject, r.object, r.relation, r.evidence_count FROM relations r WHERE r.base_confidence >= 0.7 AND r.subject IN (SELECT entity_id FROM entities WHERE monitored) AND r.object IN (SELECT entity_id FROM entities WHERE monitored)""")
def watch_graph(t: Tables, least: float = 0.7) -> DataFrame:
    """Links of least confidence between monitored entities."""
    nodes = t.entities.where("monitored").select("entity_id")
    links = t.relations.where(F.col("base_confidence") >= least).select("subject", "object", "relation", "evidence_count")
    links = links.join(nodes.withColumnRenamed("entity_id", "subject"), "subject", "left_semi")
    return links.join(nodes.withColumnRenamed("entity_id", "object"), "object", "left_semi").select("subject", "object", "relation", "evidence_count")


@operator("gra_02", """SELECT e.entity_id, x.direction, x.other, o.name AS other_name, x.relation FROM (SELECT subject AS entity_id, 'out' AS direction, object AS other, relation FROM relations UNION ALL SELECT object, 'in', subject, relation FROM relations) x
    JOIN entities e ON x.entity_id = e.entity_id JOIN entities o ON x.other = o.entity_id""")
def ego_networks(t: Tables) -> DataFrame:
    """Edges of each entity with their direction and other end, exploded once instead of a union of scans."""
    ends = F.array(
        F.struct(F.col("subject").alias("entity_id"), F.lit("out").alias("direction"), F.col("object").alias("other")),
        F.struct(F.col("object").alias("entity_id"), F.lit("in").alias("direction"), F.col("subject").alias("other")),
    )
    edges = t.relations.select(F.explode(ends).alias("e"), "relation").select("e.*", "relation")
    own = t.entities.select("entity_id")
    return edges.join(own, "entity_id", "left_semi").join(t.entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name")), "other").select("entity_id", "direction", "other", "other_name", "relation")


@operator("gra_03", "SELECT f.event_id, f.origin_country AS source, f.country_code AS target, round((sec(f.published_at) - sec(e.origin_at)) / 3600.0e0, 4) AS lag_hours, a.title FROM followers f JOIN agenda_events e USING (event_id) LEFT JOIN articles a ON f.article_id = a.article_id")
def propagation_star(t: Tables) -> DataFrame:
    e = t.agenda_events.select("event_id", "origin_at")
    both = t.followers.join(e, "event_id").join(t.articles.select("article_id", "title"), "article_id", "left")
    lag = F.round((F.unix_timestamp("published_at") - F.unix_timestamp("origin_at")) / 3600.0, 4)
    return both.select("event_id", F.col("origin_country").alias("source"), F.col("country_code").alias("target"), lag.alias("lag_hours"), "title")


@operator("gra_04", "SELECT event_id, coalesce(lag(country_code) OVER w, origin_country) AS source, country_code AS target, s.name AS source_name FROM followers f JOIN sources s ON f.source_id = s.source_id WINDOW w AS (PARTITION BY event_id ORDER BY published_at, f.country_code)".replace("coalesce(lag(country_code) OVER w", "coalesce(lag(f.country_code) OVER w").replace("country_code AS target", "f.country_code AS target"))
def follow_chain(t: Tables) -> DataFrame:
    """Followers in time order, each after the one before, the first after the origin."""
    before = F.lag("country_code").over(W.partitionBy("event_id").orderBy("published_at", "country_code"))
    rows = t.followers.select("event_id", F.coalesce(before, "origin_country").alias("source"), F.col("country_code").alias("target"), "source_id")
    return rows.join(t.sources.select("source_id", F.col("name").alias("source_name")), "source_id").drop("source_id")
