"""Scalar functions as Column expressions, each with a query over a real column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import WIRE_SERVICES
from tidewatch.operators.filters import display_name
from tidewatch.operators.joins import title_fingerprint
from tidewatch.tables import Tables

#: Starts of parameters that only track, held against the name and "=".
TRACKING = r"(?i)^(utm_|fbclid|gclid|spm|ref_|from=)"


def normalized_url(url: Column) -> Column:
    """Scheme and host in lower case, no user, fragment, default port, tracking parameters or trailing
    slash; parameters decoded, sorted and encoded again. What has no host stays as it is."""
    url = F.trim(url)
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, host, port = F.lower(part("PROTOCOL")), F.lower(part("HOST")), F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/")), ";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    items = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: p != "")
    pairs = F.transform(items, lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_replace(F.when(F.contains(p, F.lit("=")), p).otherwise("="), "^[^=]*=", "")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: ~F.concat(x["k"], F.lit("=")).rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda x: F.concat(coded(x["k"]), F.lit("="), coded(x["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(whole, url)


_CODED = "replace(url_encode({0}), '%20', '+')"
_PLAIN = "url_decode(replace({0}, '+', ' '))"
_URL = rf"""SELECT page_id, concat(scheme, '://', regexp_replace(host, ':\d+$', ''), CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END, CASE WHEN q = '' THEN '' ELSE '?' || q END) AS url
    FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]*:(\d+)(?:[/?#]|$)', 1) AS port, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path,
    array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'k': {_PLAIN.format("split_part(p, '=', 1)")}, 'v': {_PLAIN.format("CASE WHEN contains(p, '=') THEN substring(p, strpos(p, '=') + 1) ELSE '' END")}}}), lambda x: NOT regexp_matches(x.k || '=', '(?i)^(utm_|fbclid|gclid|spm|ref_|from=)'))), lambda x: {_CODED.format('x.k')} || '=' || {_CODED.format('x.v')}), '&') AS q FROM pages) x"""


@operator("fn_01", _URL)
def urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", normalized_url(F.col("url")).alias("url"))


@operator("fn_02", f"SELECT page_id, sha256(url) AS url_hash FROM ({_URL}) y")
def url_hashes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(normalized_url(F.col("url")), 256).alias("url_hash"))


@operator("fn_03", r"SELECT article_id, regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS fingerprint FROM texts")
def fingerprints(t: Tables) -> DataFrame:
    return t.texts.select("article_id", title_fingerprint(F.col("title")).alias("fingerprint"))


STOP_WORDS = ("the", "of", "and", "to", "in", "is", "are", "was", "for", "with", "that", "this", "on", "by", "as", "from", "than")


def tokens(text: Column) -> Column:
    """Latin words of two letters or more without stop words, then pairs of adjacent CJK characters."""
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9'-]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    return F.concat(latin, F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0)), lambda r: ngrams(r, 2))))


def ngrams(run: Column, n: int) -> Column:
    """All substrings of n characters."""
    count = F.char_length(run) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@operator("fn_04", f"SELECT article_id, len(w) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT article_id, list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9''-]+'), lambda x: x NOT IN ({_STOP})) AS w FROM texts) x")
def token_lists(t: Tables) -> DataFrame:
    w = t.texts.select("article_id", tokens(F.col("content")).alias("w"))
    return w.select("article_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")


_CJK = "SELECT x FROM (VALUES ('东京奥运会'), ('plain'), ('ひらがな'), ('한국'), ('mix 中文 text')) AS v(x)"


def _cjk(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in ("东京奥运会", "plain", "ひらがな", "한국", "mix 中文 text")], "x string")


@operator("fn_05", rf"SELECT x, regexp_matches(x, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]') AS cjk FROM ({_CJK}) y")
def cjk_flags(t: Tables) -> DataFrame:
    return _cjk(t).select("x", has_cjk(F.col("x")).alias("cjk"))


@operator("fn_06", f"SELECT x, array_to_string(list_concat(list_concat(list_transform(range(1, greatest(length(x) - 2, 1)), lambda i: substring(x, i, 4)), list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substring(x, i, 3))), list_transform(range(1, greatest(length(x), 1)), lambda i: substring(x, i, 2))), '|') AS grams FROM ({_CJK}) y")
def cjk_grams(t: Tables) -> DataFrame:
    grams = F.concat(*[ngrams(F.col("x"), n) for n in (4, 3, 2)])
    return _cjk(t).select("x", F.array_join(grams, "|").alias("grams"))


@operator("fn_09", "SELECT entity_id, array_to_string(list_sort(list_distinct([lower(trim(a)) FOR a IN [name, coalesce(name_zh, ''), upper(name)] IF trim(a) <> ''])), '|') AS aliases FROM entities")
def aliases(t: Tables) -> DataFrame:
    """Names of an entity, trimmed, in lower case, distinct and not empty."""
    names = F.array(F.col("name"), F.coalesce("name_zh", F.lit("")), F.upper("name"))
    clean = F.filter(F.transform(names, lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return t.entities.select("entity_id", F.array_join(F.array_sort(F.array_distinct(clean)), "|").alias("aliases"))


def alias_in_text(alias: str, text: Column) -> Column:
    """Whether alias stands in text with no letter or digit beside it."""
    return F.lower(text).rlike(rf"(?<![a-z0-9])\Q{alias.lower()}\E(?![a-z0-9])")


@operator("fn_10", "SELECT article_id, regexp_matches(lower(content), '(^|[^a-z0-9])est($|[^a-z0-9])') AS hit FROM texts")
def alias_hits(t: Tables, alias: str = "est") -> DataFrame:
    return t.texts.select("article_id", alias_in_text(alias, F.col("content")).alias("hit"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


@operator("fn_11", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def cosines(t: Tables, vec_id: int = 0) -> DataFrame:
    one = t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("other"))
    return t.embeddings.join(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def fold_threshold(hours: Column, same_day: float = 0.65, three_days: float = 0.85) -> Column:
    """Cosine that folding needs at a distance from a node's first report; null: never folds."""
    return F.when(hours <= 24, same_day).when(hours <= 72, three_days)


@operator("fn_12", "SELECT event_id, country_code, CASE WHEN h <= 24 THEN 0.65e0 WHEN h <= 72 THEN 0.85e0 END AS threshold FROM (SELECT f.event_id, f.country_code, (sec(f.published_at) - sec(e.origin_at)) / 3600.0e0 AS h FROM followers f JOIN agenda_events e USING (event_id)) x")
def fold_thresholds(t: Tables) -> DataFrame:
    both = t.followers.join(t.agenda_events.select("event_id", "origin_at"), "event_id")
    return both.select("event_id", "country_code", fold_threshold((F.unix_timestamp("published_at") - F.unix_timestamp("origin_at")) / 3600.0).alias("threshold"))


@operator("fn_13", "SELECT topic_id, round(size * (1 + ln(1 + size * 3)) / (1 + greatest((sec(:now) - sec(last_seen)) / 3600.0e0, 0.0e0)) * (2.0e0 / size), 6) AS score FROM topics")
def scores(t: Tables) -> DataFrame:
    from tidewatch.operators.aggregates import salience

    lag = (F.unix_timestamp(t.now) - F.unix_timestamp("last_seen")) / 3600.0
    return t.topics.select("topic_id", F.round(salience(F.col("size"), F.col("size") * 3, lag, F.lit(2.0)), 6).alias("score"))


@operator("fn_14", "SELECT article_id, greatest(sec(TIMESTAMP '2024-01-15') - sec(published_at), 0) * 1000 AS latency_ms, round((sec(:now) - sec(published_at)) / 60.0e0, 4) AS delay_min FROM articles")
def lags(t: Tables) -> DataFrame:
    at = F.unix_timestamp("published_at")
    clamped = F.greatest(F.unix_timestamp(F.lit("2024-01-15").cast("timestamp")) - at, F.lit(0)) * 1000
    return t.articles.select("article_id", clamped.alias("latency_ms"), F.round((F.unix_timestamp(t.now) - at) / 60.0, 4).alias("delay_min"))


@operator("fn_15", "SELECT article_id, sec(date_trunc('day', published_at)) AS day, sec(date_trunc('week', published_at)) AS week FROM articles")
def floors(t: Tables) -> DataFrame:
    return t.articles.select("article_id", F.unix_timestamp(F.date_trunc("day", "published_at")).alias("day"), F.unix_timestamp(F.date_trunc("week", "published_at")).alias("week"))


def growth(now: Column, before: Column) -> Column:
    """Growth in per cent; from nothing to something counts as 100."""
    return F.when(before > 0, (now - before) / before * 100.0).when(now > 0, 100.0).otherwise(0.0)


def growth_met(now: Column, before: Column, threshold: Column) -> Column:
    return F.when(before > 0, growth(now, before) >= threshold).otherwise((now > 0) & (threshold <= 100))


@operator("fn_16", """SELECT country_code, topic_id, round(CASE WHEN b > 0 THEN (n - b) * 100.0e0 / b WHEN n > 0 THEN 100.0e0 ELSE 0.0e0 END, 4) AS growth, CASE WHEN b > 0 THEN (n - b) * 100.0e0 / b >= 50 ELSE n > 0 END AS met, rank <= 5 AS top, coalesce(negative > 0.3, false) AS negative_met
    FROM (SELECT *, article_count AS n, article_count % 3 AS b FROM snapshots) x""")
def conditions(t: Tables) -> DataFrame:
    n, b = F.col("article_count"), F.col("article_count") % 3
    return t.snapshots.select("country_code", "topic_id", F.round(growth(n, b), 4).alias("growth"), growth_met(n, b, F.lit(50.0)).alias("met"), (F.col("rank") <= 5).alias("top"), F.coalesce(F.col("negative") > 0.3, F.lit(False)).alias("negative_met"))


def level_score(level: Column) -> Column:
    return F.when(level == "high", 0.9).when(level == "medium", 0.7).when(level == "low", 0.4).otherwise(0.5)


@operator("fn_17", "SELECT subject, object, article_id, CASE level WHEN 'high' THEN 0.9e0 WHEN 'medium' THEN 0.7e0 WHEN 'low' THEN 0.4e0 ELSE 0.5e0 END AS score FROM mentions")
def level_scores(t: Tables) -> DataFrame:
    return t.mentions.select("subject", "object", "article_id", level_score(F.col("level")).alias("score"))


@operator("fn_18", "SELECT article_id, contains(content, trim(substring(content, 20, 30))) AND trim(substring(content, 20, 30)) <> '' AS quoted, contains(content, 'no such quote') AS unquoted FROM texts")
def quotes(t: Tables) -> DataFrame:
    """Whether a quote, trimmed and not empty, stands in its source text."""
    inside = lambda q: F.contains("content", F.trim(q)) & (F.trim(q) != "")
    return t.texts.select("article_id", inside(F.substring("content", 20, 30)).alias("quoted"), inside(F.lit("no such quote")).alias("unquoted"))


@operator("fn_19", "SELECT event_id, article_id, sec(try_cast(occurred_at AS TIMESTAMP)) AS at_sec FROM revisions")
def iso_times(t: Tables) -> DataFrame:
    return t.revisions.select("event_id", "article_id", F.unix_timestamp(F.try_to_timestamp("occurred_at", F.lit("yyyy-MM-dd HH:mm:ss"))).alias("at_sec"))


@operator("fn_20", "SELECT article_id, length(substring(content, 1, 2 * 120)) AS n, length(content) > 2 * 120 AS cut FROM texts")
def budgeted(t: Tables, budget: int = 120) -> DataFrame:
    """Excerpt of a token budget, two characters a token, and whether it cuts."""
    return t.texts.select("article_id", F.char_length(F.substring("content", 1, 2 * budget)).alias("n"), (F.char_length("content") > 2 * budget).alias("cut"))


CONDITIONS = ("growth_rate", "top_n", "neg_ratio")


def extra_conditions(text: Column) -> Column:
    """(type, value) of a rule's further conditions: an object with "and", a bare list, or one object.

    Unknown types and items without a value are left out; what does not parse gives none.
    """
    one = "struct<type: string, value: double>"
    wrapped = F.from_json(text, "and array<struct<type: string, value: double>>")["and"]
    single = F.from_json(text, "type string, value double")
    items = F.coalesce(F.when(text.rlike(r"^\s*\["), F.from_json(text, f"array<{one}>")), wrapped, F.array(F.struct(single["type"].alias("type"), single["value"].alias("value"))))
    return F.filter(items, lambda x: x["type"].isin(*CONDITIONS) & x["value"].isNotNull())


@operator("fn_21", "SELECT event_id, kind AS type, value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'top_n' WHEN 1 THEN 'neg_ratio' WHEN 2 THEN 'growth_rate' END AS kind, CASE WHEN event_id % 4 = 1 THEN 0.5e0 ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS value FROM events) x WHERE kind IS NOT NULL")
def parsed(t: Tables) -> DataFrame:
    """Further conditions of rules written in each of the three shapes, and of broken ones."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit('{"and": [{"type": "top_n", "value": '), k, F.lit('}, {"type": "other", "value": 1}]}'))).when(kind == 1, '[{"type": "neg_ratio", "value": 0.5}, {"type": "top_n"}]').when(kind == 2, F.concat(F.lit('{"type": "growth_rate", "value": '), k, F.lit("}"))).otherwise("broken")
    return t.events.select("event_id", F.explode(extra_conditions(text)).alias("c")).select("event_id", "c.type", "c.value")


@operator("fn_22", r"SELECT event_id, CAST(json_extract(regexp_extract(concat('Sure: ', props, ' done'), '(?s)\{.*\}'), '$.k') AS INT) AS k FROM events")
def salvaged(t: Tables) -> DataFrame:
    """The object from the first brace to the last of a chatty answer."""
    answer = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    return t.events.select("event_id", F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "k int")["k"].alias("k"))


@operator("fn_23", "SELECT article_id, CASE WHEN relation IN ('ally', 'funds') THEN relation ELSE 'other' END AS relation FROM mentions")
def closed_labels(t: Tables, known: tuple[str, ...] = ("ally", "funds")) -> DataFrame:
    return t.mentions.select("article_id", F.when(F.col("relation").isin(*known), F.col("relation")).otherwise("other").alias("relation"))


_SHINGLES = "SELECT article_id, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) AS g FROM (SELECT article_id, regexp_extract_all(lower(content), '[a-z]+') AS w FROM texts) x WHERE len(w) >= 3"


@operator("fn_28", f"SELECT article_id, CAST(CAST('0x' || substring(md5(s), 1, 8) AS BIGINT) % 1024 AS INT) AS dim, count(*) AS n FROM (SELECT article_id, unnest(g) AS s FROM ({_SHINGLES}) y) z GROUP BY ALL")
def hashed_vectors(t: Tables, dimensions: int = 1024) -> DataFrame:
    """Sparse text vectors: counts of hashed word 3-shingles of the whole text, which travels instead of them."""
    w = t.texts.select("article_id", "content").repartition("article_id").select("article_id", F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    made = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    # explode and a filter on w would each have the words found once more
    shingles = w.select("article_id", F.explode_outer(F.when(F.size("w") >= 3, made)).alias("s")).where("s IS NOT NULL")
    dim = (F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    return shingles.groupBy("article_id", dim.alias("dim")).agg(F.count("*").alias("n"))


def is_wire(name: Column, media_type: Column) -> Column:
    return F.lower(F.trim(name)).isin(*WIRE_SERVICES) | (media_type == "agency")


@operator("fn_29", "SELECT source_id, media_type = 'agency' OR lower(trim(name)) IN (" + ", ".join(f"'{w}'" for w in WIRE_SERVICES) + ") AS wire FROM sources")
def wires(t: Tables) -> DataFrame:
    return t.sources.select("source_id", is_wire(F.col("name"), F.col("media_type")).alias("wire"))


@operator("fn_31", "SELECT alert_id, concat('[', r.condition, '] ', a.topic_id, ' reached ', CAST(CAST(r.threshold AS INT) AS VARCHAR)) AS line FROM alerts a JOIN rules r ON a.rule_id = r.rule_id")
def alert_lines(t: Tables) -> DataFrame:
    both = t.alerts.select("alert_id", "rule_id", "topic_id").join(t.rules.select("rule_id", "condition", "threshold"), "rule_id")
    return both.select("alert_id", F.format_string("[%s] %s reached %d", "condition", "topic_id", F.col("threshold").cast("int")).alias("line"))


@operator("fn_30", "SELECT entity_id, coalesce(nullif(name_zh, ''), name) AS translated FROM entities")
def translations(t: Tables) -> DataFrame:
    """Without a translator, the text itself passes through."""
    return t.entities.select("entity_id", display_name(F.col("name_zh"), F.col("name")).alias("translated"))


@operator("fn_32", "SELECT subscription_id, CASE WHEN d < 0 THEN 'expired' WHEN d <= 7 THEN 'week' WHEN d <= 30 THEN 'month' ELSE 'none' END AS band FROM (SELECT subscription_id, date_diff('day', DATE '2024-01-10', CAST(last_sent_at AS DATE)) AS d FROM subscriptions) x")
def reminder_bands(t: Tables, today: str = "2024-01-10") -> DataFrame:
    d = F.datediff(F.to_date("last_sent_at"), F.lit(today).cast("date"))
    return t.subscriptions.select("subscription_id", F.when(d < 0, "expired").when(d <= 7, "week").when(d <= 30, "month").otherwise("none").alias("band"))
