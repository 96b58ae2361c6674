"""Lead-lag statistics between an origin's and its followers' daily series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.catalog import operator
from tidewatch.config import CONFIG
from tidewatch.operators.aggregates import daily_counts
from tidewatch.session import ship
from tidewatch.tables import Tables


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    keep = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / keep(1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation r over n points."""
    df = n - 2
    if df <= 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def f_p_value(f: float, d1: int, d2: int) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def correlate(x: np.ndarray, y: np.ndarray, most: int = CONFIG.xcorr_lag) -> tuple[int, float, float] | None:
    """(lag, r, p) of the strongest correlation of x with y lag days later; the smaller lag wins ties."""
    best = None
    for lag in range(min(most, len(x) - 3) + 1):
        a, b = x[: len(x) - lag], y[lag:]
        if np.ptp(a) == 0 or np.ptp(b) == 0:
            continue
        r = float(np.corrcoef(a, b)[0, 1])
        if best is None or abs(r) > abs(best[1]) + 1e-9:
            best = (lag, r, t_p_value(r, len(a)))
    return best


def granger(x: np.ndarray, y: np.ndarray, most: int = CONFIG.granger_lag) -> tuple[int, float, float] | None:
    """(lag, F, p) of the least p that x's past helps to predict y beyond y's own."""
    best = None
    if len(x) < 10:
        return None
    for lag in range(1, most + 1):
        n = len(y) - lag
        spare = n - 2 * lag - 1
        if spare <= 0:
            break
        past = lambda s, lag=lag, n=n: np.column_stack([s[lag - k : lag - k + n] for k in range(1, lag + 1)])
        own = np.column_stack([np.ones(n), past(y)])
        both = np.column_stack([own, past(x)])
        rest = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        if rest[0] <= 1e-9:
            continue  # its own past says all
        f = (rest[0] - rest[1]) / lag / (rest[1] / spare) if rest[1] > 1e-9 else math.inf
        p = f_p_value(f, lag, spare) if math.isfinite(f) else 0.0
        if best is None or p < best[2]:
            best = (lag, f, p)
    return best


def qap(x: np.ndarray, y: np.ndarray, permutations: int = CONFIG.permutations, seed: int = 42) -> tuple[float, float] | None:
    """(r, p): the strongest correlation over lags 0-7, with its sign, against that of permuted x."""

    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return None

    def strongest(rows: np.ndarray) -> np.ndarray:
        """The correlation of largest size over all lags of every row."""
        best = np.zeros(len(rows))
        for lag in range(min(CONFIG.granger_lag, len(y) - 3) + 1):
            a, b = rows[:, : len(y) - lag], y[lag:]
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean()
            norm = np.sqrt((a**2).sum(axis=1) * (b**2).sum())
            r = np.divide(a @ b, norm, out=np.zeros(len(rows)), where=norm > 0)
            best = np.where(np.abs(r) > np.abs(best) + 1e-9, r, best)
        return best

    rng = np.random.default_rng(seed)
    own = float(strongest(x[None, :])[0])
    hits = int((np.abs(strongest(np.array([rng.permutation(x) for _ in range(permutations)]))) >= abs(own) - 1e-12).sum())
    return own, (hits + 1) / (permutations + 1)


def series(t: Tables) -> DataFrame:
    """Daily counts by kind and country over the window of statistics."""
    return daily_counts(t.articles, ["kind", "country_code"], "2024-01-01", CONFIG.stats_days)


_DAYS = "SELECT k.kind, k.country_code, d.day, count(a.article_id) AS n FROM (SELECT DISTINCT kind, country_code FROM articles) k CROSS JOIN (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN articles a ON a.kind = k.kind AND a.country_code = k.country_code AND CAST(a.published_at AS DATE) = d.day GROUP BY ALL"
_LAGS = f"""SELECT kind, country_code, lag, round(corr(x, y), 6) AS r FROM (SELECT f.kind, f.country_code, l.lag, o.n AS x, f.n AS y FROM ({_DAYS}) f CROSS JOIN (SELECT unnest(range(15)) AS lag) l JOIN ({_DAYS}) o ON o.kind = f.kind AND o.country_code = 'C0' AND o.day = f.day - CAST(l.lag AS INTEGER) WHERE f.country_code <> 'C0') z GROUP BY ALL"""
_BEST = f"SELECT kind, country_code, CAST(lag AS INTEGER) AS lag, r FROM ({_LAGS}) y QUALIFY row_number() OVER (PARTITION BY kind, country_code ORDER BY abs(r) DESC, lag) = 1"


def lagged_correlations(t: Tables, origin: str = "C0", most: int = CONFIG.xcorr_lag) -> DataFrame:
    """Strongest lagged correlation of the origin country with every other, all in one aggregation."""
    rows = series(t)
    o = rows.where(F.col("country_code") == origin).select("kind", F.col("day").alias("origin_day"), F.col("n").alias("x"))
    f = rows.where(F.col("country_code") != origin).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("origin_day", F.date_sub("day", F.col("lag")))
    r = f.join(o, ["kind", "origin_day"]).groupBy("kind", "country_code", "lag").agg(F.round(F.corr("x", "n"), 6).alias("r"))
    best = F.row_number().over(W.partitionBy("kind", "country_code").orderBy(F.desc(F.abs("r")), "lag"))
    return r.withColumn("_n", best).where("_n = 1").select("kind", "country_code", "lag", "r")


operator("sta_01", _BEST)(lagged_correlations)


@operator("sta_02", f"SELECT kind, round(avg(abs(r)) * sign(arg_max(r, (abs(r), country_code))), 6) AS r, arg_max(lag, (abs(r), country_code)) AS lag FROM ({_BEST}) b GROUP BY kind")
def combined_correlation(t: Tables) -> DataFrame:
    """Mean strength over followers, signed and dated by the strongest."""
    b = lagged_correlations(t)
    key = F.struct(F.abs("r").alias("a"), "country_code")
    return b.groupBy("kind").agg(F.round(F.avg(F.abs("r")) * F.signum(F.max_by("r", key)), 6).alias("r"), F.max_by("lag", key).alias("lag"))


EVIDENCE = "kind string, country_code string, xcorr_lag int, xcorr_r double, xcorr_p double, granger_lag int, granger_f double, granger_p double, reason string"


def _evidence(pdf: pd.DataFrame) -> pd.DataFrame:
    """Both tests for one follower; what cannot be tested is null and gives a reason."""
    pdf = pdf.sort_values("day")
    row: dict = {"kind": pdf["kind"].iloc[0], "country_code": pdf["country_code"].iloc[0], "reason": ""}
    x, y = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
    reasons = []
    for name, test, fields in (("xcorr", correlate, ("lag", "r", "p")), ("granger", granger, ("lag", "f", "p"))):
        try:
            found = test(x, y)
        except Exception as e:  # one series that fails must not fail the others
            found, reason = None, f"{name}: {type(e).__name__}"
        else:
            reason = f"{name}: constant or too short"
        if found is None:
            reasons.append(reason)
        row |= {f"{name}_{f}": v for f, v in zip(fields, found or [None] * len(fields), strict=True)}
    row["reason"] = "; ".join(reasons)
    return pd.DataFrame([row])[[c.split()[0] for c in EVIDENCE.split(", ")]]


def evidence(t: Tables, origin: str = "C0", least: int = CONFIG.stats_least_articles) -> DataFrame:
    """Correlation and Granger tests of the origin country against each other one.

    A group is one follower's calendar: as many rows as days. Kinds with fewer articles than least
    are not tested.
    """
    ship(t.spark)
    o, followers = _tested(t, origin, least)
    return followers.join(o, ["kind", "day"]).groupBy("kind", "country_code").applyInPandas(_evidence, EVIDENCE)


def _tested(t: Tables, origin: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Daily counts of the origin (kind, day, x) and of all others (kind, country_code, day, n), for kinds with enough articles."""
    enough = t.articles.groupBy("kind").agg(F.count("*").alias("total")).where(F.col("total") >= least).select("kind")
    rows = series(t).join(enough, "kind")
    return rows.where(F.col("country_code") == origin).select("kind", "day", F.col("n").alias("x")), rows.where(F.col("country_code") != origin)


QAP = "kind string, qap_r double, qap_p double"


def _permuted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("day")
    found = qap(pdf["x"].to_numpy(float), pdf["mean"].to_numpy(float)) or (None, None)
    return pd.DataFrame([(pdf["kind"].iloc[0], *found)], columns=["kind", "qap_r", "qap_p"])


def mean_follower_test(t: Tables, origin: str = "C0", least: int = CONFIG.stats_least_articles) -> DataFrame:
    """One row a kind: the origin's daily counts against the mean of all followers' series.

    Days of the origin are permuted, which keeps its total; a constant series gives nulls.
    """
    ship(t.spark)
    o, followers = _tested(t, origin, least)
    mean = followers.groupBy("kind", "day").agg(F.avg("n").alias("mean"))
    return mean.join(o, ["kind", "day"]).groupBy("kind").applyInPandas(_permuted, QAP)


@operator("sta_03")
def granger_tests(t: Tables) -> DataFrame:
    return evidence(t).select("kind", "country_code", "granger_lag", "granger_f", "granger_p")


@operator("sta_04")
def permutation_tests(t: Tables) -> DataFrame:
    return mean_follower_test(t)


@operator("sta_05", "SELECT topic_id, size, size < 100 AS insufficient FROM topics")
def statistics_gate(t: Tables, least: int = CONFIG.stats_least_articles) -> DataFrame:
    return t.topics.select("topic_id", "size", (F.col("size") < least).alias("insufficient"))
