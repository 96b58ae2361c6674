"""All tunable values of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # echo folding: cosine needed within one and within three days of a node's first report
    echo_same_day: float = 0.65
    echo_three_days: float = 0.85
    lookback_days: int = 7
    archive_days: int = 7
    confirmed_size: int = 10
    # merging topics
    merge_cosine: float = 0.62
    merge_days: int = 30
    merge_batch: int = 200
    # revision storm: more than so many machine edits within so many hours
    storm_edits: int = 5
    storm_hours: int = 24
    blacklist_size: int = 50
    blacklist_days: int = 30
    wire_boost_hours: float = 0.5
    follower_days: int = 14
    follower_countries: int = 3
    # statistics
    stats_least_articles: int = 100
    stats_days: int = 30
    xcorr_lag: int = 14
    granger_lag: int = 7
    permutations: int = 1000
    alpha: float = 0.05
    snapshot_hours: int = 24
    snapshot_countries: int = 120
    detection_batch: int = 200
    # online clustering
    topic_cosine: float = 0.85
    duplicate_cosine: float = 0.95
    half_life_hours: float = 24.0
    agglomerative_cut: float = 0.25
    keywords: int = 20
    pool_hours: int = 48
    recluster_hours: int = 24
    keyword_overlap: int = 2
    largest_share_alarm: float = 0.4
    singleton_alarm: float = 0.3
    # entity relations
    relation_decay_days: float = 14.0
    relation_expired: float = 0.2
    relation_items: int = 5
    # alerts
    debounce_minutes: int = 60
    alert_storm: int = 20
    # sources: failures to degrade, successes to recover, hours to fail
    degrade_after: int = 3
    recover_after: int = 2
    fail_hours: int = 168
    health_history: int = 20


CONFIG = Config()

#: Names of wire services, lower case.
WIRE_SERVICES = ("ap", "associated press", "reuters", "afp", "agence france-presse", "xinhua", "tass", "efe", "dpa", "ansa", "kyodo news", "yonhap", "pti", "anadolu agency")
