"""Data model: schemas, sentinels and the validated query spec."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values shared with the reference behaviour: bucket labels, metric
# names and the filter names understood by the exploration queries.
OTHER = "Other"
NONE = "None"
SENTINELS = (OTHER, NONE)
COUNT_METRICS = ("post_count", "total_likes", "total_shares")
SENTIMENT_METRICS = ("positive_sentiment", "negative_sentiment")
METRICS = COUNT_METRICS + SENTIMENT_METRICS
FILTERS = ("classified", "redacted")
SCOPES = ("selected", "all")

TWEETS_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),   # wall clock, no zone
    T.StructField("user_id", T.StringType()),
    T.StructField("likes", T.IntegerType()),
    T.StructField("shares", T.IntegerType()),
    T.StructField("positive_emotion", T.FloatType()),
    T.StructField("negative_emotion", T.FloatType()),
])
ENTITIES_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("detected_as", T.StringType()),
    T.StructField("matched_uri", T.StringType()),
    T.StructField("confidence", T.FloatType()),
])
MENTIONS_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("username", T.StringType()),
])

MONTH_COLUMNS = ["year_month", "total_likes", "total_shares", "post_count"]
DATE_COLUMNS = ["year_month", "positive_sentiment", "negative_sentiment", "entity",
                "total_likes", "total_shares", "post_count", "redacted", "classified"]
ENTITY_COLUMNS = ["entity", "year_month", "positive_sentiment", "negative_sentiment",
                  "total_likes", "total_shares", "post_count", "redacted", "classified"]


@dataclass(frozen=True)
class QuerySpec:
    """User-facing query state of the exploration queries (Q20-Q28).

    ``lo``/``hi`` are month labels ``YYYY-MM`` (inclusive) or ``None`` for the
    open end.  Unknown metric/scope fall back to defaults and unknown filters
    are dropped, as the reference's URL validation does; ``clamp_indices``
    clamps a slider-style index range against the month axis.
    """

    entities: tuple = ()
    metric: str = "post_count"
    lo: str | None = None
    hi: str | None = None
    filters: tuple = FILTERS
    scope: str = "selected"
    cap: int = 200
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "entities", tuple(self.entities or ()))
        if self.metric not in METRICS:
            object.__setattr__(self, "metric", "post_count")
        object.__setattr__(self, "filters", tuple(f for f in (self.filters or ()) if f in FILTERS))
        if self.scope not in SCOPES:
            object.__setattr__(self, "scope", "selected")

    @property
    def classified_only(self) -> bool:
        return "classified" in self.filters

    @property
    def exclude_redacted(self) -> bool:
        return "redacted" in self.filters

    @staticmethod
    def clamp_indices(lo, hi, n_months: int) -> tuple[int, int]:
        """Index clamp: ``lo`` into [0, n-1], ``hi`` into [lo, n-1]; bad → full."""
        try:
            lo_i, hi_i = int(lo), int(hi)
        except (TypeError, ValueError):
            return 0, max(n_months - 1, 0)
        lo_i = min(max(lo_i, 0), max(n_months - 1, 0))
        hi_i = max(lo_i, min(hi_i, n_months - 1))
        return lo_i, hi_i
