"""Trap cases for reports and exploration queries."""

import pytest

from postlens.model import QuerySpec
from postlens.plans import explore as X
from postlens.plans import reports as R
from tests.helpers import rows

COLS = ("entity string, year_month string, positive_sentiment double, negative_sentiment double, "
        "total_likes bigint, total_shares bigint, post_count bigint, redacted boolean, classified boolean")


def ent_t(spark, data):
    """data: (entity, ym, post_count[, pos, neg, redacted, classified])."""
    full = []
    for d in data:
        e, ym, n, *rest = d
        pos, neg, red, cls = (rest + [0.0, 0.0, False, True][len(rest):])
        full.append((e, ym, pos, neg, 0, 0, n, red, cls))
    return spark.createDataFrame(full, COLS)


MONTHS = [f"2013-{m:02d}" for m in range(1, 9)]


def test_constant_series_has_zero_slope_and_r2(spark):
    t = ent_t(spark, [("flat", m, 5) for m in MONTHS] + [("up", m, i) for i, m in enumerate(MONTHS)])
    got = {r.entity: (r.slope, r.r_squared) for r in R.entity_growth(t, k=5).collect()}
    assert got["flat"] == (0.0, 0.0)
    assert got["up"] == (1.0, 1.0)


def test_short_series_dropped(spark):
    t = ent_t(spark, [("one", "2013-01", 9)] + [("many", m, 1) for m in MONTHS])
    assert {r.entity for r in R.entity_growth(t).collect()} == {"many"}


def test_peak_tie_takes_earliest_month(spark):
    t = ent_t(spark, [("a", "2013-03", 4), ("a", "2013-01", 4), ("a", "2013-02", 1)])
    r = R.entity_spikiness(t).collect()[0]
    assert (r.peak_month, r.peak_count, r.total_posts) == ("2013-01", 4, 9)


def test_clean_filter_drops_buckets_and_redacted(spark):
    t = ent_t(spark, [("a", "2013-01", 5), ("Other", "2013-01", 50, 0.0, 0.0, False, False),
                      ("[REDACTED_abcdef]", "2013-01", 60, 0.0, 0.0, True, True)])
    assert rows(X.top_entity_names(t), "entity") == [("a",)]
    assert len(rows(X.top_entity_names(t, False, False), "entity")) == 3


def test_nonzero_mean_and_density_bins(spark):
    t = ent_t(spark, [("a", "2013-01", 1, 0.0, 0.0), ("a", "2013-02", 1, 0.5, 1.0),
                      ("a", "2013-03", 1, 1.0, 0.25)])
    spec = QuerySpec(entities=("a",))
    s = X.entity_summary(t, spec).collect()[0]
    assert (s.pos_sentiment, s.neg_sentiment, s.months) == (0.75, 0.625, 3)
    assert rows(X.sentiment_density(t, spec), "pos_bin", "neg_bin", "n") == [(2, 3, 1), (3, 1, 1)]


def test_month_timeseries_refuses_sentiment(spark):
    m = spark.createDataFrame([("2013-01", 1, 1, 1)],
                              "year_month string, total_likes long, total_shares long, post_count long")
    with pytest.raises(ValueError):
        X.month_timeseries(m, "positive_sentiment")


def test_query_spec_validation():
    s = QuerySpec(metric="bogus", filters=("classified", "nope"), scope="weird")
    assert (s.metric, s.filters, s.scope) == ("post_count", ("classified",), "selected")
    assert QuerySpec.clamp_indices(-5, 99, 10) == (0, 9)
    assert QuerySpec.clamp_indices(7, 3, 10) == (7, 7)
    assert QuerySpec.clamp_indices("x", 3, 10) == (0, 9)


def test_yearly_partial_year_scaled(spark):
    t = ent_t(spark, [("a", "2022-05", 3), ("a", "2023-01", 4)])
    got = rows(X.yearly_mentions(t, ["a"], {2023: 2}), "year", "year_label", "post_count")
    assert got == [(2022, "2022", 3), (2023, "2023 (Annualized)", 8)]


def test_calendar_gaps_statuses(spark):
    m = spark.createDataFrame([("2013-01", 0, 0, 100), ("2013-03", 0, 0, 2)],
                              "year_month string, total_likes long, total_shares long, post_count long")
    got = rows(R.calendar_gaps(m, "2013-01", "2013-04", near_empty=10), "year_month", "status")
    assert got == [("2013-01", "ok"), ("2013-02", "missing"), ("2013-03", "near_empty"),
                   ("2013-04", "missing")]
