"""Exploration queries over the built tables (Q12-Q30).

These are the dashboard's questions as DataFrame functions: filter (entity
set, month range, flags), group, aggregate, rank.  Entity lists the user
picks are small literals (``isin``); lists derived from the data are top-K
frames of a parameter size, broadcast into a semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.columns import (clean_filter, metric_agg, month_range, net_sentiment,
                                        nonzero_mean)
from postlens.model import SENTIMENT_METRICS, QuerySpec
from postlens.operators.ranking import keep_top_groups, top_and_bottom, top_k
from postlens.plans.reports import ROUND, _clean_top, month_index_days

ALL_LABEL = "All entities"
ANNUALIZED = "{year} (Annualized)"


def _totals(t: DataFrame) -> DataFrame:
    return t.groupBy("entity").agg(F.sum("post_count").alias("post_count"))


def top_entity_names(t: DataFrame, classified_only=True, exclude_redacted=True,
                     cap: int | None = 200) -> DataFrame:
    """Q12: names by total posts (desc, name asc), capped or not."""
    tot = _totals(t.filter(clean_filter(classified_only, exclude_redacted)))
    order = [F.col("post_count").desc(), F.col("entity").asc()]
    return top_k(tot, order, cap) if cap else tot.orderBy(*order)


def entity_names_by_filter(t: DataFrame) -> DataFrame:
    """Q12 (all four flag combinations, uncapped) from one aggregation.

    ``classified``/``redacted`` are functions of the name, so one
    ``groupBy(entity, flags)`` serves every combination.
    """
    base = t.groupBy("entity", "classified", "redacted").agg(F.sum("post_count").alias("post_count"))
    parts = []
    for c in (False, True):
        for r in (False, True):
            parts.append(base.filter(clean_filter(c, r)).select(
                F.lit(c).alias("classified_only"), F.lit(r).alias("exclude_redacted"),
                "entity", "post_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_entities(t: DataFrame, needle: str, classified_only=True, exclude_redacted=True,
                    cap: int = 200) -> DataFrame:
    """Q13: literal, case-insensitive substring search; ranked by total, capped."""
    tot = _totals(t.filter(clean_filter(classified_only, exclude_redacted)))
    hit = tot.filter(F.lower("entity").contains(needle.lower()))
    return top_k(hit, [F.col("post_count").desc(), F.col("entity").asc()], cap)


def keyword_group(t: DataFrame, groups: dict) -> DataFrame:
    """Q14: per label, names whose lower-cased text matches the keyword regex (no flags)."""
    tot = _totals(t)
    out = None
    for label, kw in groups.items():
        part = tot.filter(F.lower("entity").rlike(kw)).select(F.lit(label).alias("label"), "entity",
                                                               "post_count")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("label", F.col("post_count").desc(), "entity")


def yearly_mentions(t: DataFrame, names, partial: dict | None = None) -> DataFrame:
    """Q15: posts per (entity, year); partial years scaled and relabelled."""
    partial = partial or {}
    y = (t.filter(clean_filter() & F.col("entity").isin(*names))
         .withColumn("year", F.substring("year_month", 1, 4).cast("int"))
         .groupBy("entity", "year").agg(F.sum("post_count").alias("post_count")))
    factor = F.lit(1)
    label = F.col("year").cast("string")
    for yr, f in partial.items():
        factor = F.when(F.col("year") == yr, F.lit(f)).otherwise(factor)
        label = F.when(F.col("year") == yr, F.lit(ANNUALIZED.format(year=yr))).otherwise(label)
    return y.select("entity", "year", label.alias("year_label"),
                    (F.col("post_count") * factor).cast("bigint").alias("post_count"))


def entity_timeline(t: DataFrame, name: str) -> DataFrame:
    """Q16: one entity's monthly posts, chronological."""
    return (t.filter(clean_filter() & (F.col("entity") == name))
            .select("year_month", "post_count").orderBy("year_month"))


def volume_and_net_sentiment(t: DataFrame, name: str) -> DataFrame:
    """Q17: one entity's monthly posts and net sentiment."""
    return (t.filter(clean_filter() & (F.col("entity") == name))
            .select("year_month", "post_count", net_sentiment().alias("net_sentiment"))
            .orderBy("year_month"))


def net_sentiment_ranking(t: DataFrame, top: int = 200, k: int = 10) -> DataFrame:
    """Q18: post-weighted net sentiment of the top entities; k lowest and k highest.

    The reference takes head/tail of an ascending sort; ties are pinned on
    the name, so the high side is ``net desc, entity desc``.
    """
    s = _clean_top(t, top).groupBy("entity").agg(
        F.sum(net_sentiment() * F.col("post_count")).alias("_w"),
        F.sum("post_count").alias("total"))
    s = s.select("entity", F.bround(F.col("_w") / F.col("total"), ROUND).alias("net"), "total")
    low = top_k(s, [F.col("net").asc(), F.col("entity").asc()], k)
    high = top_k(s, [F.col("net").desc(), F.col("entity").desc()], k)
    return (low.select(F.lit("negative").alias("side"), "entity", "net", "total")
            .unionByName(high.select(F.lit("positive").alias("side"), "entity", "net", "total")))


def normalized_growth(t: DataFrame, top: int = 500, min_n: int = 6, k: int = 15) -> DataFrame:
    """Q19: slope of posts / entity mean against days, annualised (×365)."""
    sub = month_index_days(_clean_top(t, top))
    w = Window.partitionBy("entity")     # one entity's months: calendar-bounded
    sub = sub.withColumn("y_norm", F.try_divide(F.col("post_count").cast("double"),
                                                F.avg("post_count").over(w)))
    g = sub.groupBy("entity").agg(
        F.regr_slope("y_norm", "month_num").alias("_s"),
        F.var_pop("month_num").alias("_vx"),
        F.count("post_count").alias("n"))
    g = g.filter((F.col("_vx") > 0) & (F.col("n") >= min_n)).select(
        "entity", F.bround(F.col("_s") * 365, ROUND).alias("slope"), "n")
    out = top_and_bottom(g, "slope", k, high_label="growing", low_label="declining")
    return out.select("side", "entity", "slope", "n")


def filter_entities(t: DataFrame, names, lo=None, hi=None, classified_only=True,
                    exclude_redacted=True) -> DataFrame:
    """Q20 (P8): entity set + inclusive month range + optional flags."""
    return t.filter(F.col("entity").isin(*names) & month_range(lo, hi)
                    & clean_filter(classified_only, exclude_redacted))


def all_entities(t: DataFrame, lo=None, hi=None, classified_only=True, exclude_redacted=True,
                 cap: int = 200) -> DataFrame:
    """Q21: rows of the ``cap`` largest entities *within* the filtered range."""
    sub = t.filter(month_range(lo, hi) & clean_filter(classified_only, exclude_redacted))
    return keep_top_groups(sub, "entity", "post_count", cap)


def scoped(t: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.scope == "all":
        return all_entities(t, spec.lo, spec.hi, spec.classified_only, spec.exclude_redacted, spec.cap)
    return filter_entities(t, spec.entities, spec.lo, spec.hi, spec.classified_only,
                           spec.exclude_redacted)


def metric_timeseries(t: DataFrame, spec: QuerySpec) -> DataFrame:
    """Q22: metric per (month, entity); scope "all" is one unweighted series."""
    sub = scoped(t, spec)
    if spec.scope == "all":
        g = sub.groupBy("year_month").agg(metric_agg(spec.metric).alias("value"))
        g = g.withColumn("entity", F.lit(ALL_LABEL))
    else:
        g = sub.groupBy("year_month", "entity").agg(metric_agg(spec.metric).alias("value"))
    return g.select("year_month", "entity", F.bround("value", ROUND).alias("value")).orderBy("year_month", "entity")


def metric_ranking(t: DataFrame, spec: QuerySpec) -> DataFrame:
    """Q23: metric per entity, ascending (bar order)."""
    g = scoped(t, spec).groupBy("entity").agg(metric_agg(spec.metric).alias("value"))
    return g.select("entity", F.bround("value", ROUND).alias("value")).orderBy("value", "entity")


def _space(sub: DataFrame) -> DataFrame:
    return sub.groupBy("entity", "year_month").agg(
        F.sum("post_count").alias("post_count"),
        F.sum("total_likes").alias("total_likes"),
        F.sum("total_shares").alias("total_shares"),
        F.bround(nonzero_mean("positive_sentiment"), ROUND).alias("positive_sentiment"),
        F.bround(nonzero_mean("negative_sentiment"), ROUND).alias("negative_sentiment"))


def sentiment_space(t: DataFrame, spec: QuerySpec) -> DataFrame:
    """Q24: per (entity, month) sums and nonzero-mean sentiments."""
    return _space(scoped(t, spec))


def entity_summary(t: DataFrame, spec: QuerySpec) -> DataFrame:
    """Q25: months present, sums and nonzero-mean sentiments per entity."""
    return scoped(t, spec).groupBy("entity").agg(
        F.countDistinct("year_month").alias("months"),
        F.sum("post_count").alias("posts"),
        F.sum("total_likes").alias("likes"),
        F.sum("total_shares").alias("shares"),
        F.bround(nonzero_mean("positive_sentiment"), ROUND).alias("pos_sentiment"),
        F.bround(nonzero_mean("negative_sentiment"), ROUND).alias("neg_sentiment"))


def sentiment_density(t: DataFrame, spec: QuerySpec, bins: int = 4) -> DataFrame:
    """Q26: bins×bins counts of rows with any signal; fixed 1/bins-wide bins on [0,1]."""
    sub = scoped(t, spec).filter((F.col("positive_sentiment") > 0) | (F.col("negative_sentiment") > 0))
    b = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return sub.groupBy(b("positive_sentiment").alias("pos_bin"),
                       b("negative_sentiment").alias("neg_bin")).agg(F.count(F.lit(1)).alias("n"))


def month_timeseries(month_t: DataFrame, metric: str, lo=None, hi=None) -> DataFrame:
    """Q27: corpus-level monthly metric; the month table has no sentiment."""
    if metric in SENTIMENT_METRICS:
        raise ValueError("Sentiment metrics are not available in the month table")
    return (month_t.filter(month_range(lo, hi))
            .select("year_month", F.col(metric).cast("double").alias("value")).orderBy("year_month"))


def redacted_share(date_t: DataFrame, lo=None, hi=None) -> DataFrame:
    """Q28: % of each month's posts on redacted vs other rows."""
    g = (date_t.filter(month_range(lo, hi)).groupBy("year_month", "redacted")
         .agg(F.sum("post_count").alias("post_count")))
    w = Window.partitionBy("year_month")      # ≤ 2 rows per month
    g = g.withColumn("month_total", F.sum("post_count").over(w))
    return g.select("year_month", "redacted", "post_count", "month_total",
                    (F.col("post_count") / F.col("month_total") * 100).alias("pct")).orderBy("year_month", "redacted")


def _group_rows(t: DataFrame, groups: dict, lo, hi, exclude_redacted: bool) -> DataFrame:
    """Rows of the keyword groups' names; the classified filter is *not* applied."""
    match = None
    for kw in groups.values():
        m = F.lower("entity").rlike(kw)
        match = m if match is None else (match | m)
    return t.filter(match & month_range(lo, hi) & clean_filter(False, exclude_redacted))


def group_comparison_snapshot(t: DataFrame, groups: dict, lo=None, hi=None,
                              exclude_redacted: bool = True) -> DataFrame:
    """Q29: the groups' (entity, month) summary in the last month of the range."""
    s = _space(_group_rows(t, groups, lo, hi, exclude_redacted))
    last = s.select(F.max("year_month")).scalar()
    return s.filter(F.col("year_month") == last)


def group_comparison_frames(t: DataFrame, groups: dict, lo=None, hi=None,
                            exclude_redacted: bool = True) -> DataFrame:
    """Q30 re-aimed: every month's frame, sparse (no entity × month grid densify)."""
    return _space(_group_rows(t, groups, lo, hi, exclude_redacted))


def month_bounds(t: DataFrame, lo_idx, hi_idx):
    """Slider indices -> inclusive month labels, clamped like the reference.

    ``lo`` is clamped into [0, n-1] and ``hi`` into [lo, n-1] over the
    table's sorted distinct months; both labels are scalar subqueries, so
    the filter stays one plan (no driver round trip).  The month axis is a
    calendar-sized frame, so its single ordering is bounded.  A range that is
    not two numbers means all months.
    """
    try:
        lo_idx, hi_idx = int(lo_idx), int(hi_idx)
    except (TypeError, ValueError):
        lo_idx, hi_idx = 0, (1 << 31) - 1
    months = t.select("year_month").distinct()
    n = months.select(F.count(F.lit(1))).scalar()
    idx = months.select("year_month", (F.dense_rank().over(Window.orderBy("year_month")) - 1).alias("i"))
    lo = F.least(F.greatest(F.lit(lo_idx), F.lit(0)), n - 1)
    hi = F.greatest(lo, F.least(F.lit(hi_idx), n - 1))
    lo_m = idx.filter(F.col("i") == lo).select("year_month").scalar()
    hi_m = idx.filter(F.col("i") == hi).select("year_month").scalar()
    return lo_m, hi_m


def filter_entities_by_index(t: DataFrame, names, lo_idx, hi_idx, classified_only=True,
                             exclude_redacted=True) -> DataFrame:
    """Q20 with the dashboard's index range (P17 clamp)."""
    lo_m, hi_m = month_bounds(t, lo_idx, hi_idx)
    return t.filter(F.col("entity").isin(*names) & (F.col("year_month") >= lo_m)
                    & (F.col("year_month") <= hi_m) & clean_filter(classified_only, exclude_redacted))


def entity_summary_display(t: DataFrame, spec: QuerySpec) -> DataFrame:
    """Q25 as shown: counts with thousands separators, sentiments to 3 decimals.

    A presentation projection on top of ``entity_summary``; ``posts`` is kept
    numeric for ordering.
    """
    s = entity_summary(t, spec)
    return s.select(
        "entity", "posts",
        F.format_number("months", 0).alias("months_fmt"),
        F.format_number("posts", 0).alias("posts_fmt"),
        F.format_number("likes", 0).alias("likes_fmt"),
        F.format_number("shares", 0).alias("shares_fmt"),
        F.format_number("pos_sentiment", 3).alias("pos_fmt"),
        F.format_number("neg_sentiment", 3).alias("neg_fmt"))
