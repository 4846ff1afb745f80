"""Report queries over the built tables (Q06-Q11).

Each is one DataFrame plan: filters and top-K lists are pushed before the
per-group work, per-entity loops of the reference become ``groupBy``.
Ties the reference leaves to sort stability are pinned (name/month asc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.columns import clean_filter, month_start
from postlens.operators.ranking import top_and_bottom, top_groups, top_k

# The corpus anomalies the volume report annotates.
GAP_MONTHS = ("2017-12", "2018-01", "2018-02", "2018-03")
MISSING_MONTHS = ("2013-03", "2021-05")
GAP_NOTE = "<-- KNOWN DATA GAP (near-zero)"
MISSING_NOTE = "<-- MISSING (corrupted gzip)"

ROUND = 6  # decimals kept (half-even) for values summed in floating point


def monthly_volume(date_t: DataFrame, gap_months=GAP_MONTHS,
                   missing_months=MISSING_MONTHS) -> DataFrame:
    """Q06: posts per month over all rows (classified or not) with notes."""
    m = date_t.groupBy("year_month").agg(F.sum("post_count").alias("post_count"))
    note = (F.when(F.col("year_month").isin(*gap_months), F.lit(GAP_NOTE))
            .when(F.col("year_month").isin(*missing_months), F.lit(MISSING_NOTE))
            .otherwise(F.lit("")))
    return m.select("year_month", "post_count", note.alias("note")).orderBy("year_month")


def monthly_volume_summary(date_t: DataFrame) -> DataFrame:
    """Q06 summary: months, total, interpolated median, earliest peak month."""
    m = date_t.groupBy("year_month").agg(F.sum("post_count").alias("post_count"))
    return m.agg(
        F.count(F.lit(1)).alias("n_months"),
        F.sum("post_count").alias("total_posts"),
        F.median("post_count").cast("double").alias("median_posts"),
        F.min_by("year_month", F.struct(-F.col("post_count"), F.col("year_month"))).alias("peak_month"),
        F.max("post_count").alias("peak_posts"))


def calendar_gaps(month_t: DataFrame, start: str, end: str, near_empty=None,
                  near_empty_frac: float = 0.1) -> DataFrame:
    """Q07: expected months vs present vs near-empty (threshold, not a list).

    ``near_empty`` is an absolute post count; when ``None`` it is
    ``near_empty_frac`` × the median month (a scalar subquery), so the rule
    holds at any corpus size.
    """
    if near_empty is None:
        near_empty = month_t.select(F.median("post_count") * near_empty_frac).scalar()
    else:
        near_empty = F.lit(near_empty)
    cal = (month_t.sparkSession.range(1)
           .select(F.explode(F.sequence(F.to_date(F.lit(start + "-01")),
                                        F.to_date(F.lit(end + "-01")),
                                        F.expr("INTERVAL 1 MONTH"))).alias("d"))
           .select(F.date_format("d", "yyyy-MM").alias("year_month")))
    present = month_t.select("year_month", "post_count")
    j = cal.join(present, "year_month", "left")
    status = (F.when(F.col("post_count").isNull(), F.lit("missing"))
              .when(F.col("post_count") < near_empty, F.lit("near_empty"))
              .otherwise(F.lit("ok")))
    return j.select("year_month", F.coalesce("post_count", F.lit(0)).cast("bigint").alias("post_count"),
                    status.alias("status"))


def _weighted_means(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.sum("post_count").alias("total_posts"),
        F.sum(F.col("positive_sentiment").cast("double") * F.col("post_count")).alias("_pw"),
        F.sum(F.col("negative_sentiment").cast("double") * F.col("post_count")).alias("_nw"))


def sentiment_trend(date_t: DataFrame, k: int = 10) -> DataFrame:
    """Q08: best/worst k months by post-weighted sentiment (clean rows)."""
    m = _weighted_means(date_t.filter(clean_filter()), "year_month").select(
        "year_month", "total_posts",
        (F.col("_pw") / F.col("total_posts")).alias("avg_positive"),
        (F.col("_nw") / F.col("total_posts")).alias("avg_negative"))
    m = m.withColumn("sentiment_net", F.col("avg_positive") - F.col("avg_negative"))
    pos = top_k(m, [F.col("avg_positive").desc(), "year_month"], k)
    neg = top_k(m, [F.col("avg_negative").desc(), "year_month"], k)
    cols = ["year_month", "avg_positive", "avg_negative", "sentiment_net", "total_posts"]
    return (pos.select(F.lit("positive").alias("side"), *cols)
            .unionByName(neg.select(F.lit("negative").alias("side"), *cols)))


def _clean_top(entity_t: DataFrame, top: int) -> DataFrame:
    """P7 + T2 + J5: clean rows of the ``top`` entities, with their total."""
    clean = entity_t.filter(clean_filter())
    tops = top_groups(clean, "entity", "post_count", top)          # ≤ top rows
    return clean.join(F.broadcast(tops), "entity")


def entity_spikiness(entity_t: DataFrame, top: int = 50, k: int = 20) -> DataFrame:
    """Q09: peak-month share of lifetime posts; earliest month wins a peak tie."""
    s = _clean_top(entity_t, top).groupBy("entity").agg(
        F.sum("post_count").alias("total_posts"),
        F.min_by("year_month", F.struct(-F.col("post_count"), F.col("year_month"))).alias("peak_month"),
        F.max("post_count").alias("peak_count"))
    s = s.withColumn("spikiness", F.coalesce(
        F.try_divide(F.col("peak_count").cast("double"), F.col("total_posts").cast("double")), F.lit(0.0)))
    return top_k(s, [F.col("spikiness").desc(), "entity"], k)


def entity_growth(entity_t: DataFrame, top: int = 200, min_months: int = 6, k: int = 20) -> DataFrame:
    """Q10: OLS slope and R² of monthly posts on a dense month index.

    The month index is a ``dense_rank`` over the subset's distinct months —
    one row per calendar month, so its single sort is calendar-sized — and
    is broadcast back.  Guards follow the reference: slope = R² = 0 when the
    index is constant, R² = 0 when the counts are constant.
    """
    sub = _clean_top(entity_t, top)
    months = sub.select("year_month").distinct()
    midx = months.select("year_month",
                         (F.dense_rank().over(Window.orderBy("year_month")) - 1).alias("month_idx"))
    g = (sub.join(F.broadcast(midx), "year_month").groupBy("entity").agg(
        F.max("_total").alias("total_posts"),
        F.count(F.lit(1)).alias("n_months"),
        F.regr_slope("post_count", "month_idx").alias("_s"),
        F.regr_r2("post_count", "month_idx").alias("_r2"),
        F.var_pop("post_count").alias("_vy"),
        F.var_pop("month_idx").alias("_vx"))
        .filter(F.col("n_months") >= min_months))
    res = g.select(
        "entity", "total_posts", "n_months",
        F.bround(F.when(F.col("_vx") == 0, 0.0).otherwise(F.col("_s")), ROUND).alias("slope"),
        F.bround(F.when((F.col("_vx") == 0) | (F.col("_vy") == 0), 0.0).otherwise(F.col("_r2")),
                ROUND).alias("r_squared"))
    out = top_and_bottom(res, "slope", k, high_label="growing", low_label="declining")
    return out.select("side", "entity", "total_posts", "slope", "r_squared", "n_months")


def entity_sentiment(entity_t: DataFrame, top: int = 100, k: int = 10) -> DataFrame:
    """Q11: post-weighted sentiment of the top entities; k most positive/negative."""
    e = _weighted_means(_clean_top(entity_t, top), "entity")
    e = e.select("entity", "total_posts",
                 F.bround(F.col("_pw") / F.col("total_posts"), ROUND).alias("avg_positive"),
                 F.bround(F.col("_nw") / F.col("total_posts"), ROUND).alias("avg_negative"),
                 F.bround((F.col("_pw") - F.col("_nw")) / F.col("total_posts"), ROUND).alias("sentiment_net"))
    pos = top_k(e, [F.col("avg_positive").desc(), "entity"], k)
    neg = top_k(e, [F.col("avg_negative").desc(), "entity"], k)
    return (pos.select(F.lit("positive").alias("side"), "*")
            .unionByName(neg.select(F.lit("negative").alias("side"), "*")))


def month_index_days(df: DataFrame) -> DataFrame:
    """Days since the first month of ``df`` (Q19 x axis), via a scalar subquery."""
    first = df.select(F.min(month_start())).scalar()
    return df.withColumn("month_num", F.datediff(month_start(), first).cast("double"))


def run_summary(table: DataFrame) -> DataFrame:
    """Rows, month range and totals of a built table, as one row."""
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("year_month").alias("first_month"),
        F.max("year_month").alias("last_month"),
        F.sum("post_count").alias("total_posts"),
        F.sum("total_likes").alias("total_likes"),
        F.sum("total_shares").alias("total_shares"))


def sample_rows(table: DataFrame, sort_cols, n: int = 16) -> DataFrame:
    """The first ``n`` rows in the table's sort order (the console sample)."""
    return top_k(table, sort_cols, n)
