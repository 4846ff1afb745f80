"""Data-quality checks as a table (Q33): the invariants the built tables must keep.

Each check yields ``(check_name, year_month, expected, actual, ok)`` rows, one
for every month.  Expectations come from the raw posts and mentions by another
route than the builders': distinct (post, name) pairs, written once, ranked and
counted per post; one wide row a month; then one row a check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.redact import TOKEN_PREFIX
from postlens.model import NONE, OTHER
from postlens.operators.ranking import top_n_per_group
from postlens.operators.tables import KEY
from postlens.session import cut_lineage

CHECK_COLS = ["check_name", "year_month", "expected", "actual", "ok"]
MEASURES = ("posts", "likes", "shares")
STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)

#: (check, expected, actual, relation): columns of the wide month row, or numbers.
CHECKS = [
    ("month_post_count", "p_posts", "m_posts", "eq"),
    ("month_likes", "p_likes", "m_likes", "eq"),
    ("month_shares", "p_shares", "m_shares", "eq"),
    ("date_unique_keys", "d_rows", "d_keys", "eq"),
    ("date_names_at_most_n_plus_2", "date_n_plus_2", "d_names", "le"),
    ("date_sentiment_domain", 0, "d_off_domain", "eq"),
    ("date_flags", 0, "d_bad_flags", "eq"),
    ("date_names_of_the_month", 0, "d_foreign_names", "eq"),
    ("date_total_pairs", "p_pairs", "d_posts", "eq"),
    ("date_pairs_at_least_posts", "p_posts", "d_posts", "ge"),
    *[(f"date_{b}_{x}", f"p_{b}_{x}", f"d_{b}_{x}", "eq") for b in ("none", "other") for x in ("posts", "likes", "shares")],
    ("entity_unique_keys", "e_rows", "e_names", "eq"),
    ("entity_names_at_most_n", "entity_n", "e_names", "le"),
    ("entity_means_in_unit_range", 0, "e_off_range", "eq"),
    ("entity_flags", 0, "e_bad_flags", "eq"),
    *[(f"entity_total_{x}", f"p_top_{x}", f"e_{x}", "eq") for x in ("posts", "likes", "shares")],
    *[(f"date_vs_entity_{x}", f"both_d_{x}", f"both_e_{x}", "eq") for x in ("posts", "likes", "shares")],
]


def _sums(prefix: str):
    return [F.sum(c).alias(f"{prefix}_{x}") for c, x in zip(("post_count", "total_likes", "total_shares"), MEASURES)]


def _bad_flags():
    named = ~F.col("entity").isin(OTHER, NONE)
    return F.count_if((F.col("classified") != named) | (F.col("redacted") != F.col("entity").startswith(TOKEN_PREFIX)))


def _expected(tweets: DataFrame, pairs: DataFrame, ranked: DataFrame, date_n: int, entity_n: int) -> DataFrame:
    """One row a month from the raw posts: what the tables must add up to."""
    per_post = (pairs.join(ranked, ["year_month", "name"], "left").groupBy(*KEY)
                .agg(F.count_if(F.col("rank") <= date_n).alias("n_date"), F.count_if(F.col("rank") <= entity_n).alias("n_entity")))
    posts = tweets.select(*KEY, F.coalesce(F.col("likes").cast("bigint"), F.lit(0)).alias("likes"),
                          F.coalesce(F.col("shares").cast("bigint"), F.lit(0)).alias("shares")).join(per_post, KEY, "left")
    none, other = F.col("n_date").isNull(), F.col("n_date") == 0
    tops = F.coalesce("n_entity", F.lit(0))
    return posts.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("p_posts"), F.sum("likes").alias("p_likes"), F.sum("shares").alias("p_shares"),
        F.sum(F.greatest(F.coalesce("n_date", F.lit(0)), F.lit(1))).alias("p_pairs"),
        *[a for b, cond in (("none", none), ("other", other)) for a in (
            F.count_if(cond).alias(f"p_{b}_posts"), F.sum(F.when(cond, F.col("likes"))).alias(f"p_{b}_likes"),
            F.sum(F.when(cond, F.col("shares"))).alias(f"p_{b}_shares"))],
        F.sum(tops).alias("p_top_posts"), F.sum(tops * F.col("likes")).alias("p_top_likes"),
        F.sum(tops * F.col("shares")).alias("p_top_shares"))


def quality_checks(tweets: DataFrame, entities: DataFrame, month_t: DataFrame, date_t: DataFrame, entity_t: DataFrame,
                   date_top_n: int, entity_top_n: int, redactions: DataFrame | None = None) -> DataFrame:
    pairs = cut_lineage(entities.select(*KEY, F.col("detected_as").alias("name")).distinct(), "quality-pairs")
    counts = cut_lineage(pairs.filter("name IS NOT NULL").groupBy("year_month", "name").agg(F.count(F.lit(1)).alias("n")),
                         "quality-counts")
    # Ranks beyond both N are never asked for: each task hands on so many names of a month, not all of them.
    ranked = cut_lineage(top_n_per_group(counts, ["year_month"], [F.col("n").desc(), "name"], max(date_top_n, entity_top_n), "rank"),
                         "quality-ranks")
    named = F.col("classified") & ~F.col("redacted")
    off = ~(F.col("positive_sentiment").isin(*STEPS) & F.col("negative_sentiment").isin(*STEPS))
    # The tables by name, met once: a month's names in either, with what the other has of them.
    date_n = date_t.groupBy("year_month", "entity").agg(
        F.count(F.lit(1)).alias("d_rows"), F.count_distinct("positive_sentiment", "negative_sentiment").alias("d_keys"),
        F.lit(1).alias("d_names"), F.count_if(off).alias("d_off_domain"), _bad_flags().alias("d_bad_flags"), *_sums("d"),
        F.max("classified").alias("named"), F.max(named).alias("plain"))
    outside = ~(F.col("positive_sentiment").between(0, 1) & F.col("negative_sentiment").between(0, 1))
    entity_n = entity_t.groupBy("year_month", "entity").agg(
        F.count(F.lit(1)).alias("e_rows"), F.lit(1).alias("e_names"), F.count_if(outside).alias("e_off_range"),
        _bad_flags().alias("e_bad_flags"), *_sums("e"))
    known = counts.select("year_month", F.col("name").alias("entity"), F.lit(1).alias("known"))
    by_name = date_n.join(entity_n, ["year_month", "entity"], "full").join(known, ["year_month", "entity"], "left")
    sums = [c for c in date_n.columns + entity_n.columns if c.startswith(("d_", "e_"))]
    cases = {"none": F.col("entity") == NONE, "other": F.col("entity") == OTHER}
    tables = by_name.groupBy("year_month").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.when(cond, F.col(f"d_{x}"))).alias(f"d_{k}_{x}") for k, cond in cases.items() for x in MEASURES],
        *[F.sum(F.when(F.col("named"), F.col(f"{t}_{x}"))).alias(f"both_{t}_{x}") for t in "de" for x in MEASURES],
        F.count_if(F.col("plain") & F.col("known").isNull()).alias("d_foreign_names"))
    month_m = month_t.groupBy("year_month").agg(*_sums("m"))
    wide = reduce(lambda a, b: a.join(b, "year_month", "full"),
                  [_expected(tweets, pairs, ranked, date_top_n, entity_top_n), month_m, tables])
    wide = wide.withColumns({"date_n_plus_2": F.lit(date_top_n + 2), "entity_n": F.lit(entity_top_n)})

    def value(x):
        return F.coalesce(F.col(x).cast("bigint"), F.lit(0)) if isinstance(x, str) else F.lit(x).cast("bigint")

    def row(check, expected, actual, relation):
        e, a = value(expected), value(actual)
        return F.struct(F.lit(check).alias("check_name"), e.alias("expected"), a.alias("actual"),
                        {"eq": e == a, "le": a <= e, "ge": a >= e}[relation].alias("ok"))

    out = (wide.select("year_month", F.explode(F.array(*[row(*c) for c in CHECKS])).alias("c"))
           .select("c.check_name", "year_month", "c.expected", "c.actual", "c.ok"))
    if redactions is None:
        return out
    # two names must not share one redaction token (one row over all months)
    clashes = (redactions.select("token", "original").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    clash = clashes.agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit("redaction_token_collisions").alias("check_name"), F.lit(None).cast("string").alias("year_month"),
        F.lit(0).cast("bigint").alias("expected"), "actual", (F.col("actual") == 0).alias("ok"))
    return out.unionByName(clash)


def compare_by_id(source: DataFrame, built: DataFrame, id_col: str = "tweet_id", examples: int = 3) -> DataFrame:
    """U4: both sides of a table held against each other as multisets of (year_month, id), month by month.

    (year_month, n_source, n_built, missing, extra, missing_ids, extra_ids):
    rows that only one side has, counted with repeats, and the smallest
    ``examples`` of their ids (null where there are none).  Errors that cancel
    in counts and sums, like two posts that changed months, show on both.
    One shuffle on (month, id) with partial counts; a null id is an id.
    """
    side = lambda df, n: df.select("year_month", F.col(id_col).alias("id"), F.lit(n).alias("d"))
    per_id = (side(source, 1).unionByName(side(built, -1)).groupBy("year_month", "id")
              .agg(F.count_if(F.col("d") > 0).alias("s"), F.count_if(F.col("d") < 0).alias("b")))
    odd = per_id.withColumn("more", F.col("s") - F.col("b")).where("more <> 0")
    first = Window.partitionBy("year_month", F.col("more") > 0).orderBy("id")
    shown = (odd.withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples).groupBy("year_month")
             .agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("more") * sign > 0, F.coalesce("id", F.lit("null"))))), ",")
                    .alias(name) for name, sign in (("missing_ids", 1), ("extra_ids", -1))]))
    months = per_id.groupBy("year_month").agg(
        F.sum("s").alias("n_source"), F.sum("b").alias("n_built"),
        F.sum(F.greatest(F.col("s") - F.col("b"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("b") - F.col("s"), F.lit(0))).alias("extra"))
    return months.join(shown, "year_month", "left").select(
        "year_month", "n_source", "n_built", "missing", "extra",
        *[F.nullif(c, F.lit("")).alias(c) for c in ("missing_ids", "extra_ids")])
