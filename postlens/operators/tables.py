"""The three table builders: month (Q01), date (Q02), entity (Q03).

Plan shape (both Q02 and Q03):

* entity mentions are grouped once by ``(year_month, tweet_id)`` into the
  post's distinct name set (map-side partial aggregation absorbs repeated
  rows and copies before the shuffle);
* posts are shuffled once on the same key, so the post ⟕ names join is
  co-partitioned and needs no further exchange;
* the per-month top-N is a ``row_number`` window over the small
  ``(year_month, name)`` count table (WindowGroupLimit pre-filters per task);
* everything after the join is partial/final hash aggregation.

Where both tables are wanted, ``post_facts`` does the grouping, the join and
the sums by name once, writes them, and both builders work from there.

A month is never the unit of parallelism: a hot month or name is split
across tasks by the ``(year_month, tweet_id)`` hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.columns import quantize, signal_mean, zero_if_null
from postlens.model import NONE, OTHER
from postlens.operators.ranking import top_n_per_group
from postlens.operators.redaction import apply_redaction
from postlens.session import cut_lineage

KEY = ["year_month", "tweet_id"]

# The top list holds at most top_n names a month, and months are a calendar: it is
# broadcast while that bound stays within MOST_BROADCAST_NAMES rows (about 100 MB).
# A longer list is joined by sort and merge, with Spark's own skew handling.
MOST_MONTHS = 500
MOST_BROADCAST_NAMES = 2_500_000

# ``post_facts`` sorts by the id first: a sort compares the first eight bytes of its
# first column before anything else, and a month's posts share these.
POST = ["tweet_id", "year_month"]

# Up to so many top names a month are held against a post's names as one array; more of them as rows.
MOST_LISTED_NAMES = 256


def _staged(rows: DataFrame, wordlist) -> DataFrame:
    """Write the pre-redaction aggregate once before it is read twice.

    Redaction needs the table's distinct names and then the table again;
    without a cut the whole build would run twice.  The aggregate is small
    (≤ months × 25 × (N+2) rows) and goes to the shared checkpoint folder,
    which also survives executor loss (never a local checkpoint).
    """
    return cut_lineage(rows, "pre-redaction") if wordlist is not None else rows


def month_table(tweets: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Q01: one row per month; months listed in ``months`` but empty give 0/0/0."""
    agg = tweets.groupBy("year_month").agg(
        F.sum(zero_if_null("likes", "bigint")).alias("total_likes"),
        F.sum(zero_if_null("shares", "bigint")).alias("total_shares"),
        F.count(F.lit(1)).alias("post_count"))
    if months is not None:
        agg = (months.select("year_month").distinct().join(agg, "year_month", "left")
               .na.fill(0, ["total_likes", "total_shares", "post_count"]))
    return agg.select("year_month", "total_likes", "total_shares", "post_count")


def post_names(entities: DataFrame, by=KEY) -> DataFrame:
    """A5: one row per post with its distinct non-null names (array).

    Null keys can never join (trap 9); filtering them here also makes every
    use of this frame the same plan, so its shuffle is reused (the joins
    below would otherwise infer the filter on one branch only).
    """
    keyed = entities.filter(F.col("year_month").isNotNull() & F.col("tweet_id").isNotNull())
    return keyed.groupBy(*by).agg(F.collect_set("detected_as").alias("names"))


def name_post_counts(posts: DataFrame) -> DataFrame:
    """A4: distinct posts per (month, name), from the entity side only (trap 4)."""
    return (posts.select("year_month", F.explode("names").alias("name"))
            .groupBy("year_month", "name").agg(F.count(F.lit(1)).alias("n_posts")))


def top_names(posts: DataFrame, top_n: int) -> DataFrame:
    """The month's top-N names by distinct posts, ties by name ascending."""
    counts = name_post_counts(posts)
    return top_n_per_group(counts, ["year_month"], [F.col("n_posts").desc(), F.col("name").asc()],
                           top_n).select("year_month", "name")


def quantized_posts(tweets: DataFrame) -> DataFrame:
    """P1 + P2 on the post side."""
    return tweets.select(
        *KEY,
        quantize("positive_emotion").alias("positive_sentiment"),
        quantize("negative_emotion").alias("negative_sentiment"),
        zero_if_null("likes", "bigint").alias("likes"),
        zero_if_null("shares", "bigint").alias("shares"))


@dataclass(frozen=True)
class PostFacts:
    """What the date and the entity table have in common, written once.

    * ``posts``: every post row with its post's distinct names (null: no
      mention), and the posts that have mentions only (sentiments null);
    * ``sums``: of every name, by month and sentiments: likes, shares, post
      rows ``n`` and distinct posts ``n_posts``.
    """

    posts: DataFrame
    sums: DataFrame


def post_facts(tweets: DataFrame, entities: DataFrame) -> PostFacts:
    """A5 + J1/J2 + A1: mentions and posts meet in one shuffle each, whatever tables follow."""
    rows = quantized_posts(tweets)
    keyed = F.col("year_month").isNotNull() & F.col("tweet_id").isNotNull()
    # A post that has several rows is one post: its first row counts it.
    one = F.row_number().over(Window.partitionBy(*POST).orderBy("tweet_id")) == 1
    met = post_names(entities, POST).join(rows.filter(keyed).withColumn("first", one), POST, "full_outer")
    alone = rows.filter(~keyed).withColumns({"names": F.lit(None).cast("array<string>"), "first": F.lit(True)})
    posts = cut_lineage(met.unionByName(alone), "post-facts")
    sums = (posts.select("year_month", F.explode("names").alias("name"), "positive_sentiment", "negative_sentiment", "likes", "shares",
                         F.when(F.col("positive_sentiment").isNull(), 0).otherwise(1).alias("n"),
                         F.when(F.col("first"), 1).when(F.col("first").isNull(), 1).otherwise(0).alias("n_posts"))
            .groupBy("year_month", "name", "positive_sentiment", "negative_sentiment")
            .agg(*[F.sum(c).alias(c) for c in ("likes", "shares", "n", "n_posts")]))
    return PostFacts(posts, cut_lineage(sums, "name-sums"))


def _without_top_name(posts: DataFrame, top: DataFrame, top_n: int) -> DataFrame:
    """The post rows of which no name is in ``top``."""
    if top_n <= MOST_LISTED_NAMES:
        lists = top.groupBy("year_month").agg(F.collect_list("name").alias("top"))
        return (posts.join(F.broadcast(lists), "year_month", "left")
                .filter(~F.coalesce(F.arrays_overlap("names", "top"), F.lit(False))))
    held = (posts.select(*POST, F.explode("names").alias("name"))
            .join(top, ["year_month", "name"], "left_semi").select(*POST).distinct())
    return posts.join(held, POST, "left_anti")


def _date_rows_of(facts: PostFacts, top_n: int) -> DataFrame:
    """Q02 before redaction: named rows are sums already, only ``Other`` and ``None`` look at the posts."""
    counts = facts.sums.groupBy("year_month", "name").agg(F.sum("n_posts").alias("n_posts"))
    top = top_n_per_group(counts, ["year_month"], [F.col("n_posts").desc(), F.col("name").asc()],
                          top_n).filter(F.col("name") != OTHER).select("year_month", "name")
    if top_n * MOST_MONTHS <= MOST_BROADCAST_NAMES:
        top = F.broadcast(top)
    measures = ["year_month", "positive_sentiment", "negative_sentiment", "likes", "shares", "n"]
    named = facts.sums.join(top, ["year_month", "name"], "left_semi").select(*measures, F.col("name").alias("entity"))
    rest = (_without_top_name(facts.posts, top, top_n).withColumn("n", F.lit(1))
            .select(*measures, F.when(F.col("names").isNull(), NONE).otherwise(OTHER).alias("entity")))
    rows = named.unionByName(rest).filter(F.col("positive_sentiment").isNotNull())
    return rows.groupBy("year_month", "positive_sentiment", "negative_sentiment", "entity").agg(
        F.sum("likes").alias("total_likes"),
        F.sum("shares").alias("total_shares"),
        F.sum("n").alias("post_count"))


def date_rows(tweets: DataFrame, entities: DataFrame, top_n: int = 100, facts: PostFacts | None = None) -> DataFrame:
    """Q02 before redaction: (month, pos, neg, entity) sums with Other/None buckets.

    ``facts``: those of the same posts and mentions, where they are written already.
    """
    if facts is not None:
        return _date_rows_of(facts, top_n)
    posts = post_names(entities)
    top = top_names(posts, top_n).withColumn("is_top", F.lit(True))
    if top_n * MOST_MONTHS <= MOST_BROADCAST_NAMES:
        top = F.broadcast(top)
    # P3 + J4: a post keeps its top names; with none it falls in "Other".
    # explode_outer keeps posts whose only names were null (they are "Other").
    labelled = (posts.select(*KEY, F.explode_outer("names").alias("name"))
                .join(top, ["year_month", "name"], "left"))
    per_post = (labelled.groupBy(*KEY)
                .agg(F.collect_set(F.when(F.col("is_top") & (F.col("name") != OTHER),
                                          F.col("name"))).alias("named"))
                .select(*KEY, F.when(F.size("named") > 0, F.col("named"))
                        .otherwise(F.array(F.lit(OTHER))).alias("entities")))
    # J1 + P4: every post row survives; a post with no mention is "None".
    joined = quantized_posts(tweets).join(per_post, KEY, "left")
    rows = joined.select(
        "year_month", "positive_sentiment", "negative_sentiment", "likes", "shares",
        F.explode(F.coalesce("entities", F.array(F.lit(NONE)))).alias("entity"))
    return rows.groupBy("year_month", "positive_sentiment", "negative_sentiment", "entity").agg(
        F.sum("likes").alias("total_likes"),
        F.sum("shares").alias("total_shares"),
        F.count(F.lit(1)).alias("post_count"))


def date_table(tweets: DataFrame, entities: DataFrame, top_n: int = 100,
               wordlist: DataFrame | None = None, with_redactions: bool = False, facts: PostFacts | None = None):
    """Q02 (flagship): the date table with ``redacted``/``classified`` flags."""
    out, red = redacted_date_table(date_rows(tweets, entities, top_n, facts), wordlist)
    return (out, red) if with_redactions else out


def redacted_date_table(rows: DataFrame, wordlist: DataFrame | None = None):
    """The date table of its pre-redaction rows, and the redactions."""
    out, red = apply_redaction(_staged(rows, wordlist), wordlist)
    return out.select("year_month", "positive_sentiment", "negative_sentiment", "entity",
                      "total_likes", "total_shares", "post_count", "redacted", "classified"), red


def _sums_by_name(facts: PostFacts) -> DataFrame:
    """The sums of ``facts`` by month and name, with those of the sentiments (quarters, so a sum is exact)."""
    n, pos, neg = F.col("n"), F.col("positive_sentiment"), F.col("negative_sentiment")
    return facts.sums.groupBy("year_month", F.col("name").alias("entity")).agg(
        F.sum("n_posts").alias("n_posts"),
        F.sum("n").alias("post_count"),
        F.sum("likes").alias("total_likes"),
        F.sum("shares").alias("total_shares"),
        F.sum(pos * n).alias("pos_sum"),
        F.sum(neg * n).alias("neg_sum"),
        F.sum(F.when(pos > 0, n).otherwise(0)).alias("pos_nz"),
        F.sum(F.when(neg > 0, n).otherwise(0)).alias("neg_nz"))


def _name_rows(tweets: DataFrame, entities: DataFrame) -> DataFrame:
    """The same sums from the posts and mentions."""
    posts = post_names(entities)
    q = quantized_posts(tweets)
    per_post = q.groupBy(*KEY).agg(
        F.sum("likes").alias("likes"),
        F.sum("shares").alias("shares"),
        F.count(F.lit(1)).alias("n"),
        F.sum("positive_sentiment").alias("pos_sum"),
        F.sum("negative_sentiment").alias("neg_sum"),
        F.count_if(F.col("positive_sentiment") > 0).alias("pos_nz"),
        F.count_if(F.col("negative_sentiment") > 0).alias("neg_nz"))
    joined = posts.join(per_post, KEY, "left")
    return (joined.select("year_month", F.explode("names").alias("entity"),
                          "likes", "shares", "n", "pos_sum", "neg_sum", "pos_nz", "neg_nz")
            .groupBy("year_month", "entity").agg(
                F.count(F.lit(1)).alias("n_posts"),
                F.sum("n").alias("post_count"),
                F.sum("likes").alias("total_likes"),
                F.sum("shares").alias("total_shares"),
                F.sum("pos_sum").alias("pos_sum"),
                F.sum("neg_sum").alias("neg_sum"),
                F.sum("pos_nz").alias("pos_nz"),
                F.sum("neg_nz").alias("neg_nz")))


def entity_rows(tweets: DataFrame, entities: DataFrame, top_n: int = 10_000, facts: PostFacts | None = None) -> DataFrame:
    """Q03 before redaction.

    Aggregate first, rank after: per post we pre-sum the posts side (exact
    under duplicate post rows), join it to the post's names, sum per
    (month, name), and only then keep the month's top-N by distinct posts.
    This replaces the reference's semi join to the top-N list, so no name
    list is broadcast whatever N is.  Names whose posts never match keep
    their rank but produce no row (inner-join semantics).  ``facts``: as in
    ``date_rows``.
    """
    by_name = _name_rows(tweets, entities) if facts is None else _sums_by_name(facts)
    ranked = top_n_per_group(by_name, ["year_month"],
                             [F.col("n_posts").desc(), F.col("entity").asc()], top_n)
    return ranked.filter(F.col("post_count") > 0).select(
        "entity", "year_month",
        signal_mean("pos_sum", "pos_nz").alias("positive_sentiment"),
        signal_mean("neg_sum", "neg_nz").alias("negative_sentiment"),
        "total_likes", "total_shares", "post_count")


def entity_table(tweets: DataFrame, entities: DataFrame, top_n: int = 10_000,
                 wordlist: DataFrame | None = None, with_redactions: bool = False, facts: PostFacts | None = None):
    """Q03: the entity × month table with conditional sentiment means."""
    out, red = redacted_entity_table(entity_rows(tweets, entities, top_n, facts), wordlist)
    return (out, red) if with_redactions else out


def redacted_entity_table(rows: DataFrame, wordlist: DataFrame | None = None):
    """The entity table of its pre-redaction rows, and the redactions."""
    out, red = apply_redaction(_staged(rows, wordlist), wordlist)
    return out.select("entity", "year_month", "positive_sentiment", "negative_sentiment",
                      "total_likes", "total_shares", "post_count", "redacted", "classified"), red
