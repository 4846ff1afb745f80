"""Entity sentiment profile (Q32) — the methodology notes' recommended metrics.

Per (entity, time bin), over posts whose mention passes a confidence
threshold: post count, share of posts bearing any sentiment, mean intensity
per axis among posts bearing that axis, and share of ambivalent posts (both
axes at or above a level).  Bins with fewer than ``min_posts`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.columns import nonzero_mean
from postlens.operators.tables import KEY

ROUND = 6


def _intensity(c):
    x = F.col(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def entity_sentiment_profile(tweets: DataFrame, entities: DataFrame, min_confidence: float = -2.0,
                             bin: str = "month", min_posts: int = 5,
                             ambivalent_at: float = 0.5) -> DataFrame:
    names = (entities.filter(F.col("confidence") >= min_confidence)      # pushed to the scan
             .groupBy(*KEY).agg(F.collect_set("detected_as").alias("names")))
    posts = tweets.select(*KEY, F.date_trunc(bin, "created_at").cast("date").alias("bin"),
                          _intensity("positive_emotion").alias("pos"),
                          _intensity("negative_emotion").alias("neg"))
    rows = posts.join(names, KEY).select("bin", "pos", "neg", F.explode("names").alias("entity"))
    bearing = (F.col("pos") > 0) | (F.col("neg") > 0)
    amb = (F.col("pos") >= ambivalent_at) & (F.col("neg") >= ambivalent_at)
    g = rows.groupBy("entity", "bin").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg(bearing.cast("double")).alias("frac_bearing"),
        nonzero_mean("pos").alias("mean_pos"),
        nonzero_mean("neg").alias("mean_neg"),
        F.avg(amb.cast("double")).alias("frac_ambivalent"))
    return g.filter(F.col("n_posts") >= min_posts).select(
        "entity", F.date_format("bin", "yyyy-MM-dd").alias("bin"), "n_posts",
        *[F.bround(c, ROUND).alias(c) for c in ("frac_bearing", "mean_pos", "mean_neg", "frac_ambivalent")])
