"""Ranking operators: top-N per group (W1) and global top-K.

``top_n_per_group`` is a ``row_number`` window with a ``<= n`` filter, which
Catalyst turns into a WindowGroupLimit: each map task keeps only n rows per
group before the shuffle, so a hot group never reaches one task in full.
``top_k`` is ``orderBy().limit()`` = TakeOrderedAndProject (per-partition
top-k, then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int,
                    rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*_order(order_cols))
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def top_k(df: DataFrame, order_cols, k: int) -> DataFrame:
    return df.orderBy(*_order(order_cols)).limit(k)


def top_and_bottom(df: DataFrame, metric: str, k: int, tie: str = "entity",
                   high_label: str = "top", low_label: str = "bottom") -> DataFrame:
    """K highest and k lowest rows of ``metric`` with a ``side`` column.

    Ties are pinned on ``tie`` ascending for both sides.
    """
    hi = top_k(df, [F.col(metric).desc(), F.col(tie).asc()], k)
    lo = top_k(df, [F.col(metric).asc(), F.col(tie).asc()], k)
    return (hi.select(F.lit(high_label).alias("side"), "*")
            .unionByName(lo.select(F.lit(low_label).alias("side"), "*")))


def top_groups(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The k keys with the largest total ``measure`` (ties: key ascending).

    Returns a k-row frame ``(key, total)``; k is a parameter, so it is safe to
    broadcast into the semi join of ``keep_top_groups``.
    """
    totals = df.groupBy(key).agg(F.sum(measure).alias("_total"))
    return top_k(totals, [F.col("_total").desc(), F.col(key).asc()], k)


def keep_top_groups(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """Rows of the k largest groups (broadcast left-semi; k rows by construction)."""
    top = top_groups(df, key, measure, k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")
