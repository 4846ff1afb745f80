"""Column builders.

All are plain ``pyspark.sql.functions`` expressions, so they stay inside
whole-stage codegen — no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.model import COUNT_METRICS, SENTINELS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantize(c, steps: int = 4) -> Column:
    """null/NaN -> 0, then round half-to-even to the nearest 1/steps."""
    x = col(c).cast("double")
    x = F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))
    return F.rint(x * steps) / steps


def zero_if_null(c, dtype: str = "int") -> Column:
    """Null counters count as zero."""
    return F.coalesce(col(c).cast(dtype), F.lit(0).cast(dtype))


def signal_mean(total, n_nonzero) -> Column:
    """A3: sum over all rows divided by the number of rows with x > 0; 0.0 if none."""
    return F.coalesce(F.try_divide(col(total).cast("double"), col(n_nonzero).cast("double")),
                      F.lit(0.0))


def nonzero_mean(c) -> Column:
    """Mean of the values > 0, 0.0 when there are none."""
    x = col(c).cast("double")
    return F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0))


def classified_flag(entity="entity") -> Column:
    """P5: a real name, not one of the two buckets."""
    return ~col(entity).isin(*SENTINELS)


def clean_filter(classified_only: bool = True, exclude_redacted: bool = True) -> Column:
    """P7/P8 flag part: ``classified`` keeps classified rows, ``redacted`` drops redacted."""
    cond = F.lit(True)
    if classified_only:
        cond = cond & F.col("classified")
    if exclude_redacted:
        cond = cond & ~F.col("redacted")
    return cond


def month_range(lo: str | None, hi: str | None, c="year_month") -> Column:
    """Inclusive month range on ``YYYY-MM`` labels (lexical = chronological)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col(c) >= F.lit(lo))
    if hi is not None:
        cond = cond & (col(c) <= F.lit(hi))
    return cond


def month_start(c="year_month") -> Column:
    """``YYYY-MM`` label -> first day of that month."""
    return F.to_date(F.concat(col(c), F.lit("-01")))


def net_sentiment(pos="positive_sentiment", neg="negative_sentiment") -> Column:
    """Positive minus negative, in double."""
    return col(pos).cast("double") - col(neg).cast("double")


def metric_agg(metric: str) -> Column:
    """The aggregate that belongs to a metric (sum for counts, nonzero mean else)."""
    if metric in COUNT_METRICS:
        return F.sum(metric).cast("double")
    return nonzero_mean(metric)


def weighted(c, weight="post_count") -> Column:
    return col(c).cast("double") * col(weight)
