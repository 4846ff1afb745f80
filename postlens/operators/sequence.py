"""Global, gap-free row numbering without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition runs in one task.
Instead: a range-partitioned sort (distributed), a per-partition row count
(one row per partition), prefix offsets over that tiny frame, and a
broadcast join back — the DataFrame form of ``zipWithIndex``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.session import cut_lineage


def global_row_number(df: DataFrame, order_cols, name: str = "n") -> DataFrame:
    """Add a 1-based ``name`` following ``order_cols`` (which must be a total order).

    The sorted, id-tagged frame is written once to the shared checkpoint
    folder so both uses read the same ids.
    """
    tagged = (df.orderBy(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged, "numbered")
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # ≤ #partitions rows
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_base")) + 1)
            .drop("_pid", "_mid", "_off", "_base"))


def previous_value(numbered: DataFrame, value_col: str, n: str = "n",
                   out: str = "prev") -> DataFrame:
    """``lag(value_col)`` along a global numbering, as an equi-join on ``n - 1``."""
    prev = numbered.select((F.col(n) + 1).alias(n), F.col(value_col).alias(out))
    return numbered.join(prev, n, "left")
