"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import cut_lineage, ensure_checkpoint_dir

#: A white-space-free word: neither space nor \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship a module's functions to the Python workers by value (they need not import the package)."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared checkpoint folder and read it back."""
    return cut_lineage(df, f"llm-{tag}")


def stage_compressed(df: DataFrame, tag: str) -> DataFrame:
    """Like ``stage``, for bulky bytes and texts: zstd instead of the session's codec."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stage/llm-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that an operator is about to add under the same name."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def lowest_by_hash(df: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The ``n`` rows whose key hashes lowest (all, if fewer), in that order.

    A bound on the hash goes first, so that what the tasks hand on is about
    ``n`` rows in all and not ``n`` rows of every partition.
    """
    total, h = df.count(), F.xxhash64(key)
    share = 1.2 * n / max(total, 1)
    while share < 1:
        low = df.where(h <= int(-(1 << 63) + share * (1 << 64)))
        if low.count() >= n:
            df = low
            break
        share *= 2
    return df.orderBy(h, key, *ties).limit(n)
