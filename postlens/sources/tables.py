"""Readers and sinks for the model tables.

Two layouts are understood: one file per month and kind
(``month_YYYY-MM_tweets.parquet`` …, as the converter of the original tool
wrote them) and Hive-style month directories (``tweets/year_month=YYYY-MM/``).
The month label always comes from the path, never from ``created_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.model import ENTITIES_SCHEMA, MENTIONS_SCHEMA, TWEETS_SCHEMA

# Fixed value: file-name shape of per-month files.
MONTH_FILE = r"/month_([^/]+?)_(?:tweets|entities|mentions)\.parquet(?:/|$)"
MONTH_FOLDER = r"/year_month=([^/]+)/"
SCHEMAS = {"tweets": TWEETS_SCHEMA, "entities": ENTITIES_SCHEMA, "mentions": MENTIONS_SCHEMA}


def resolve_inputs(paths, kind: str = "tweets") -> list[str]:
    """A single directory means ``<dir>/month_*_<kind>.parquet``; a list is taken as given."""
    if isinstance(paths, str):
        return [f"{paths.rstrip('/')}/month_*_{kind}.parquet"]
    return list(paths)


def month_label(path_col="_metadata.file_path"):
    """S7/trap 15: the label of a per-month file's own name, else its month folder, else the name's stem."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    own, folder = F.regexp_extract(p, MONTH_FILE, 1), F.regexp_extract(p, MONTH_FOLDER, 1)
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]+)$", 1), r"\.parquet$", "")
    return F.when(own != "", own).when(folder != "", folder).otherwise(stem)


def read_kind(spark: SparkSession, paths, kind: str = "tweets") -> DataFrame:
    """Explicit schema (no inference), month label from the path.

    Column pruning and the vectorised reader are Spark's; the 1 M-row batching
    of the original is the reader's batch size.
    """
    df = spark.read.schema(SCHEMAS[kind]).parquet(*resolve_inputs(paths, kind))
    return df.withColumn("year_month", month_label())


def month_files(spark: SparkSession, paths, kind: str) -> DataFrame:
    """Months that have a file of ``kind`` (an empty file still counts), labelled as ``read_kind`` labels them."""
    files = spark.read.schema(SCHEMAS[kind]).parquet(*resolve_inputs(paths, kind)).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "file string")     # one row a file
    return listed.select(month_label("file").alias("year_month")).distinct()


def paired_months(spark: SparkSession, paths) -> DataFrame:
    """Months with both a posts and a mentions file (others are skipped)."""
    return month_files(spark, paths, "tweets").join(month_files(spark, paths, "entities"),
                                                     "year_month", "left_semi")


def write_sorted(df: DataFrame, path: str, sort_cols, mode: str = "overwrite") -> None:
    """A globally sorted table (range-partitioned sort, many files, in order)."""
    df.orderBy(*sort_cols).write.mode(mode).parquet(path)


DATE_SORT = ["year_month", "entity", "positive_sentiment", "negative_sentiment"]
ENTITY_SORT = ["entity", "year_month"]
MONTH_SORT = ["year_month"]


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """The reference's on-disk types (sentiments FLOAT) and sort order."""
    if "positive_sentiment" in df.columns:
        df = (df.withColumn("positive_sentiment", F.col("positive_sentiment").cast("float"))
                .withColumn("negative_sentiment", F.col("negative_sentiment").cast("float")))
    order = {"date": DATE_SORT, "entity": ENTITY_SORT, "month": MONTH_SORT}[kind]
    write_sorted(df, path, order)


def read_table_with_month(spark: SparkSession, path: str) -> DataFrame:
    """A built table plus ``month`` = first day of ``year_month`` (date)."""
    return spark.read.parquet(path).withColumn("month", F.to_date(F.concat("year_month", F.lit("-01"))))
