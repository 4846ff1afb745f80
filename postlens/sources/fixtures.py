"""Views of the model tables over the driver's TPC-H-like parquet tables.

Mapping (see FIXTURES.md §2.1): an order is a post, a line item naming a part
is an entity mention, ``lower(brand || ' ' || type)`` is the entity name
(25 × 6 = 150 names), the order month is the month "file".  The same mapping
is spelled in DuckDB SQL in ``postlens.plans.oracle`` for the driver check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed test parameters shared with the SQL oracle.
FIXTURE_WORDS = ("promo",)          # word list for the redaction fixture
DATE_TOP_N = 20                     # top-N for the date table (fills "Other")
ENTITY_TOP_N = 100                  # top-N for the entity table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tweets_from_orders(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        k.cast("string").alias("tweet_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        c.cast("string").alias("user_id"),
        (F.floor("o_totalprice").cast("bigint") % 1000).cast("int").alias("likes"),
        (c % 50).cast("int").alias("shares"),
        F.when(k % 3 == 0, F.lit(0.0)).when(k % 11 == 0, F.lit(None))
         .otherwise((k % 5) / F.lit(4.0) + F.lit(0.03)).cast("float").alias("positive_emotion"),
        F.when(c % 2 == 0, F.lit(0.0)).otherwise((c % 5) / F.lit(4.0))
         .cast("float").alias("negative_emotion"),
    )


def entities_from_lineitem(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    # Plain inner joins: the planner sizes them (part and orders are
    # broadcast at small scale, sort-merge at large scale).
    li = lineitem.select("l_orderkey", "l_partkey", "l_discount")
    names = part.select("p_partkey",
                        F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("detected_as"))
    months = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return (li.join(names, li.l_partkey == names.p_partkey)
              .join(months, li.l_orderkey == months.o_orderkey)
              .select(F.col("l_orderkey").cast("string").alias("tweet_id"),
                      "year_month",
                      "detected_as",
                      F.concat(F.lit("urn:part:"), F.col("l_partkey").cast("string")).alias("matched_uri"),
                      (F.lit(-30) * F.col("l_discount")).cast("float").alias("confidence")))


def mentions_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """User mentions: the order's customer name stands in for the @handle."""
    return (orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
            .join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
            .select(F.col("o_orderkey").cast("string").alias("tweet_id"), "year_month",
                    F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")).alias("username")))


def wordlist(spark: SparkSession, words=FIXTURE_WORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


@dataclass
class Corpus:
    tweets: DataFrame
    entities: DataFrame
    words: DataFrame


def load_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    return Corpus(tweets=tweets_from_orders(orders),
                  entities=entities_from_lineitem(lineitem, part, orders),
                  words=wordlist(spark))
