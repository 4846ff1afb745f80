"""Corpus pipeline: toxicity, SimHash near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame; ``run`` writes it as Parquet to the cluster's
shared checkpoint folder and rereads it for the next stage.  All but the last
return the columns of ``documents``: toxic documents are gone after the first,
all but one document of a near-duplicate group after the second, and the third
repeats a document once for each copy that the mix takes (none: it is gone).
The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import mixing, packing, simhash, toxicity
from postlens.llm.common import stage
from postlens.sources.fixtures import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("token_bytes")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Fingerprints, the fitted classifier and token ids are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
