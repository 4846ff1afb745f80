"""Materialised ("gold") tables in the shared checkpoint folder.

The reference builds date/entity/month tables once and every report reads
them; we do the same.  Tables are written under ``spark.checkpoint.dir`` (the
cluster's shared folder; a private scratch folder only when unset), which
also cuts lineage so a lost executor never recomputes the whole build.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from postlens.session import ensure_checkpoint_dir

def _code_version() -> str:
    """Hash of the package source: any code change gets fresh gold tables."""
    h = hashlib.sha1()
    for f in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
        h.update(f.read_bytes())
    return h.hexdigest()[:12]


LAYOUT_VERSION = _code_version()


INPUTS = ("orders", "lineitem", "part", "customer", "conversations")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def input_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files, from their listing: new files get new built tables."""
    out = []
    for t in INPUTS:
        p, fs = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                out.append(f"{t}|{f.getPath().getName()}|{f.getLen()}|{f.getModificationTime()}")
    return "\n".join(sorted(out))


def gold_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = hashlib.sha1(f"{sf_dir}|{LAYOUT_VERSION}|{input_state(spark, sf_dir)}".encode()).hexdigest()[:12]
    return f"{root}/gold/{tag}/{name}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Was the table at ``path`` written to its end?"""
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(p))


def materialize(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Read the written table, building and writing it first when absent."""
    path = gold_path(spark, sf_dir, name)
    if is_complete(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
