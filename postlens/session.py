"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Configs that make results deterministic and plans adaptive.  Sizes are
# defaults for a cluster; tests and the bench override partitions locally.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", partitions: int = 8,
                  app: str = "postlens", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, submit with your own conf instead."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**BASE_CONF, "spark.sql.shuffle.partitions": str(partitions),
                 "spark.driver.memory": "16g", **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session, as it stands (a URI
    keeps its scheme).  Where it is unset a local session gets a private
    scratch folder; a cluster must name a folder that all its machines share.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if cur:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(cur)
        return cur
    master = sc.master or ""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that every machine of {master} shares")
    path = tempfile.mkdtemp(prefix="postlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


_PASSING: ContextVar[list[str] | None] = ContextVar("passing stages", default=None)


def stage_path(spark: SparkSession, tag: str) -> str:
    """A new folder for a staged table under the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{tag}-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted when it ends: what is made of them must be written by then."""
    outer = _PASSING.set([])
    try:
        yield
    finally:
        made = _PASSING.get()
        _PASSING.reset(outer)
        for path in made:
            delete_folder(spark, path)


def cut_lineage(df, tag: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used instead of ``Dataset.checkpoint()``, whose eager mode runs the plan
    twice (a count, then the checkpoint write).  The written table survives
    executor loss; the folder is the cluster's ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = stage_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
