"""JSON-lines session logs (S12): one file per session, one record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, file_path, line_pos, value)``; session = file stem.

    Line order inside a file is ``(file_block_start, monotonically_increasing_id)``
    (splits of one file are read in offset order).
    """
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("mid"), "value")
            .select(F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?$", 1).alias("session_id"),
                    "file_path", F.struct("block", "mid").alias("line_pos"), "value"))


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, file_path)`` of every log file, empty ones too.

    From the file system's listing, as Spark's file index leaves empty files
    out for every format.  Names are written as ``read_jsonl_logs`` has them.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in (fs.globStatus(p) or [])]
    files = [g for f in found for g in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]) if g.isFile()]
    names = [(f.getPath().toUri().toString(),) for f in files if not f.getPath().getName().startswith((".", "_"))]
    return (spark.createDataFrame(names, "file_path string")
            .select(F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?$", 1).alias("session_id"), "file_path"))


def conversations_as_logs(conversations: DataFrame, timestamp=None) -> DataFrame:
    """Render the driver's ``conversations`` table as session-log JSON lines.

    One session per ``conv_id`` (file stem ``conv-NNNNNN``), one line per turn.
    Records follow the log shape the extractor reads: ``type`` (assistant or
    user), ``isMeta`` (set on system turns) and ``message{role, content}``.
    """
    role = F.col("role")
    rec = F.struct(
        F.when(role == "assistant", F.lit("assistant")).otherwise(F.lit("user")).alias("type"),
        (role == "system").alias("isMeta"),
        F.struct(role.alias("role"), F.col("text").alias("content")).alias("message"),
        *([] if timestamp is None else [timestamp.alias("timestamp")]))
    return conversations.select(
        F.format_string("conv-%06d", F.col("conv_id")).alias("session_id"),
        F.col("turn").alias("line_pos"),
        F.to_json(rec).alias("value"))
