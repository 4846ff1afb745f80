"""What a build was made from: file manifests by month, and months in isolation.

A manifest row is a source file (name, size, modification time) of a month.
A month is current if the files now present are exactly those of its manifest,
so a late file counts whatever its time stamp, and so does one that vanished
or was delivered anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import cut_lineage

FILE = ["source", "year_month", "file", "size", "mtime"]
SCHEMA = "source string, file string, size long, mtime timestamp, year_month string"
# What a month's own files can bring about: they cannot be read, are gone, or hold values that do not convert.
OF_FILES = re.compile(r"SQLSTATE: (KD|22)|\[PATH_NOT_FOUND\]")


def list_files(spark: SparkSession, path: str, source: str, month_of: Callable[[Column], Column]) -> DataFrame:
    """Files under ``path`` from their listing alone (no content is read); none if the path is absent."""
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA).select(*FILE)
    return df.select(F.lit(source).alias("source"), month_of(F.col("path")).alias("year_month"), F.col("path").alias("file"),
                     F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path).select(*FILE)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA).select(*FILE)


def write_manifest(files: DataFrame, path: str) -> None:
    """Replace the manifest of exactly the months in ``files``."""
    (files.select(*FILE).repartition("year_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year_month").parquet(path))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Files of the months that could not be built, and why."""
    schema = SCHEMA.replace(", year_month", ", error string, year_month")
    try:
        return spark.read.schema(schema).parquet(path).select(*FILE, "error").filter("error IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], schema).select(*FILE, "error")


def write_quarantine(files: DataFrame, why: dict[str, str], path: str, held: DataFrame | None = None) -> None:
    """Replace the quarantine of the months in ``files``: with their files and why, or lifted (no reason).

    With ``held``, the present quarantine, months that are not in it are left alone.
    """
    if held is not None:
        files = files.join(held.select("year_month").distinct(), "year_month", "left_semi")
    reason = F.lit(None).cast("string")
    for month, text in why.items():
        reason = F.when(F.col("year_month") == month, F.lit(text)).otherwise(reason)
    rows = files.select(*FILE).withColumn("error", reason)
    if held is not None:
        rows = cut_lineage(rows, "quarantine")             # what it replaces is read to make it
    (rows.repartition("year_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year_month").parquet(path))


def changed_months(files: DataFrame, manifest: DataFrame) -> list[str]:
    """Months of ``files`` whose set of files differs from the manifest's (a calendar-sized list)."""
    differ = (files.join(manifest, FILE, "left_anti").select("year_month")
              .unionByName(manifest.join(files, FILE, "left_anti").select("year_month"))).distinct()
    return sorted(r.year_month for r in differ.join(files.select("year_month").distinct(), "year_month", "left_semi").collect())


def run_isolated(months: list[str], build: Callable[[list[str]], None]) -> dict[str, str]:
    """Build all months in one job; if that fails, each half on its own, and so on.  Returns the months that failed, with why.

    One bad month among many costs a job for each halving, not one a month.
    Only what a month's own files can bring about is reported as that month's
    failure.  Any other (the code, the disk, a lost executor) says nothing of
    the month and is raised once the other months are built.
    """
    failed = _build_apart(months, build)
    for month, e in failed.items():
        if not (isinstance(e, OSError) or OF_FILES.search(str(e))):
            e.add_note(f"while month {month} was built; {len(failed)} of {len(months)} months were not")
            raise e
    return {month: _why(e) for month, e in failed.items()}


def _build_apart(months: list[str], build: Callable[[list[str]], None]) -> dict[str, Exception]:
    if not months:
        return {}
    try:
        build(months)
        return {}
    except Exception as e:  # noqa: BLE001 - reported by month, or raised by run_isolated
        if len(months) == 1:
            return {months[0]: e}
    half = len(months) // 2
    return {**_build_apart(months[:half], build), **_build_apart(months[half:], build)}


def require_whole(status: DataFrame) -> DataFrame:
    """A run's status if no month of it failed: what the other months left must not pass for the whole."""
    failed = status.filter("status = 'failed'").orderBy("year_month").collect()
    if failed:
        raise RuntimeError("months that could not be built: " + "; ".join(f"{r.year_month}: {r.error}" for r in failed))
    return status


def _why(e: Exception) -> str:
    lines = str(e).strip().splitlines() or [type(e).__name__]
    if len(lines) > 1 and lines[0].startswith("An error occurred while calling"):      # py4j's own line; Java's follows
        lines = lines[1:]
    return lines[0].removeprefix(": ")[:500]
