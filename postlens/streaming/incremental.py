"""Resumable month-at-a-time builds (M1-M7).

Layout: sources are parquet tables partitioned by ``year_month``
(``tweets/year_month=…``, ``entities/year_month=…``).  The staging table
holds the *pre-redaction* rows of each finished month, also partitioned by
``year_month`` (sensitive: names are not yet redacted), and beside them, in
``_manifest``, the source files each month was built from.

* M1  a month is written as soon as it is built (dynamic partition overwrite);
* M2  a restart builds the months whose source files are not exactly those of
      their manifest: new months, late files of any time stamp, replaced and
      vanished files; it reads those months' folders only;
* M3  ``resume=False`` rebuilds every month;
* M4  the final table is assembled from the whole staging table, then redacted;
* M5  a status frame reports each month: built, skipped or failed (why, and it
      keeps what it had) while the others are built;
* M6  an interrupted write leaves nothing behind (Spark's commit protocol);
* M7  ``stream_months``: file-source ``readStream`` + ``foreachBatch`` rebuilds
      every month that new post *or* mention files touch, from the whole
      month, because the per-month top-N must see all of it.  Only the names
      of new files are streamed; a month that cannot be built is put into
      quarantine with its files and the reason, the others go on, and it is
      tried again when its files change.  Batch and stream share one manifest.

A month is built once it has a posts file; without mention files all its posts
have no entity.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.model import ENTITIES_SCHEMA, TWEETS_SCHEMA
from postlens.operators import tables as TB
from postlens.operators.redaction import apply_redaction, redaction_table
from postlens.session import cut_lineage
from postlens.sources.manifest import (FILE, changed_months, list_files, read_manifest, read_quarantine, run_isolated,
                                       write_manifest, write_quarantine)
from postlens.sources.publish import publish, read_published
from postlens.sources.tables import month_label, write_table


def _with_month(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("year_month", T.StringType())])


TWEETS_SOURCE = _with_month(TWEETS_SCHEMA)
ENTITIES_SOURCE = _with_month(ENTITIES_SCHEMA)
KINDS = ("date", "entity", "month")
LISTING = "path string, modificationTime timestamp, length long, content binary"      # of Spark's binaryFile source


def _read_months(spark: SparkSession, path: str, schema: T.StructType, months: list[str]) -> DataFrame:
    """The named months of a source; Spark prunes to their folders when it plans the scan.

    An unreadable file must fail its job, whatever the session says.
    """
    try:
        df = spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.filter(F.col("year_month").isin(months))


def source_files(spark: SparkSession, tweets_path: str, entities_path: str, kind: str) -> DataFrame:
    """The files a build of ``kind`` reads, by month (from the listing; an empty file still counts)."""
    files = list_files(spark, tweets_path, "tweets", month_label)
    if kind != "month":                                  # the month table never looks at mentions
        files = files.unionByName(list_files(spark, entities_path, "entities", month_label))
    return files


def _months_with_posts(files: DataFrame) -> list[str]:
    return sorted(r.year_month for r in files.filter("source = 'tweets'").select("year_month").distinct().collect())


def build_rows(spark: SparkSession, tweets_path: str, entities_path: str, months: list[str], kind: str,
               top_n: int) -> DataFrame:
    """Pre-redaction rows of ``months`` only."""
    t = _read_months(spark, tweets_path, TWEETS_SOURCE, months)
    if kind == "month":
        return TB.month_table(t, spark.createDataFrame([(m,) for m in months], "year_month string"))
    e = _read_months(spark, entities_path, ENTITIES_SOURCE, months)
    if kind == "date":
        return TB.date_rows(t, e, top_n)
    if kind == "entity":
        return TB.entity_rows(t, e, top_n)
    raise ValueError(f"unknown table kind {kind!r}")


def write_months(rows: DataFrame, staging: str, months: list[str]) -> None:
    """M1: replace exactly ``months``; one that has no rows is left with an empty file."""
    rows = cut_lineage(rows, "months")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year_month").parquet(staging))
    have = {r.year_month for r in rows.select("year_month").distinct().collect()}
    for m in months:
        if m not in have:
            rows.limit(0).drop("year_month").coalesce(1).write.mode("overwrite").parquet(f"{staging}/year_month={m}")


def _build_months(spark: SparkSession, tweets_path: str, entities_path: str, staging: str, kind: str, top_n: int,
                  files: DataFrame, months: list[str]) -> dict[str, str]:
    """Build ``months`` from the files as listed, the unreadable ones apart: month -> why it failed.

    What was built gets its manifest, what failed is put into quarantine.
    """
    def build(some: list[str]) -> None:
        write_months(build_rows(spark, tweets_path, entities_path, some, kind, top_n), staging, some)
        mine = files.filter(F.col("year_month").isin(some))
        write_manifest(mine, f"{staging}/_manifest")
        held = read_quarantine(spark, f"{staging}/_quarantine")
        if not held.isEmpty():
            write_quarantine(mine, {}, f"{staging}/_quarantine", held)

    failed = run_isolated(months, build)
    if failed:
        write_quarantine(files.filter(F.col("year_month").isin(list(failed))), failed, f"{staging}/_quarantine")
    return failed


def quarantined(spark: SparkSession, staging: str) -> DataFrame:
    """Months that could not be built: (source, year_month, file, size, mtime, error), a row a file."""
    return read_quarantine(spark, f"{staging.rstrip('/')}/_quarantine")


def _status(spark: SparkSession, months: list[str], done: set[str], failed: dict[str, str]) -> DataFrame:
    rows = [(m, "failed" if m in failed else "built" if m in done else "skipped", failed.get(m)) for m in months]
    return spark.createDataFrame(rows, "year_month string, status string, error string")


def run_incremental(spark: SparkSession, tweets_path: str, entities_path: str, staging: str,
                    kind: str = "date", top_n: int = 100, resume: bool = True) -> DataFrame:
    """Build the pending months and return (year_month, status, error) for every month with posts (M5).

    The files are listed before the build: one that lands meanwhile makes its
    month pending again.
    """
    staging = staging.rstrip("/")
    files = cut_lineage(source_files(spark, tweets_path, entities_path, kind), "source-files")
    months = _months_with_posts(files)
    pending = months
    if resume:
        changed = set(changed_months(files, read_manifest(spark, f"{staging}/_manifest")))
        pending = [m for m in months if m in changed]
    failed = _build_months(spark, tweets_path, entities_path, staging, kind, top_n, files, pending)
    return _status(spark, months, set(pending), failed)


def stream_months(spark: SparkSession, tweets_path: str, entities_path: str, staging: str,
                  checkpoint: str, kind: str = "date", top_n: int = 100) -> DataFrame:
    """M7: rebuild every month touched by new files of either source, as micro-batches.

    ``trigger(availableNow=True)`` drains what is there and stops; each
    source's own checkpoint makes reruns pick up only its new files, and the
    per-month overwrite makes a replayed batch idempotent.  New files are
    known by name alone, so that one that cannot be read does not stop the
    stream: its month is quarantined, and tried again by the first later run
    that finds its files changed (mended in place, replaced or taken away).
    A touched month whose files are all in its manifest is not built again.
    A source whose folder does not exist yet is left for a later run.
    Returns (year_month, status, error) for every month with posts.
    """
    staging = staging.rstrip("/")
    done, failed = set(), {}

    def attempt(touched: set[str]) -> None:
        files = cut_lineage(source_files(spark, tweets_path, entities_path, kind), "source-files")
        bad = quarantined(spark, staging).select(*FILE)
        tried = read_manifest(spark, f"{staging}/_manifest").join(bad.select("year_month"), "year_month", "left_anti").select(*FILE)
        changed = set(changed_months(files, tried.unionByName(bad)))          # else the other source's batch saw to it
        months = [m for m in _months_with_posts(files) if m in touched and m in changed]
        wrong = _build_months(spark, tweets_path, entities_path, staging, kind, top_n, files, months)
        done.update(months)
        for m in months:
            failed.pop(m, None)
        failed.update(wrong)

    def rebuild(batch: DataFrame, _epoch: int) -> None:
        attempt({r.year_month for r in batch.select("year_month").distinct().collect()})     # calendar-sized

    held = {r.year_month for r in quarantined(spark, staging).select("year_month").distinct().collect()}
    if held:
        attempt(held)
    for name, path in (("posts", tweets_path), ("entities", entities_path)):
        try:
            stream = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", "true").load(path)
        except AnalysisException:
            continue
        (stream.select(month_label(F.col("path")).alias("year_month")).writeStream.foreachBatch(rebuild)
         .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").trigger(availableNow=True).start().awaitTermination())
    still = {r.year_month: r.error for r in quarantined(spark, staging).select("year_month", "error").distinct().collect()}
    return _status(spark, _months_with_posts(source_files(spark, tweets_path, entities_path, kind)), done, {**still, **failed})


def assemble_with_redactions(spark: SparkSession, staging: str, kind: str, wordlist: DataFrame | None):
    """M4: (final table, redactions) from every staged month, also months outside this run."""
    rows = spark.read.parquet(staging)
    if kind == "month":
        return rows.select("year_month", "total_likes", "total_shares", "post_count"), None
    out, red = apply_redaction(rows, wordlist)
    cols = ["year_month", "positive_sentiment", "negative_sentiment", "entity"] if kind == "date" \
        else ["entity", "year_month", "positive_sentiment", "negative_sentiment"]
    return out.select(*cols, "total_likes", "total_shares", "post_count", "redacted", "classified"), red


def assemble(spark: SparkSession, staging: str, kind: str, wordlist: DataFrame | None) -> DataFrame:
    return assemble_with_redactions(spark, staging, kind, wordlist)[0]


def write_final(spark: SparkSession, staging: str, kind: str, wordlist: DataFrame | None, table_path: str,
                redactions_path: str | None = None) -> None:
    """S8 + S9 at plain paths: redactions that are new are appended to the side table, then the sorted table is written.

    The side table, the only place of the originals once the staging area is
    gone, is never overwritten.  The table itself is replaced in place and can
    be written again from the staging area; ``publish_final`` swaps both.
    """
    out, red = assemble_with_redactions(spark, staging, kind, wordlist)
    if red is not None and redactions_path is not None:
        new = redaction_table(red)
        try:
            new = new.join(spark.read.parquet(redactions_path), ["token", "original"], "left_anti")
        except AnalysisException:
            pass
        cut_lineage(new, "redactions").write.mode("append").parquet(redactions_path)
    write_table(out, table_path, kind)


def publish_final(spark: SparkSession, staging: str, kind: str, wordlist: DataFrame | None, place: str) -> int:
    """S8 + S9 by swap: the sorted final table and the upserted side table become current together.

    ``place`` holds the published tables ``date``, ``entity``, ``month`` and
    ``redactions`` (``postlens.sources.publish``); the ones that this run does
    not build stay as they are.
    """
    out, red = assemble_with_redactions(spark, staging, kind, wordlist)
    write = {kind: lambda folder: write_table(out, folder, kind)}
    if red is not None:
        side = redaction_table(red, read_published(spark, place, "redactions"))
        write["redactions"] = lambda folder: side.write.parquet(folder)
    return publish(spark, place, write)
