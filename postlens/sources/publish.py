"""Publishing by swap (S8, S9): a reader sees all of a publication or none of it.

A published place is a folder of table versions and a log.  Log entry N names,
for every table, the folder of its current version; the entry with the
greatest number that is complete is the pointer.  A publication writes new
folders first, then one log entry: tables that belong together (a table and
the originals behind its redactions) change together, and a crash at any point
leaves the entry before it in force, with its folders untouched.  An entry is
created only if it does not exist, so of two writers that started from the
same one the second fails and loses nothing.

Log entries are a line each, read and written by the driver; table data never
passes through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class PublishConflict(RuntimeError):
    """Another writer published since this one read the log."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A new small file at a path that only Spark's file systems may reach; fails if there is one."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    out.write(bytearray(data))
    out.close()


def delete_file(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, False)


def _entries(spark: SparkSession, place: str) -> list[int]:
    """Numbers of the log's entries, complete or not."""
    p, fs = _fs(spark, f"{place.rstrip('/')}/_log")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def _entry(spark: SparkSession, place: str, number: int) -> dict[str, str] | None:
    """Table -> folder of an entry; None if its writer died while writing it."""
    p, fs = _fs(spark, f"{place.rstrip('/')}/_log/{number:010d}")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("}\n") else None


def _write_entry(spark: SparkSession, place: str, number: int, tables: dict[str, str]) -> None:
    path = f"{place.rstrip('/')}/_log/{number:010d}"
    p, fs = _fs(spark, path)
    if fs.exists(p):
        raise PublishConflict(f"{place}: entry {number} was published by another writer")
    try:
        put_bytes(spark, path, (json.dumps(tables, sort_keys=True) + "\n").encode())
    except Py4JJavaError as e:
        if fs.exists(p):
            raise PublishConflict(f"{place}: entry {number} was published by another writer") from e
        raise


def current(spark: SparkSession, place: str) -> tuple[int, dict[str, str]]:
    """(number, table -> folder) of the entry in force; (0, {}) before the first."""
    for number in reversed(_entries(spark, place)):
        tables = _entry(spark, place, number)
        if tables is not None:
            return number, tables
    return 0, {}


def read_published(spark: SparkSession, place: str, table: str) -> DataFrame | None:
    """The table as published last; None if it never was."""
    folder = current(spark, place)[1].get(table)
    return None if folder is None else spark.read.parquet(f"{place.rstrip('/')}/{folder}")


def publish(spark: SparkSession, place: str, write: dict[str, Callable[[str], None]], drop=(),
            since: int | None = None) -> int:
    """Write new versions of the tables in ``write`` (name -> function of a folder) and move the pointer to them.

    Tables that are not in ``write`` stay as published, but for those named in
    ``drop``.  Returns the entry's number.  If a function fails, or another
    writer publishes meanwhile, the pointer stays and the folders written so
    far are never read.  ``since`` is the entry that the rows were made from:
    if another is in force by now, nothing is written.
    """
    place = place.rstrip("/")
    found, tables = current(spark, place)
    if since is not None and found != since:
        raise PublishConflict(f"{place}: entry {found} was published since entry {since} was read")
    tables = {name: folder for name, folder in tables.items() if name not in drop}
    number = max(_entries(spark, place), default=0) + 1
    new = {name: f"{name}/{number:010d}-{uuid.uuid4().hex}" for name in write}
    for name, folder in new.items():
        write[name](f"{place}/{folder}")
    _write_entry(spark, place, number, {**tables, **new})
    return number


def purge(spark: SparkSession, place: str, keep: int = 2) -> list[str]:
    """Delete the folders that none of the last ``keep`` complete entries names, nor any writer newer than they.

    Returns the folders deleted.  Log entries stay (a line each).
    """
    place, kept = place.rstrip("/"), []
    for number in reversed(_entries(spark, place)):
        tables = _entry(spark, place, number)
        if tables is not None and len(kept) < max(1, keep):
            kept.append((number, tables))
    if not kept:
        return []
    used, newest, gone = {f for _, t in kept for f in t.values()}, kept[0][0], []
    p, fs = _fs(spark, place)
    for table in fs.listStatus(p):
        name = table.getPath().getName()
        if name.startswith("_") or not table.isDirectory():
            continue
        for version in fs.listStatus(table.getPath()):
            folder = f"{name}/{version.getPath().getName()}"
            number = version.getPath().getName().split("-")[0]
            if folder not in used and number.isdigit() and int(number) <= newest:
                fs.delete(version.getPath(), True)
                gone.append(folder)
    return sorted(gone)
