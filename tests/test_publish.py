"""Publishing by swap: a crash at any point leaves the version before it; tables change together."""

import os
import tempfile

import pytest

from postlens.sources import publish as PUB
from postlens.streaming import incremental as INC
from tests.helpers import entities, tweets


def place():
    return tempfile.mkdtemp(prefix="postlens-pub-") + "/final"


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def put(spark, at, **tables):
    return PUB.publish(spark, at, {n: (lambda folder, v=v: rows(spark, *v).write.parquet(folder)) for n, v in tables.items()})


def read(spark, at, table):
    df = PUB.read_published(spark, at, table)
    return None if df is None else sorted(r.v for r in df.collect())


def test_versions_and_tables_left_alone(spark):
    at = place()
    assert PUB.current(spark, at) == (0, {}) and read(spark, at, "a") is None
    assert put(spark, at, a=[1], b=[2]) == 1
    before = PUB.read_published(spark, at, "a")
    assert put(spark, at, a=[3, 4]) == 2
    assert read(spark, at, "a") == [3, 4] and read(spark, at, "b") == [2]
    assert [r.v for r in before.collect()] == [1]                 # a reader of the version before is not disturbed


def test_failure_while_writing_leaves_the_version_before(spark):
    at = place()
    put(spark, at, a=[1], b=[2])

    def dies(folder):
        rows(spark, 9).write.parquet(folder)
        raise OSError("disk full")

    with pytest.raises(OSError):
        PUB.publish(spark, at, {"a": lambda f: rows(spark, 8).write.parquet(f), "b": dies})
    assert read(spark, at, "a") == [1] and read(spark, at, "b") == [2]
    put(spark, at, a=[5])
    assert read(spark, at, "a") == [5]


def test_crash_between_data_and_pointer(spark, monkeypatch):
    at = place()
    put(spark, at, a=[1])
    whole = PUB._write_entry
    monkeypatch.setattr(PUB, "_write_entry", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        put(spark, at, a=[2])
    assert read(spark, at, "a") == [1]
    monkeypatch.setattr(PUB, "_write_entry", whole)
    assert put(spark, at, a=[3]) == 2 and read(spark, at, "a") == [3]


@pytest.mark.parametrize("text", ["", '{"a": "a/00', '{"a": "a/x"}'])
def test_half_written_pointer_is_not_read(spark, text):
    at = place()
    put(spark, at, a=[1])
    with open(f"{at}/_log/{2:010d}", "w") as f:
        f.write(text)
    assert read(spark, at, "a") == [1]
    assert put(spark, at, a=[2]) == 3 and read(spark, at, "a") == [2]


def test_second_of_two_writers_fails_and_loses_nothing(spark):
    at = place()
    put(spark, at, a=[1])

    def meanwhile(folder):
        rows(spark, 2).write.parquet(folder)
        put(spark, at, b=[7])

    with pytest.raises(PUB.PublishConflict):
        PUB.publish(spark, at, {"a": meanwhile})
    assert read(spark, at, "a") == [1] and read(spark, at, "b") == [7]


def test_purge_keeps_what_is_in_force(spark):
    at = place()
    for v in (1, 2, 3):
        put(spark, at, a=[v])
    put(spark, at, b=[9])
    assert len(PUB.purge(spark, at, keep=2)) == 2
    assert read(spark, at, "a") == [3] and read(spark, at, "b") == [9]
    assert len(os.listdir(f"{at}/a")) == 1
    assert PUB.purge(spark, at, keep=2) == []


def staged(spark, root, name):
    tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "2", 1, 0, 0, 0)]).write.mode("overwrite").partitionBy("year_month").parquet(f"{root}/tweets")
    entities(spark, [("2013-01", "1", name), ("2013-02", "2", "fine")]).write.mode("overwrite").partitionBy("year_month").parquet(f"{root}/entities")
    for kind in ("date", "entity"):
        INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging-{kind}", kind, 5)


def test_final_and_side_table_are_swapped_together(spark, monkeypatch):
    root, at = tempfile.mkdtemp(prefix="postlens-inc-"), place()
    words = spark.createDataFrame([("dirty",), ("filthy",)], "word string")

    def state():
        return (sorted(r.entity for r in PUB.read_published(spark, at, "date").collect()),
                sorted(r.original for r in PUB.read_published(spark, at, "redactions").collect()))

    staged(spark, root, "dirty")
    INC.publish_final(spark, f"{root}/staging-date", "date", words, at)
    first = state()
    assert first[1] == ["dirty"] and "dirty" not in first[0]
    staged(spark, root, "filthy")
    with monkeypatch.context() as m:
        m.setattr(PUB, "_write_entry", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            INC.publish_final(spark, f"{root}/staging-date", "date", words, at)
    assert state() == first
    INC.publish_final(spark, f"{root}/staging-date", "date", words, at)
    INC.publish_final(spark, f"{root}/staging-entity", "entity", words, at)
    assert state()[1] == ["dirty", "filthy"]                       # originals of earlier runs stay
    token = {r.original: r.token for r in PUB.read_published(spark, at, "redactions").collect()}
    assert token["filthy"] in {r.entity for r in PUB.read_published(spark, at, "entity").collect()}


def test_plain_side_table_is_never_overwritten(spark, monkeypatch):
    """A crash while the final table is replaced leaves every original in the side table."""
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    words = spark.createDataFrame([("dirty",), ("filthy",)], "word string")
    for name in ("dirty", "filthy"):
        staged(spark, root, name)
        with monkeypatch.context() as m:
            m.setattr(INC, "write_table", lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                INC.write_final(spark, f"{root}/staging-date", "date", words, f"{root}/final", f"{root}/side")
        INC.write_final(spark, f"{root}/staging-date", "date", words, f"{root}/final", f"{root}/side")
    assert sorted(r.original for r in spark.read.parquet(f"{root}/side").collect()) == ["dirty", "filthy"]
