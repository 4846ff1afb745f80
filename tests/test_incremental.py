"""Incremental month builds: resume skips done months, late data rebuilds a month."""

import os
import tempfile
import time

import pytest

from postlens.operators import tables as TB
from postlens.streaming import incremental as INC
from tests.helpers import entities, tweets


def test_resume_and_late_month(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    t1 = tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "2", 1, 0, 0, 0)])
    e = entities(spark, [("2013-01", "1", "a"), ("2013-02", "2", "b"), ("2013-03", "3", "c")])
    e.write.partitionBy("year_month").parquet(f"{root}/entities")
    t1.write.partitionBy("year_month").parquet(f"{root}/tweets")
    st = f"{root}/staging"
    s1 = {r.year_month: r.status for r in
          INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", st, "date", 5).collect()}
    assert s1 == {"2013-01": "built", "2013-02": "built"}
    time.sleep(1.1)
    late = tweets(spark, [("2013-02", "4", 5, 0, 0, 0), ("2013-03", "3", 2, 0, 0, 0)])
    late.write.mode("append").partitionBy("year_month").parquet(f"{root}/tweets")
    s2 = {r.year_month: r.status for r in
          INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", st, "date", 5).collect()}
    assert s2 == {"2013-01": "skipped", "2013-02": "built", "2013-03": "built"}
    final = INC.assemble(spark, st, "date", None)
    allt = t1.unionByName(late)
    expect = TB.date_table(allt, e, 5)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, expect.collect()))


def build(spark, root, kind="date", **kw):
    got = INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging-{kind}", kind, 5, **kw).collect()
    return {r.year_month: r.status for r in got}


def put(df, path):
    df.write.mode("append").partitionBy("year_month").parquet(path)


@pytest.mark.parametrize("damage", ["all", "pages"])
def test_unreadable_month_fails_alone_and_is_repaired(spark, damage):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(entities(spark, [("2013-01", "1", "a"), ("2013-02", "2", "b")]), f"{root}/entities")
    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0)]), f"{root}/tweets")
    rows = tweets(spark, [("2013-02", str(i), i, 0, 0, 0) for i in range(5000)]).coalesce(1)
    put(rows, f"{root}/tweets")
    folder = f"{root}/tweets/year_month=2013-02"
    name, = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    good = open(os.path.join(folder, name), "rb").read()
    bad = b"not parquet" if damage == "all" else good[:4] + b"\xff" * (len(good) // 2) + good[4 + len(good) // 2:]
    crc = os.path.join(folder, f".{name}.crc")
    if os.path.exists(crc):
        os.rename(crc, os.path.join(root, "crc"))
    with open(os.path.join(folder, name), "wb") as f:
        f.write(bad)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        assert build(spark, root) == {"2013-01": "built", "2013-02": "failed"}
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    assert {r.year_month for r in INC.assemble(spark, f"{root}/staging-date", "date", None).collect()} == {"2013-01"}
    with open(os.path.join(folder, name), "wb") as f:
        f.write(good)
    os.utime(os.path.join(folder, name), (1, 1))                       # older than anything staged
    assert build(spark, root) == {"2013-01": "skipped", "2013-02": "built"}
    got = INC.assemble(spark, f"{root}/staging-date", "date", None)
    assert got.filter("year_month = '2013-02'").agg({"post_count": "sum"}).first()[0] == 5000


def test_late_files_count_whatever_their_time(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", "1", "a")]), f"{root}/entities")
    assert build(spark, root) == {"2013-01": "built"} and build(spark, root) == {"2013-01": "skipped"}
    before = set(os.listdir(f"{root}/tweets/year_month=2013-01"))
    put(tweets(spark, [("2013-01", "2", 1, 0, 0, 0)]), f"{root}/tweets")
    for f in set(os.listdir(f"{root}/tweets/year_month=2013-01")) - before:
        os.utime(f"{root}/tweets/year_month=2013-01/{f}", (1, 1))
    assert build(spark, root) == {"2013-01": "built"}
    put(entities(spark, [("2013-01", "2", "b")]), f"{root}/entities")
    assert build(spark, root) == {"2013-01": "built"}
    got = {r.entity: r.post_count for r in INC.assemble(spark, f"{root}/staging-date", "date", None).collect()}
    assert got == {"a": 1, "b": 1}
    assert build(spark, root, resume=False) == {"2013-01": "built"}


def test_months_without_mentions_or_posts(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(tweets(spark, [("2013-01", str(i), 1, 2, 0, 0) for i in range(10)]), f"{root}/tweets")
    tweets(spark, []).drop("year_month").coalesce(1).write.parquet(f"{root}/tweets/year_month=2013-02")
    want = {"2013-01": "built", "2013-02": "built"}
    assert build(spark, root) == want and build(spark, root, "month") == want and build(spark, root) == {m: "skipped" for m in want}
    date = INC.assemble(spark, f"{root}/staging-date", "date", None).collect()
    assert [(r.year_month, r.entity, r.post_count) for r in date] == [("2013-01", "None", 10)]
    month = INC.assemble(spark, f"{root}/staging-month", "month", None).collect()
    assert sorted(map(tuple, month)) == [("2013-01", 10, 20, 10), ("2013-02", 0, 0, 0)]


def test_late_entities_rebuild_streamed_months(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")

    def run():
        INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", f"{root}/ckpt", "date", 5)
        return sorted((r.year_month, r.entity, r.post_count) for r in INC.assemble(spark, f"{root}/staging", "date", None).collect())

    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-01", "2", 1, 0, 0, 0), ("2013-02", "3", 1, 0, 0, 0)]), f"{root}/tweets")
    assert run() == [("2013-01", "None", 2), ("2013-02", "None", 1)]
    put(entities(spark, [("2013-01", "1", "a")]), f"{root}/entities")
    assert run() == [("2013-01", "None", 1), ("2013-01", "a", 1), ("2013-02", "None", 1)]
    put(entities(spark, [("2013-02", "3", "b"), ("2013-01", "2", "a"), ("2013-05", "9", "z")]), f"{root}/entities")
    assert run() == [("2013-01", "a", 2), ("2013-02", "b", 1)]


def test_rebuild_reads_its_months_only(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    months = [f"2013-{m:02d}" for m in range(1, 13)]
    put(tweets(spark, [(m, str(i), 1, 0, 0, 0) for i, m in enumerate(months)]), f"{root}/tweets")
    put(entities(spark, [(m, str(i), "a") for i, m in enumerate(months)]), f"{root}/entities")
    rows = INC.build_rows(spark, f"{root}/tweets", f"{root}/entities", ["2013-04"], "date", 5)
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert scans and all("2013-04" in x for x in scans)
    assert {os.path.dirname(f).rpartition("=")[2] for f in
            INC._read_months(spark, f"{root}/tweets", INC.TWEETS_SOURCE, ["2013-04"]).select("_metadata.file_path").distinct()
            .toPandas()["file_path"]} == {"2013-04"}


def test_final_table_and_side_table(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "2", 1, 0, 0, 0)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", "1", "son of a gun"), ("2013-02", "2", "fine")]), f"{root}/entities")
    words = spark.createDataFrame([("Son-of A",)], "word string")
    for kind in ("date", "entity"):
        build(spark, root, kind)
        INC.write_final(spark, f"{root}/staging-{kind}", kind, words, f"{root}/final-{kind}", f"{root}/side")
    side = spark.read.parquet(f"{root}/side").collect()
    assert [r.original for r in side] == ["son of a gun"]
    for kind in ("date", "entity"):
        got = spark.read.parquet(f"{root}/final-{kind}")
        assert dict(got.dtypes)["positive_sentiment"] == "float"
        assert sorted(r.entity for r in got.collect()) == sorted([side[0].token, "fine"])


def damage(folder):
    """A file that is no parquet, as a broken delivery leaves it."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-broken.parquet", "wb") as f:
        f.write(b"not parquet")
    return f"{folder}/part-broken.parquet"


@pytest.mark.parametrize("source,mend", [("tweets", "taken away"), ("tweets", "replaced in place"), ("entities", "new name")])
def test_stream_isolates_a_bad_month_and_mends_it(spark, source, mend):
    import shutil
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "2", 1, 0, 0, 0)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", "1", "a"), ("2013-02", "2", "b")]), f"{root}/entities")
    bad = damage(f"{root}/{source}/year_month=2013-02")

    def run():
        got = INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", f"{root}/ckpt", "date", 5).collect()
        return {r.year_month: (r.status, bool(r.error)) for r in got}

    assert run() == {"2013-01": ("built", False), "2013-02": ("failed", True)}
    assert {r.year_month for r in INC.assemble(spark, f"{root}/staging", "date", None).collect()} == {"2013-01"}
    held = INC.quarantined(spark, f"{root}/staging").collect()
    assert {r.year_month for r in held} == {"2013-02"} and bad in {r.file.removeprefix("file:") for r in held}
    assert run() == {"2013-01": ("skipped", False), "2013-02": ("failed", True)}      # nothing new: it is not tried again
    put(tweets(spark, [("2013-03", "3", 1, 0, 0, 0)]), f"{root}/tweets")
    assert run() == {"2013-01": ("skipped", False), "2013-02": ("failed", True), "2013-03": ("built", False)}
    os.remove(bad)
    late = tweets(spark, [("2013-02", "4", 1, 0, 0, 0)]) if source == "tweets" else entities(spark, [("2013-02", "2", "c")])
    if mend != "taken away":
        other = tempfile.mkdtemp(prefix="postlens-inc-")
        late.drop("year_month").coalesce(1).write.mode("overwrite").parquet(other)
        part, = [f for f in os.listdir(other) if f.startswith("part") and f.endswith(".parquet")]
        shutil.copy(f"{other}/{part}", bad if mend == "replaced in place" else bad.replace("broken", "mended"))
    assert run()["2013-02"] == ("built", False)
    assert INC.quarantined(spark, f"{root}/staging").isEmpty()
    t, e = (INC._read_months(spark, f"{root}/{n}", s, ["2013-01", "2013-02", "2013-03"])
            for n, s in (("tweets", INC.TWEETS_SOURCE), ("entities", INC.ENTITIES_SOURCE)))
    want = sorted(map(tuple, TB.date_table(t, e, 5).collect()))
    assert sorted(map(tuple, INC.assemble(spark, f"{root}/staging", "date", None).collect())) == want


def test_batch_and_stream_share_one_manifest(spark):
    root = tempfile.mkdtemp(prefix="postlens-inc-")
    put(tweets(spark, [("2013-01", "1", 1, 0, 0, 0), ("2013-02", "2", 1, 0, 0, 0)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", "1", "a")]), f"{root}/entities")
    bad = damage(f"{root}/tweets/year_month=2013-02")
    st = f"{root}/staging-date"
    INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", st, f"{root}/ckpt", "date", 5)
    assert build(spark, root) == {"2013-01": "skipped", "2013-02": "failed"}
    os.remove(bad)
    assert build(spark, root) == {"2013-01": "skipped", "2013-02": "built"}
    assert INC.quarantined(spark, st).isEmpty()
    got = INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", st, f"{root}/ckpt", "date", 5).collect()
    assert {r.status for r in got} == {"skipped"}


def test_isolation_halves_the_months():
    from postlens.sources.manifest import run_isolated
    asked = []

    def build(some):
        asked.append(list(some))
        if {"m07", "m50"} & set(some):
            raise OSError(f"bad {some}")

    months = [f"m{i:02d}" for i in range(64)]
    failed = run_isolated(months, build)
    assert set(failed) == {"m07", "m50"} and failed["m07"].startswith("bad")
    built = [m for some in asked if not {"m07", "m50"} & set(some) for m in some]
    assert sorted(built) == sorted(set(months) - {"m07", "m50"}) and len(asked) <= 4 * 6 + 1
    assert run_isolated([], build) == {}


def test_a_failure_that_is_not_of_the_months_files_is_raised():
    """Code, disk or cluster: no month is to blame; the others are built first."""
    from postlens.sources.manifest import run_isolated
    months, built = [f"m{i:02d}" for i in range(8)], []

    def build(some):
        if "m01" in some:
            raise OSError("unreadable")
        if "m03" in some:
            raise KeyError("a fault of the code")
        built.extend(some)

    with pytest.raises(KeyError, match="a fault of the code") as e:
        run_isolated(months, build)
    assert sorted(built) == sorted(set(months) - {"m01", "m03"}) and "m03" in e.value.__notes__[0]


@pytest.mark.parametrize("kind", ["vanished", "values"])
def test_a_months_own_files_fail_their_month(spark, kind, tmp_path):
    from postlens.sources.manifest import run_isolated
    src = f"{tmp_path}/src"
    spark.createDataFrame([("99999999999",)], "a string").coalesce(1).write.parquet(src)

    def build(_some):
        rows = spark.read.parquet(src).selectExpr("CAST(a AS int) AS a")
        if kind == "vanished":
            for f in os.listdir(src):
                os.remove(f"{src}/{f}")
        rows.write.parquet(f"{tmp_path}/out")

    assert list(run_isolated(["m01"], build)) == ["m01"]
