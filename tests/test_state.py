"""Mergeable month state: after every merge its tables equal a build from all files."""

import os
import random
import tempfile

import pytest

from postlens.operators import tables as TB
from postlens.sources import publish as PUB
from postlens.streaming import incremental as INC
from postlens.streaming import state as ST
from tests.helpers import entities, tweets

MONTHS = ["2013-01", "2013-02", "2013-03"]


def put(df, path):
    df.coalesce(1).write.mode("append").partitionBy("year_month").parquet(path)


def check(spark, root, top_n=2, entity_n=3):
    """The state's three tables against builds from the source files."""
    t = INC._read_months(spark, f"{root}/tweets", INC.TWEETS_SOURCE, MONTHS)
    e = INC._read_months(spark, f"{root}/entities", INC.ENTITIES_SOURCE, MONTHS)
    want = {"date": TB.date_rows(t, e, top_n), "entity": TB.entity_rows(t, e, entity_n), "month": TB.month_table(t)}
    for kind, rows in want.items():
        got = ST.state_rows(spark, f"{root}/state", kind, top_n, entity_n).select(*rows.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())), kind


def merge(spark, root, **kw):
    got = ST.merge_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/state", 2, **kw).collect()
    return {r.year_month: r.status for r in got}


def test_waves_equal_a_build_from_all_files(spark):
    """Repeated posts and mentions, null ids and names, names that read like buckets, a top list that moves."""
    root, rnd = tempfile.mkdtemp(prefix="postlens-state-"), random.Random(5)
    names = ["a", "b", "c", "d", "Other", "None", None]
    for wave in range(4):
        posts = [(rnd.choice(MONTHS), rnd.choice([str(i) for i in range(25)] + [None]), rnd.choice([None, 1, 2]), rnd.randrange(3),
                  rnd.choice([0, 0.3, 0.5, None]), rnd.choice([0, 0.25])) for _ in range(25)]
        liked = names[wave:] + [names[wave]] * 4               # another favourite every wave
        said = [(rnd.choice(MONTHS), rnd.choice([str(i) for i in range(30)] + [None]), rnd.choice(liked)) for _ in range(30)]
        if wave != 2:
            put(tweets(spark, posts), f"{root}/tweets")
        if wave != 1:
            put(entities(spark, said), f"{root}/entities")
        assert set(merge(spark, root, most_deltas=2).values()) == {"built"}
        check(spark, root)
    assert set(merge(spark, root).values()) == {"skipped"}
    state = ST.MonthState.open(spark, f"{root}/state", 2)
    assert len(state.deltas) <= 2                              # added up on the way
    pairs = state.read("pairs")
    assert pairs.count() == pairs.drop("v").distinct().count()


def start(spark):
    root = tempfile.mkdtemp(prefix="postlens-state-")
    put(tweets(spark, [(m, str(i), 1, 0, 0, 0) for m in MONTHS[:2] for i in range(6)]), f"{root}/tweets")
    put(entities(spark, [(m, str(i), "abc"[i % 3]) for m in MONTHS[:2] for i in range(5)]), f"{root}/entities")
    assert merge(spark, root) == {m: "built" for m in MONTHS[:2]}
    return root


def files(folder):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part") and f.endswith(".parquet"))


def test_a_late_file_reads_only_itself_and_the_state(spark):
    root = start(spark)
    kept = {}
    for source in ("tweets", "entities"):
        f, = files(f"{root}/{source}/year_month=2013-01")
        at, kept[f] = os.stat(f), open(f, "rb").read()
        with open(f, "wb") as out:
            out.write(b"x" * at.st_size)                       # unreadable, but listed as it was
        os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    put(tweets(spark, [("2013-01", "2", 5, 0, 0, 0)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", i, "c") for i in "013"]), f"{root}/entities")
    assert merge(spark, root) == {"2013-01": "built", "2013-02": "skipped"}
    for f, data in kept.items():
        with open(f, "wb") as out:
            out.write(data)
    crcs = [f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc" for f in kept]
    assert all(os.path.exists(c) for c in crcs)
    check(spark, root)


def test_replaced_and_vanished_files_restart_their_month(spark):
    root = start(spark)
    put(tweets(spark, [("2013-02", "2", 5, 0, 0, 0)]), f"{root}/tweets")
    assert merge(spark, root) == {"2013-01": "skipped", "2013-02": "built"}
    os.remove(files(f"{root}/entities/year_month=2013-02")[0])
    put(entities(spark, [("2013-02", "1", "z")]), f"{root}/entities")
    assert merge(spark, root) == {"2013-01": "skipped", "2013-02": "built"}
    check(spark, root)
    put(entities(spark, [("2013-02", "2", "y"), ("2013-01", "5", "y")]), f"{root}/entities")
    merge(spark, root)
    check(spark, root)
    ST.compact(spark, f"{root}/state", 2)
    check(spark, root)
    assert PUB.purge(spark, f"{root}/state", keep=1)
    check(spark, root)


def test_a_crash_or_a_second_writer_merges_nothing_twice(spark, monkeypatch):
    root = start(spark)
    put(tweets(spark, [("2013-01", "2", 5, 0, 0, 0)]), f"{root}/tweets")
    real = PUB._write_entry

    def dies(*_a):
        raise OSError("killed before the pointer moved")

    monkeypatch.setattr(PUB, "_write_entry", dies)
    assert merge(spark, root)["2013-01"] == "failed"
    monkeypatch.setattr(PUB, "_write_entry", real)
    inner = ST._merge

    def overtaken(*a):
        monkeypatch.setattr(ST, "_merge", inner)
        merge(spark, root)                                     # another writer, in between
        return inner(*a)

    monkeypatch.setattr(ST, "_merge", overtaken)
    with pytest.raises(PUB.PublishConflict):
        merge(spark, root)
    assert set(merge(spark, root).values()) == {"skipped"}
    check(spark, root)


def test_an_unreadable_month_fails_alone(spark):
    root = start(spark)
    bad = f"{root}/tweets/year_month=2013-01/part-broken.parquet"
    with open(bad, "wb") as f:
        f.write(b"not parquet")
    put(tweets(spark, [("2013-02", "2", 5, 0, 0, 0)]), f"{root}/tweets")
    assert merge(spark, root) == {"2013-01": "failed", "2013-02": "built"}
    os.remove(bad)
    assert merge(spark, root) == {"2013-01": "skipped", "2013-02": "skipped"}
    check(spark, root)


def test_streamed_merges_and_another_top_n(spark):
    root = start(spark)
    put(entities(spark, [("2013-02", "5", "c"), ("2013-02", "0", "c")]), f"{root}/entities")
    for _ in range(2):
        ST.stream_merge(spark, f"{root}/tweets", f"{root}/entities", f"{root}/state", f"{root}/ckpt", 2)
        check(spark, root)
    with pytest.raises(ValueError):
        ST.state_rows(spark, f"{root}/state", "date", 5)


def test_a_merge_too_large_to_look_posts_up(spark, monkeypatch):
    """All posts of the months are gone through instead of the touched ones: the same state, and one shuffle of posts and names."""
    monkeypatch.setattr(ST, "MOST_BROADCAST_NAMES", 0)
    root = start(spark)
    put(tweets(spark, [("2013-01", i, 5, 1, 0.5, 0) for i in ("2", "2", "5", "9", None)]), f"{root}/tweets")
    put(entities(spark, [("2013-01", i, n) for i in "01259" for n in ("c", "d", None)] + [("2013-02", "5", None)]), f"{root}/entities")
    seen, moves = [], ST._moves
    monkeypatch.setattr(ST, "_moves", lambda *a: seen.append(moves(*a)) or seen[-1])
    assert merge(spark, root) == {m: "built" for m in MONTHS[:2]}
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(year_month#") == 2 and "tweet_id" in plan     # by post, and the sums
    check(spark, root)


def test_the_fixture_writes_a_month_in_few_files(spark, tmp_path):
    from postlens.plans import catalog
    orders = spark.range(240).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1.0D * id AS o_totalprice",
                                         "CAST(add_months(DATE '1998-01-05', CAST(id % 3 AS INT)) AS TIMESTAMP) AS o_orderdate")
    lines = spark.range(480).selectExpr("id % 240 AS l_orderkey", "id % 5 AS l_partkey", "0.0D AS l_discount")
    parts = spark.range(5).selectExpr("id AS p_partkey", "concat('B', id) AS p_brand", "'PROMO' AS p_type")
    for name, rows, n in (("orders", orders, 8), ("lineitem", lines, 8), ("part", parts, 1)):
        rows.repartition(n).write.parquet(f"{tmp_path}/{name}.parquet")
    root = os.path.dirname(catalog._merged_state(spark, str(tmp_path)))
    for source, of in (("tweets", 240), ("entities", 480)):
        assert spark.read.parquet(f"{root}/{source}").count() == of
        assert sum(len(files(f"{root}/{source}/{m}")) for m in os.listdir(f"{root}/{source}") if m.startswith("year_month=")) <= 12


def test_a_merge_that_failed_for_a_month_is_no_result(spark, tmp_path, monkeypatch):
    """The query names the month and why; it does not return the other months as if they were all."""
    from postlens.plans import catalog
    orders = spark.range(60).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1.0D * id AS o_totalprice",
                                        "CAST(add_months(DATE '1998-01-05', CAST(id % 3 AS INT)) AS TIMESTAMP) AS o_orderdate")
    lines = spark.range(120).selectExpr("id % 60 AS l_orderkey", "id % 5 AS l_partkey", "0.0D AS l_discount")
    parts = spark.range(5).selectExpr("id AS p_partkey", "concat('B', id) AS p_brand", "'SMALL' AS p_type")
    for name, rows in (("orders", orders), ("lineitem", lines), ("part", parts)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    real = ST.merge_months

    def merge_broken(spark, tweets_path, *a, **kw):
        with open(f"{tweets_path}/year_month=1998-02/part-broken.parquet", "wb") as f:
            f.write(b"not parquet")
        return real(spark, tweets_path, *a, **kw)

    monkeypatch.setattr(ST, "merge_months", merge_broken)
    with pytest.raises(RuntimeError, match="1998-02: .*part-broken"):
        catalog.QUERIES["merged_entity_table"](spark, str(tmp_path))
    monkeypatch.setattr(ST, "merge_months", real)
    got = catalog.QUERIES["merged_entity_table"](spark, str(tmp_path))      # a failure is not kept as the session's state
    assert {r.year_month for r in got.collect()} == {"1998-01", "1998-02", "1998-03"}


def test_a_month_of_mentions_alone_that_fails_is_reported(spark):
    root = start(spark)
    os.makedirs(f"{root}/entities/year_month=2013-03")
    with open(f"{root}/entities/year_month=2013-03/part-broken.parquet", "wb") as f:
        f.write(b"not parquet")
    assert merge(spark, root) == {"2013-01": "skipped", "2013-02": "skipped", "2013-03": "failed"}
    got = ST.stream_merge(spark, f"{root}/tweets", f"{root}/entities", f"{root}/state", f"{root}/ckpt", 2)
    assert {r.year_month: r.status for r in got.collect()}["2013-03"] == "failed"
