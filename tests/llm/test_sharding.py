import zlib
from collections import Counter

import pytest

from postlens.llm import sharding as H
from tests.llm.helpers import CLASH, ROWS, docs, empty


def check(rows, shards, slack):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    total = sum(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= slack


def test_query(spark, sf_small):
    import __spark_entry__ as E
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = E.queries()["op10_shard"](spark, sf_small).collect()
    assert Counter(r.doc_id for r in rows) == Counter(text.keys())
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check(rows, 8, 2 * max(r.size for r in rows))


def test_a_hot_text_is_divided_and_others_stay_whole(spark):
    rows = [(i, "same text " * 20, "en", "s", 0) for i in range(900)] + [(1000 + i, f"t{i // 3} " * 25, "en", "s", 0) for i in range(1800)]
    got = H.shard(docs(spark, rows, False), 8).collect()
    check(got, 8, 600)
    shards = {}
    for r in got:
        if r.doc_id >= 1000:
            shards.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7          # only where a boundary falls


def test_slots_follow_the_key_order(spark):
    from pyspark.sql import functions as F
    got = (H.shard(docs(spark, [(i, f"text {i}", "en", "s", 0) for i in range(500)], False), 4, range_bytes=20)
           .withColumns({"a": F.xxhash64("text"), "b": F.xxhash64("doc_id")}).collect())
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted((r.a, r.b) for r in got)


def test_awkward_rows(spark):
    rows = H.shard(docs(spark), 8).collect()
    assert len(rows) == len(ROWS)
    check(rows, 8, 2 * max(r.size for r in rows))
    assert next(r for r in rows if r.doc_id == 2).size == 1
    kept = [c for c in CLASH if c not in ("size", "law", "shard", "slot")]
    assert all(rows[0][c] == f"extra-{c}" for c in kept)
    assert H.shard(empty(spark)).collect() == []


@pytest.mark.parametrize("key,bits,above", [((-(1 << 63), -(1 << 63)), 16, (-(1 << 63) + (1 << 48), -(1 << 63))),
                                            ((5, (1 << 63) - 256), 120, (6, -(1 << 63)))])
def test_boundaries(key, bits, above):
    assert H._above(key, bits) == above
