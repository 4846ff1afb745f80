import re

import numpy as np
import pytest
import xxhash

from postlens.llm import simhash as S
from postlens.llm.components import components
from tests.llm.helpers import DOCS, ROWS, docs, empty


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 62).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints():
    for t in [None, "", " \t", "one", "a b c", "a b c d", "A b C d e É", "x\u00a0y z\x0bw v\x0cu t\x1cs", "w " * 70_000]:
        assert S.simhash(t) == slow_fingerprint(t)


def test_query_against_brute_force(spark, sf_small):
    import __spark_entry__ as E
    got = E.queries()["op3_simhash"](spark, sf_small).toPandas().sort_values("doc_id")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert len(got) == len(text)
    want = [slow_fingerprint(text[d]) for d in got.doc_id]
    assert got.fingerprint.tolist() == [f"{w:016x}" for w in want]
    assert got.component_id.tolist() == brute_components(got.doc_id.tolist(), want)


@pytest.mark.parametrize("dimension,cell", [(6, 1 << 20), (10, 16), (13, 7)])
def test_links_lose_none(spark, dimension, cell):
    pick = np.random.default_rng(3)
    base = pick.integers(0, 2 ** 63, 60).astype(np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():                       # chains of 1 to 6 flipped bits, and one dense group
        for _ in range(6):
            for bit in pick.choice(64, pick.integers(1, 7), replace=False).tolist():
                b ^= 1 << bit
            fps.add(b)
    centre = int(base[0])
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    links = S.links(df, 4, dimension, homes_a_cell=cell, replicas_a_cell=cell * 4)
    u = lambda x: x % (1 << 64)
    found = [(u(r.a), u(r.b)) for r in links.collect()]
    index = {f: i for i, f in enumerate(fps)}
    assert all(a in index and b in index for a, b in found)
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in found:
        x, y = top(index[a]), top(index[b])
        label[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_covering_code_is_linear_and_distinct():
    code = S.covering_code(13)
    assert len(set(code.tolist())) == 1 << 13 and (code[5] ^ code[9]) in code
    assert np.bitwise_count(code[1:]).min() == 24


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 50), (101, 100), (7, 7), (200, 201), (200, 202), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_awkward_rows(spark):
    got = S.near_duplicates(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[4].component_id == 2
    assert by[6].component_id == 5 and by[10].component_id == 1
    assert by[None].component_id is None
    kept = S.drop_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({r.component_id for r in got if r.component_id is not None})
    assert S.near_duplicates(empty(spark)).collect() == [] and S.drop_near_duplicates(empty(spark)).collect() == []


def test_one_of_equal_rows_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e", "en", "s", 1)] * 3 + [(None, "q w e r t y", "en", "s", 1)] * 2, DOCS)
    assert sorted(str(r.doc_id) for r in S.drop_near_duplicates(df).collect()) == ["1", "None"]
