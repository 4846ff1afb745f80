import numpy as np
import pytest

from postlens.llm import ann, topk
from tests.llm.helpers import assert_oracle

VECTORS = "vec_id long, embedding array<float>, label int, v int, n int, query_id int, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0, 0) for i, v in rows], VECTORS)


def awkward():
    pick = np.random.default_rng(5)
    good = [(i, [float(x) for x in pick.normal(size=6).astype(np.float32)]) for i in range(60)]
    same = [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]) for i in range(100, 180)]
    bad = [(200, None), (250, [float("nan")] * 6), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (350, [float("inf")] + [1.0] * 5),
           (400, []), (None, [1.0] * 6)]
    return good + same + bad + [good[3]]


def usable(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}


def brute_topk(vectors, k, every):
    ints = {i: np.floor(256 * v).astype(np.int64) for i, v in vectors.items()}
    out = []
    for q in ints:
        if q % every == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_exact_oracle(spark, sf_small):
    assert_oracle(spark, sf_small, "op5_exact_topk")


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_exact_top_k(spark, lists):
    rows = awkward() + [(20_000 + i, [1.0, float(i)]) for i in range(3)]           # another length: few candidates
    got = sorted(map(tuple, topk.top_k(table(spark, rows), 5, 10, lists=lists).collect()))
    assert got == brute_topk(usable(rows), 5, 10)


def test_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", 200)
    rows = awkward()
    assert sorted(map(tuple, topk.top_k(table(spark, rows), 3, 30).collect())) == brute_topk(usable(rows), 3, 30)


def test_large_integers_stay_exact(spark):
    rows = [(i, [3e8 + i, 1.0]) for i in range(0, 12)]                             # scores pass 2**53
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, 2, 6, scale=1).collect()
    ints = {i: [int(x) for x in v] for i, v in rows}
    assert len(got) == 4
    assert all(r.score == sum(a * b for a, b in zip(ints[r.query_id], ints[r.vec_id])) for r in got)


@pytest.mark.parametrize("large", [3e13, 1e300, -3e13])
def test_scores_beyond_64_bits_are_refused(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(df, 2, 6)
    if abs(large) > 1e200:
        with pytest.raises(ValueError):
            ann.nearest(df, 2, 6)


def test_no_queries_or_rows(spark):
    assert topk.top_k(table(spark, [(1, [1.0])])).collect() == []
    assert topk.top_k(table(spark, [])).collect() == []
    assert ann.nearest(table(spark, [])).collect() == []


def test_nearest_finds_all_of_a_small_table(spark):
    rows = awkward() + [(500, [0.0] * 6)]
    vectors = {i: v for i, v in usable(rows).items() if v.any()}
    got = ann.nearest(table(spark, rows), 20, 20, goal=1.0).collect()
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-float(vectors[q] @ vectors[c]), c) for c in vectors if c != q)[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in best], abs=1e-9)
        assert [m[1] for m in mine if m[1] >= 100] == sorted(m[1] for m in mine if m[1] >= 100)      # ties by id
        assert {m[1] for m in mine} == {c for _, c in best}


def clustered(n, seed=1):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(30, 24))
    x = centres[pick.integers(0, 30, n)] + 0.8 * pick.normal(size=(n, 24))
    return x * pick.uniform(0.5, 2, (n, 1))                # norms differ


def test_recall(spark):
    x = clustered(6000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, 20, 20, sample=2000).collect()
    ask = np.arange(0, 6000, 20)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -np.inf
    truth = {int(q): set(np.argsort(-row)[:20].tolist()) for q, row in zip(ask, s)}
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))
    assert all(len(f) == 20 for f in found.values()) and len(found) == len(truth)
    assert np.mean([len(truth[q] & found[q]) / 20 for q in truth]) >= 0.9


def test_graph_search_finds_the_near_centroids():
    c = clustered(800, 3)
    q = clustered(100, 4)
    ids, d = ann.graph_search(q, c, ann.neighbour_graph(c), 32)         # the beam a query starts with
    exact = np.argsort(ann._squared(q, c), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, exact)]) >= 0.9
    assert (np.diff(d, axis=1) >= -1e-9).all() and all(len(set(r)) == len(r) for r in ids.tolist())


def test_crowded_lists_go_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    rows = awkward()
    vectors = usable(rows)
    got = ann.nearest(table(spark, rows), 5, 20, goal=1.0).collect()
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-float(vectors[q] @ vectors[c]), c) for c in vectors if c != q)[:5]
        assert [c for _, c in best] == [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]


def test_every_length_has_an_index(spark):
    pick = np.random.default_rng(8)
    rows = [(i, pick.normal(size=3 if i % 3 else 5).tolist()) for i in range(240)] + [(400, [1.0] * 7), (420, [2.0]), (421, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, got = {i: np.array(v) for i, v in rows}, {}
    for r in ann.nearest(df, 4, 20, goal=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-float(vectors[q] @ vectors[c]), c) for c in vectors if c != q and len(vectors[c]) == len(vectors[q]))[:4]
        assert [c for _, c in sorted(got.get(q, []))] == [c for _, c in best]


def test_small_tables_go_through_the_index(spark):
    """500 vectors, no switch by size: recall holds while lists are left out."""
    x = clustered(500, 6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, 20, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(25), np.arange(0, 500, 20)] = -np.inf
    assert np.mean([len(got[20 * i] & set(np.argsort(-row)[:20].tolist())) / 20 for i, row in enumerate(s)]) >= 0.9


def test_the_sample_is_the_lowest_by_hash(spark):
    from pyspark.sql import functions as F

    from postlens.llm.common import lowest_by_hash
    df = spark.range(0, 5000, 1, 16).withColumnRenamed("id", "k")
    ids = lambda d: [r.k for r in d.collect()]
    want = ids(df.orderBy(F.xxhash64("k"), "k"))
    assert all(ids(lowest_by_hash(df, n, "k")) == want[:n] for n in (1, 700, 4900, 6000))
    assert ids(lowest_by_hash(df.limit(0), 5, "k")) == []
