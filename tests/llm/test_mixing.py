import random

import pytest
from pyspark.sql import functions as F

from postlens.llm import mixing as M
from tests.llm.helpers import assert_oracle, docs, empty


def targets(sizes: dict, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    """Reshare round by round what sources above their cap leave."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free = {}, set(order)
    while free:
        left = share * sum(sizes.values()) - sum(fixed.values())
        now = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return {**fixed, **now}
        fixed |= {s: most * sizes[s] for s in over}
        free -= over
    return fixed


def test_oracle(spark, sf_small):
    assert_oracle(spark, sf_small, "op2_mix_sources")


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", s, 0) for i, s in enumerate(["a", "b", "c", "d", None, "Z", "é"] * 60)]
    got = M.mix(docs(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) < 3
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_reruns_agree_and_order_does_not_matter(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 3}", 0) for i in range(200)]
    one = sorted(map(tuple, M.mix(docs(spark, rows, False)).select("doc_id", "taken").collect()))
    two = sorted(map(tuple, M.mix(docs(spark, rows[::-1], False).repartition(7)).select("doc_id", "taken").collect()))
    assert one == two


def test_unequal_weights_draw_heavier_documents_more_often(spark):
    rows = [(i, "w w w", "en", "a", i % 2) for i in range(2000)]
    df = docs(spark, rows, False)
    mixed = M.mix(df, weight=F.when(F.col("n_chars") == 1, 3.0).otherwise(1.0), share=0.4)
    n = {r.n_chars: r.n for r in mixed.where("taken > 0").groupBy("n_chars").agg(F.sum("copies").alias("n")).collect()}
    assert n[0] + n[1] == 800 and 2.2 < n[1] / n[0] < 4


@pytest.mark.parametrize("ids", ["repeated", "null", "some"])
def test_ties_are_taken_as_far_as_they_fit(spark, ids):
    """A source of one repeated row, of rows without ids, and of ties among other rows."""
    def doc_id(i):
        return {"repeated": 7, "null": None, "some": i % 5 or i}[ids]

    rows = [(doc_id(i), "w " * (12 if ids == "repeated" else 5 + i % 3), "en", "a", 0) for i in range(1000)]
    rows += [(10_000 + i, "w " * 4, "en", "b", 0) for i in range(200)]
    got = M.mix(docs(spark, rows, False).repartition(5)).collect()
    assert len(got) == 1200
    for s in "ab":
        mine = [r for r in got if r.source == s]
        left = mine[0].target - sum(r.taken for r in mine)
        assert -1e-6 <= left < min([r.size for r in mine if r.copies < 2], default=1e9)
        assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r.size for r in mine)
    again = M.mix(docs(spark, rows[::-1], False).repartition(3)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_nothing_that_is_left_would_fit(spark):
    """Sizes over four orders of magnitude."""
    rnd = random.Random(3)
    rows = [(i, "w " * min(20_000, int(rnd.lognormvariate(3, 2)) + 1), "en", f"s{i % 3}", 0) for i in range(240)]
    got = M.mix(docs(spark, rows, False)).collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        left = mine[0].target - sum(r.taken for r in mine)
        assert -1e-6 <= left and all(r.size > left for r in mine if r.copies < 2)


def test_awkward_rows(spark):
    got = M.mix(docs(spark)).collect()
    assert len(got) == 13 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert next(r for r in got if r.doc_id == 2).copies == 1          # a source without words
    assert M.mix(empty(spark)).collect() == []
