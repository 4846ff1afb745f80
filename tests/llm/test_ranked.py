"""Ranked lexical search against SQL and a plain restatement; masks, ties, blocks, awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import ranked
from tests.llm.helpers import ROWS, assert_oracle, docs

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, k=20):
    """Every document scored for every item."""
    held = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(spark, rows, items, **kw):
    d = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, score string")
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, rank string")
    return sorted([tuple(r) for r in ranked.search(d, i, **kw).collect()], key=str)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB1 .-_é\x00\x7f\x0b", max_size=60)))
def test_terms(text):
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    assert [t.decode() for part in ranked.terms_of(text.encode()) for t in part] == terms(text)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked, "TEXT_BYTES", 7)
    text = "abc defghijklmnop q.r " * 50
    assert [t.decode() for part in ranked.terms_of(text.encode()) for t in part] == terms(text)


@pytest.mark.parametrize("seed,n_words,k", [(1, 8, 3), (2, 30, 20), (3, 200, 5)])
def test_blocks_find_what_scoring_everything_finds(seed, n_words, k):
    """Groups cut off by their greatest score; more than 62 terms; ties."""
    rnd = random.Random(seed)
    asked = {b"w%d" % i: i for i in range(n_words)}
    rows = [(rnd.choice([None, rnd.randrange(500)]) if rnd.random() < 0.1 else i, Counter(
        rnd.randrange(n_words) for _ in range(rnd.randrange(1, 2 * n_words)))) for i in range(400)]
    weights = np.array([rnd.randrange(0, 4000) for _ in asked], np.int64)
    n_terms = sum(sum(c.values()) for _, c in rows)
    table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "n": [sum(c.values()) for _, c in rows],
                      "terms": pa.array([list(c) for _, c in rows], pa.list_(pa.int32())),
                      "tfs": pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int64()))})
    block = ranked.Block(table, weights, len(rows), n_terms)
    item = np.array(sorted(rnd.sample(range(n_words), max(5, n_words // 2))) + [n_words + 5])
    times = np.array([rnd.randrange(1, 4) for _ in item])
    d, s = block.best(item, times, k)
    every = []
    for doc, c in rows:
        m = 75 + 25 * sum(c.values()) * len(rows) // n_terms
        every.append((-sum(int(t) * int(weights[i]) * (10**9 * c[i] // (1000 * c[i] + 12 * m))
                           for i, t in zip(item, times) if c.get(i)), doc is not None, doc or 0))
    want = [(-a, c if b else None) for a, b, c in sorted(every)[:k] if a < 0]
    assert list(zip(s.tolist(), block.ids.take(pa.array(d)).to_pylist())) == want


def test_few_groups_are_scored(monkeypatch):
    """With one clear winner a mask, the groups below it stay unscored."""
    rows = pa.table({"doc_id": pa.array(range(10_000), pa.int64()), "n": [10] * 10_000,
                     "terms": pa.array([[0, 1] if i < 20 else [0] for i in range(10_000)], pa.list_(pa.int32())),
                     "tfs": pa.array([[1, 1] if i < 20 else [1] for i in range(10_000)], pa.list_(pa.int64()))})
    block = ranked.Block(rows, np.array([10, 5000]), 10_000, 100_000)
    looked = []
    plain = np.searchsorted
    monkeypatch.setattr(ranked.np, "searchsorted", lambda a, v, **kw: (looked.append(np.size(v)), plain(a, v, **kw))[1])
    d, _ = block.best(np.array([0, 1]), np.array([1, 1]), 20)
    assert d.tolist() == list(range(20)) and sum(looked) < 100


def test_small_tables(spark):
    rnd = random.Random(4)
    words = ["the", "of", "Zeta", "étude", "x1", "9", "rare", "b"]
    rows = [(i if i % 7 else None, " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for i in range(60)]
    rows += [(5, "rare rare"), (5, "rare rare"), (1000, None), (1001, ""), (1002, " .\n")]
    items = [(1, "The RARE, the"), (2, None), (3, "..."), (4, "unknown"), (None, "zeta Étude"), (5, "x1-9 b"), (5, "x1-9 b"), (6, "of")]
    want = brute(rows, sorted(set(items), key=str))
    assert found(spark, rows, items) == want
    assert found(spark, rows, items, block_postings=5) == want
    assert found(spark, rows, items, item_bytes=10) == want
    assert found(spark, rows, items, k=2) == brute(rows, sorted(set(items), key=str), 2)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "alpha one tail"), (2, "w1x1 w2x2")], "item_id long, text string")
    got = sorted([tuple(r) for r in ranked.search(docs(spark), items).collect()], key=str)
    assert got == brute([(r[0], r[1]) for r in ROWS], [(1, "alpha one tail"), (2, "w1x1 w2x2")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_query(spark, sf_small):
    assert_oracle(spark, sf_small, "op12_ranked_search")
