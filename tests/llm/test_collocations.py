"""Phrase collocations against SQL and a plain restatement; the sort, hot leads, long texts, awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from postlens.llm import collocations as C
from tests.llm.helpers import ROWS, assert_oracle, docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)) if (w := re.findall("[^\x20\x09]+", p))]


def counts(rows, depth):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", " ".join(w[i:i + k])] += 1
    return f, n


def brute(rows, depth=3, least=10, top=2000, percent=50):
    f, n = counts(rows, depth)
    candidates = {p: a for p, a in f.items() if a >= least and " " in p[1]}
    out, outer = [], Counter()
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inner = lang, " ".join(w[i:j])
                    outer[inner] = max(outer[inner], a)
    for (lang, phrase), a in candidates.items():
        if (lang, phrase) in outer and 100 * outer[lang, phrase] >= percent * a:
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, phrase.encode(), left, right, n[lang]))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return result


def found(spark, rows, **kw):
    got = C.mine(spark.createDataFrame([(lang, t, "x") for lang, t in rows], "lang string, text string, phrase string"), **kw)
    return sorted(tuple(r)[:8] for r in got.collect())


@pytest.mark.parametrize("seed,depth,least,vocabulary", [(1, 3, 5, 4), (2, 2, 1, 50), (3, 4, 3, 3), (4, 1, 2, 9)])
def test_quicksort_counts(seed, depth, least, vocabulary):
    rnd = np.random.default_rng(seed)
    n = 600
    keys = rnd.integers(0, vocabulary, (depth, n)).astype(np.int32)
    for d in range(1, depth):
        keys[d, keys[d - 1] == 0] = 0
    weights, part = rnd.integers(1, 4, n), np.sort(rnd.integers(0, 5, n))
    row, deep, count = C.multikey_quicksort(keys, weights, part, least)
    want = Counter()
    for i in range(n):
        for d in range(1, depth + 1):
            if keys[d - 1, i]:
                want[(part[i], *keys[:d, i].tolist())] += int(weights[i])
    got = [((part[r], *keys[:d, r].tolist()), c) for r, d, c in zip(row, deep.tolist(), count.tolist())]
    assert len(got) == len(dict(got))
    assert dict(got) == {k: v for k, v in want.items() if v >= least}


def test_quicksort_of_equal_keys_and_of_none():
    one = C.multikey_quicksort(np.full((3, 1000), 5, np.int32), np.ones(1000, np.int64), np.zeros(1000, np.int64), 10)
    assert sorted(zip(one[1].tolist(), one[2].tolist())) == [(1, 1000), (2, 1000), (3, 1000)]
    none = C.multikey_quicksort(np.zeros((3, 0), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 10)
    assert len(none[0]) == 0


def test_words_of_long_texts(monkeypatch):
    text = "Ab  cd.\tefghijklmnopqrstuvw x,y\x0bz \x0c\r q\x00r é è;" * 40
    want = [w for w in C.words_of(text.encode())]
    whole = [x for part in want for x in part]
    monkeypatch.setattr(C, "TEXT_BYTES", 5)
    assert [x for part in C.words_of(text.encode()) for x in part] == whole
    split, own = [], []
    for w in whole:
        if w == b"\n":
            split, own = split + [own] if own else split, []
        else:
            own.append(w.decode())
    assert split == pieces(text)


def table(seed=5):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "é", "a\x00b", "x"]
    rows = []
    for _ in range(250):
        lang = rnd.choice(["en", "en", "en", None, "und", "fr"])
        text = rnd.choice([" ", "\t", "  "]).join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".\n", "!?"]) for _ in range(rnd.randrange(30)))
        rows.append((lang, text + rnd.choice(["", " new york city", " The of"])))
    return rows + [("en", None), ("en", ""), (None, ".."), ("de", "new york " * 500), ("de", "lone")]


@pytest.mark.parametrize("kw", [{}, {"chunk_words": 50, "sort_suffixes": 10}, {"top": 3}, {"max_words": 4, "min_count": 3},
                                {"max_words": 2, "min_count": 1, "contained_percent": 0}])
def test_small_table(spark, kw):
    rows = table()
    names = {"max_words": "depth", "min_count": "least", "top": "top", "contained_percent": "percent"}
    assert found(spark, rows, **kw) == brute(rows, **{names[k]: v for k, v in kw.items() if k in names})


def test_hot_leads_are_split(spark):
    """A word, a pair and a triple that hold most suffixes: counts stay exact, and no lead that is sorted is above a share."""
    rnd = random.Random(9)
    rows = [("en", " ".join(rnd.choice(["hot", "hot hot", f"hot pair w{rnd.randrange(40)}", f"w{rnd.randrange(40)}"])
                            for _ in range(40))) for _ in range(100)]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "lang string, text string")
    staged = C.stage(C.suffixes(df, C.F.col("lang"), "text", 3, 1000), "test")
    cold, split = C._by_leading_words(staged, 3, 8)
    total = staged.agg(C.F.sum("n")).first()[0]
    most = cold.groupBy("lang", "lead").agg(C.F.sum("n").alias("n")).agg(C.F.max("n")).first()[0]
    assert len(split) >= 2 and most <= total / 8
    got = {r.lead for s in split for r in s.collect()}
    assert {"hot", "hot hot"} <= got


def test_exact_beyond_64_bits(spark, monkeypatch):
    """a * a * 1000000 and l * r pass 64 bits."""
    a, left, right = 4_000_000_007, 5_000_000_029, 6_000_000_001
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, words int, f long")
    sums = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *_: (counts, sums))
    r = C.mine(spark.createDataFrame([], "lang string, text string")).first()
    assert r.score == 1000000 * a * a // (left * right) and (r.a, r.l, r.r, r.n) == (a, left, right, 10**13)


def test_awkward_rows(spark):
    got = sorted(tuple(r)[:8] for r in C.mine(docs(spark), min_count=2).collect())
    assert got == brute([(r[2], r[1]) for r in ROWS], least=2)
    assert C.mine(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        C.mine(docs(spark), max_words=1)


def test_query(spark, sf_small):
    assert_oracle(spark, sf_small, "op11_collocations")
