import random
import zlib

import numpy as np
import pytest

from postlens.llm import toxicity as T
from tests.llm.helpers import DOCS, ROWS, docs, empty

BAD = ("grumvex", "slodgar", "knarbit", "pelvort", "zugmash")


def corpus(n=1500, seed=2):
    """Clean words by chance; toxic documents also hold words that begin with a few stems."""
    pick = random.Random(seed)
    vocab = ["".join(pick.choice("abcdeghilmnoprst") for _ in range(pick.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = pick.choices(vocab, k=pick.randint(5, 120))
        if toxic:
            for _ in range(pick.randint(3, 6)):
                words.insert(pick.randrange(len(words)), pick.choice(BAD) + pick.choice(["", "en", "ado", "isch", "é"]))
        rows.append((i, " ".join(words).capitalize(), "xx", f"s{i % 5}", 0))
        if i % 3:
            labels.append((i, int(pick.random() < .5), int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in T.score_documents(docs(spark, rows), table(spark, labels)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[i].predicted, t) for i, _, t in labels if fold(i)]
    assert np.mean([p == t for p, t in held]) >= 0.97
    assert sum(p for p, t in held if t) / sum(t for _, t in held) >= 0.9


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(600)
    one = sorted(map(tuple, T.score_documents(docs(spark, rows), table(spark, labels)).collect()))
    turned = [(i, q, 1 - t if fold(i) else t) for i, q, t in labels]
    assert one == sorted(map(tuple, T.score_documents(docs(spark, rows), table(spark, turned)).collect()))


def test_only_the_text_counts(spark):
    rows, labels = corpus(600)
    model, cast = T.fit(docs(spark, rows), table(spark, labels))
    again = T.votes(docs(spark, [(i + 5000, t, "yy", "other", 7) for i, t, *_ in rows]), model.terms)
    score = {r.doc_id: r.score for r in T.score_votes(cast, model).collect()}
    assert all(r.score == score[r.doc_id - 5000] for r in T.score_votes(again, model).collect())


def test_label_model_recovers_accuracies():
    """Votes drawn from known rates, with one voter copying another: posteriors separate the classes."""
    pick = np.random.default_rng(9)
    y = (pick.random(40_000) < 0.1).astype(int)
    v = (pick.random((len(y), T.VOTERS)) < np.where(y[:, None] == 1, 0.45, 0.004)).astype(int)
    v[:, 1] = v[:, 0]
    masks, back, counts = np.unique((v << np.arange(T.VOTERS)).sum(axis=1), return_inverse=True, return_counts=True)
    model = T.fit_label_model(masks, counts.astype(float), np.full(len(masks), -1))
    post = model.posterior(T.vote_table(masks))[back]
    assert abs(model.prior - 0.1) < 0.03 and ((post > 0.5) == y).mean() > 0.99
    assert model.parent[0] == 1 or model.parent[1] == 0                       # the copy is found
    assert abs(model.rate[1, 0, 5] - 0.45) < 0.25


def test_parts_of_long_texts():
    text = "Alpha grumvexen " * 9
    assert T._words(text) == {"alpha", "grumvexen"}
    old, T.PART = T.PART, 20
    try:
        assert T._words(text) == {"alpha", "grumvexen"}
    finally:
        T.PART = old


def test_drop_toxic_agrees_with_the_scores(spark):
    rows, labels = corpus(800)
    df, lab = docs(spark, rows), table(spark, labels)
    kept = T.drop_toxic(df, lab)
    assert kept.columns == df.columns
    ok = {r.doc_id for r in T.score_documents(df, lab).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == ok


@pytest.mark.parametrize("labels", [[], [(1, 0, None), (None, 1, 1)], [(1, 0, 1), (1, 0, 0), (8, 1, 0), (999, 1, 1)]])
def test_awkward_rows(spark, labels):
    df = docs(spark)
    got = T.score_documents(df, table(spark, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1
    assert T.drop_toxic(df, table(spark, labels)).columns == df.columns


def test_empty(spark):
    assert T.score_documents(empty(spark), table(spark, [(1, 0, 1)])).collect() == []
    assert T.drop_toxic(spark.createDataFrame([], DOCS), table(spark, [])).collect() == []


def test_every_term_that_passes_is_mined(spark):
    """A vocabulary richer than any fixed number of terms: each word in two of a hundred toxic rows, none in clean ones."""
    import zlib

    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5][:4100]
    letters = "abcdefghij"
    words = ["".join(letters[int(c)] for c in f"{k:03d}") + "zzz" for k in range(600)]
    toxic = [[] for _ in range(100)]
    for k, w in enumerate(words):
        toxic[k % 100].append(w)
        toxic[(k + 1) % 100].append(w)
    rows = [(i, " ".join(toxic[n]) if n < 100 else "plain words", "en", "a", 0) for n, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, 0, int(n < 100)) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    assert set(words) <= set(T.mine_terms(docs(spark, rows, False), labels))
