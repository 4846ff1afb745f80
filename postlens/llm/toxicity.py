"""Toxicity by weak supervision.

1. Lexicons are mined from labelled rows of the fit folds: words and word
   beginnings that are far more common in toxic than in clean documents.
2. Sixteen voters look at every document: lexicons (the mined terms dealt over
   twelve, and one of common insults) and patterns (spelling tricks, several
   hits at once, density of hits).  All documents' vote patterns, at most
   2**16, are counted.
3. A generative label model explains the counts: each voter's accuracy per
   class and the correlations of voters (a maximum spanning forest of
   conditional mutual information), fitted by EM; labelled rows of the fit
   folds are clamped to their class.
4. A linear classifier (logistic regression over term hits and voters) is
   trained on the posterior labels of a bounded sample; it gives the scores.

Labels of the held-out fold are never read; language, source and doc_id are
no inputs of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import by_value, lowest_by_hash, stage, stage_compressed

by_value(__name__)

FOLDS = 5
MOST_LABELLED = 50_000       # labelled rows the lexicons are mined from (all, if fewer)
MOST_TRAINED = 30_000        # documents the classifier is trained on (all, if fewer)
MIN_LOG_ODDS = 4.5
BEGINNINGS = (4, 5, 6, 7, 8)
#: Common English insults.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "dumb",
           "jerk", "creep", "filthy", "imbecile", "ugly", "hate", "shut up", "kill yourself")
TRICKS = re.compile(r"\b(?:[a-z]+[@$!*]+[a-z]+|(?:[a-z][.\-_]){3,}[a-z]?)\b|!{3,}")
WORDS = re.compile(r"[^\W\d_]+")
PART = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Is a row in the held-out fold?  A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _words(text: str | None) -> set[str]:
    """Distinct lower-case words; long texts go by parts cut at a space."""
    text, out, at = (text or "").lower(), set(), 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        if cut < 0:
            break
        out.update(WORDS.findall(text, at, cut))
        at = cut
    out.update(WORDS.findall(text, at))
    return out


def _terms(words: set[str]) -> set[str]:
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return out


# Mining
def _count_terms(rows: DataFrame) -> DataFrame:
    """(term, toxic, n): documents that hold a term, by label; partial counts are flushed as they grow."""
    def run(batches):
        from collections import Counter

        found: Counter = Counter()

        def flush():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                               pa.array([found[k] for k in keys], pa.int64())], ["term", "toxic", "n"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.update((t, toxic) for t in _terms(_words(text)))
                if len(found) > 400_000:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    return (rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term string, toxic int, n long")
            .groupBy("term", "toxic").agg(F.sum("n").alias("n")))


def mine_terms(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_terms: int | None = None) -> list[str]:
    """Terms far likelier in toxic than in clean labelled rows of the fit folds, the commonest first.

    Every term that passes the test is kept; nothing else bounds a term's
    support.  Terms are counted and tested in Spark, and only those that pass
    reach the driver: at most the distinct terms of the sample's toxic rows.
    """
    sample = stage(lowest_by_hash(labels.where(~held_out(F.col("doc_id"))), most_labelled, "doc_id"), "tox-labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")        # most_labelled rows at most
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    of = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    met = stage(_count_terms(rows).groupBy("term").agg(of(1).alias("a"), of(0).alias("b")).where("a >= 2"), "tox-terms")
    share, bar = n1 / (n1 + n0), 0.6 * np.log(met.count() + 1)         # few terms by chance, whatever the sample's size
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + .5) / (n1 + 1)) - F.log((b + .5) / (n0 + 1))
    rate = a / (a + b)
    excess = a * F.log(rate / share) + F.when(b > 0, b * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    least = F.when(b == 0, MIN_LOG_ODDS - float(np.log(2))).otherwise(MIN_LOG_ODDS)
    good = met.where((odds >= least) & (rate > share) & (excess >= float(bar))).orderBy(F.desc("a"), "term")
    return [r.term for r in (good if most_terms is None else good.limit(most_terms)).select("term").collect()]


# Voters
MINED = 12                   # lexicons


def _lexicons(n: int) -> list[int]:
    """The lexicon of each of ``n`` terms in order of commonness: sizes grow, so common terms vote apart from rare ones."""
    size = [(j + 1) ** 2 for j in range(MINED)]
    ends = np.cumsum(size) / sum(size) * max(n, MINED)
    return [int(np.searchsorted(ends, i + 1, "left").clip(0, MINED - 1)) for i in range(n)]


VOTERS = MINED + 4
INSULT_WORDS = frozenset(w for w in INSULTS if " " not in w)
INSULT_PHRASES = tuple(w for w in INSULTS if " " in w)


class Reader:
    """Term hits and votes of a text."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.words = {t for t in terms if not t.endswith("*")}
        self.starts = {n: {t for t in terms if t.endswith("*") and len(t) == n + 1} for n in BEGINNINGS}
        self.lexicon = _lexicons(len(terms))

    def read(self, text: str | None) -> tuple[list[int], int]:
        words = _words(text)
        hit = words & self.words
        for n, mine in self.starts.items():
            if mine:
                hit |= {w[:n] + "*" for w in words if len(w) >= n} & mine
        hits = sorted(self.at[t] for t in hit)
        mask = 0
        for h in hits:
            mask |= 1 << self.lexicon[h]
        low = (text or "").lower()
        insult = not words.isdisjoint(INSULT_WORDS) or any(p in low for p in INSULT_PHRASES)
        mask |= (insult << MINED) | (bool(TRICKS.search(low)) << (MINED + 1))
        mask |= ((len(hits) >= 3) << (MINED + 2)) | ((len(hits) * 200 >= len(words) > 0) << (MINED + 3))
        return hits, mask


def votes(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, mask, hits, c0, c1, ...): every document's voters that fire, as bits, the terms it holds, and all its columns by place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = 1 + docs.columns.index("text")

    def run(batches):
        reader = Reader(terms)
        for b in batches:
            got = [reader.read(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[1] for g in got], pa.int32()),
                 pa.array([g[0] for g in got], pa.list_(pa.int32())), *b.columns[1:]],
                ["doc_id", "mask", "hits", *b.schema.names[1:]])

    out = T.StructType([rows.schema["doc_id"], T.StructField("mask", T.IntegerType()),
                        T.StructField("hits", T.ArrayType(T.IntegerType())), *rows.schema.fields[1:]])
    return rows.mapInArrow(run, out)


# Label model
def vote_table(masks: np.ndarray) -> np.ndarray:
    """[row, voter]: does the voter fire?"""
    return (masks[:, None] >> np.arange(VOTERS)) & 1


@dataclass
class LabelModel:
    """P(toxic) and, per class, each voter's rate of firing given its parent's vote (-1: no parent)."""
    prior: float
    parent: list[int]
    rate: np.ndarray             # [class, parent's vote, voter]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        score = np.zeros((2, len(v)))
        for y in (0, 1):
            for j, p in enumerate(self.parent):
                r = self.rate[y, v[:, p] if p >= 0 else np.zeros(len(v), int), j]
                score[y] += np.log(np.where(v[:, j] == 1, r, 1 - r))
        d = score[1] - score[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def fit_label_model(masks: np.ndarray, counts: np.ndarray, state: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over counted vote patterns; ``state`` is 1 or 0 for labelled patterns, -1 for the others."""
    v = vote_table(masks)
    seen = state >= 0
    share = counts[state == 1].sum() / max(counts[seen].sum(), 1)
    prior = float(np.clip(share, 0.001, 0.5))
    post = np.where(state >= 0, state, np.where((v[:, :MINED].sum(axis=1) >= 2), 0.9, 0.02)).astype(float)

    def rates(post, parent):
        rate = np.full((2, 2, VOTERS), 0.5)
        for y, w in ((1, counts * post), (0, counts * (1 - post))):
            for j, p in enumerate(parent):
                for u in (0, 1):
                    own = w if p < 0 else w * (v[:, p] == u)
                    rate[y, u, j] = (own @ v[:, j] + 0.1) / (own.sum() + 1.0)
        return rate

    def em(parent, post, prior):
        for _ in range(rounds):
            model = LabelModel(prior, parent, rates(post, parent))
            new = np.where(seen, state, model.posterior(v))
            moved = np.abs(new - post).max(initial=0)
            post = new
            free = counts[~seen].sum()
            if free:
                prior = float(np.clip((counts * post)[~seen].sum() / free, 1e-4, 0.5))
            if moved < 1e-6:
                break
        return post, prior

    post, prior = em([-1] * VOTERS, post, prior)
    parent = _correlated(v, counts, post)
    post, prior = em(parent, post, prior)
    return LabelModel(prior, parent, rates(post, parent))


def _correlated(v: np.ndarray, counts: np.ndarray, post: np.ndarray, least: float = 1e-4) -> list[int]:
    """Each voter's parent in the maximum spanning forest of the voters' mutual information within classes."""
    mi = np.zeros((VOTERS, VOTERS))
    total = max(counts.sum(), 1)
    for w in (counts * post, counts * (1 - post)):
        n = w.sum()
        if n <= 0:
            continue
        for i in range(VOTERS):
            for j in range(i):
                for a in (0, 1):
                    for b in (0, 1):
                        pa_, pb = (w @ (v[:, i] == a)) / n, (w @ (v[:, j] == b)) / n
                        pab = (w @ ((v[:, i] == a) & (v[:, j] == b))) / n
                        if pab > 0:
                            mi[i, j] += n / total * pab * np.log(pab / (pa_ * pb))
    group, near = list(range(VOTERS)), [[] for _ in range(VOTERS)]
    for i, j in sorted(((i, j) for i in range(VOTERS) for j in range(i)), key=lambda e: (-mi[e], e)):
        if mi[i, j] >= least and group[i] != group[j]:
            near[i].append(j)
            near[j].append(i)
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    parent, done = [-1] * VOTERS, set()
    for root in range(VOTERS):
        todo = [root] if root not in done else []
        while todo:
            x = todo.pop()
            done.add(x)
            for y in near[x]:
                if y not in done:
                    parent[y] = x
                    todo.append(y)
    return parent


# Classifier
@dataclass
class Model:
    terms: list[str]
    label_model: LabelModel
    weights: list[float]         # one a term, then one a voter, then the bias

    def features(self, hits: list[int], mask: int) -> list[int]:
        return [*hits, *(len(self.terms) + j for j in range(VOTERS) if mask >> j & 1)]


def train_linear(rows: list[list[int]], y: np.ndarray, width: int, l2: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels ``y``; rows list the features that are on; the last weight is the bias."""
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    idx = np.fromiter((i for r in rows for i in r), np.int64, int(lens.sum()))
    owner = np.repeat(np.arange(len(rows)), lens)
    # Each class weighs half, as toxic documents are few.
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = y / share + (1 - y) / (1 - share)
    w, moved, seen = np.zeros(width + 1), np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[idx], len(rows)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        grad = np.append(np.bincount(idx, g[owner], width) if len(idx) else np.zeros(width), g.sum())
        grad[:-1] += l2 * w[:-1]
        moved = 0.9 * moved + 0.1 * grad
        seen = 0.99 * seen + 0.01 * grad * grad
        w = w - 0.1 * moved / np.sqrt(seen + 1e-12)
    return w


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_trained: int = MOST_TRAINED, carry: bool = False):
    """(model, votes of all documents; with ``carry``, beside their columns, so that texts are read once).  Labels (doc_id, toxic): the larger counts if a document has two; null ones do not."""
    labels = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    terms = mine_terms(docs, labels, most_labelled)
    cast = votes(docs, terms)
    cast = stage_compressed(cast, "tox-voted") if carry else stage(cast.select("doc_id", "mask", "hits"), "tox-votes")
    known = cast.join(labels.where(~held_out(F.col("doc_id"))), "doc_id", "left")
    state = F.coalesce(F.col("toxic"), F.lit(-1))
    counted = known.groupBy("mask", state.alias("state")).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 x 2**16 at most
    masks, counts, states = (np.array([r[i] for r in counted], np.int64) for i in (0, 2, 1))
    label_model = fit_label_model(masks, counts.astype(float), states)
    fitted = cast.where(~held_out(F.col("doc_id"))).select("doc_id", "mask", "hits")
    rows = lowest_by_hash(fitted, most_trained, "doc_id", "mask", "hits").select("mask", "hits").collect()
    model = Model(terms, label_model, [])
    if rows:
        y = label_model.posterior(vote_table(np.array([r.mask for r in rows])))
        model.weights = train_linear([model.features(r.hits, r.mask) for r in rows], y, len(terms) + VOTERS).tolist()
    else:
        model.weights = [0.0] * (len(terms) + VOTERS) + [-1.0]
    return model, cast


def _score(model: Model) -> Column:
    """A voted document's score, in Spark expressions."""
    w = F.lit(np.array(model.weights))
    n = len(model.terms)
    z = F.aggregate("hits", F.lit(float(model.weights[-1])), lambda s, h: s + F.get(w, h))
    for j in range(VOTERS):
        z = z + F.when(F.col("mask").bitwiseAND(1 << j) != 0, F.lit(float(model.weights[n + j]))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_votes(cast: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of already voted documents."""
    return (cast.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words; without
    usable labels every score is that of the bias.  Repeated rows each get a
    row, equal texts equal scores.  An empty table gives an empty result;
    other columns are not read.
    """
    model, cast = fit(docs.select("doc_id", "text"), labels)
    return score_votes(cast, model)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score below one half: those that ``score_documents`` does not predict toxic."""
    model, cast = fit(docs, labels, carry=True)
    return cast.where(_score(model) < 0.5).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
