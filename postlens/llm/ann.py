"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample.  Every vector is
filed under its nearest centroid and, near a boundary, under further ones
within a distance ratio.  Centroids are searched through an in-memory
neighbour graph (they are bounded, MOST_LISTS, so every task holds them).  A
query searches the graph and keeps the lists within a distance ratio of the
nearest; the ratio is calibrated on the sample against exact search.  Each
list is scored in cells of bounded size, whatever its length, and every score
is the exact inner product of the original vectors, summed in one fixed order
so that equal vectors tie.

Largest inner product becomes smallest distance by one more component,
``sqrt(M**2 - |x|**2)`` for vectors and 0 for queries, M the largest norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, lowest_by_hash, stage
from postlens.llm.topk import _by_dimension, _keep_best, usable

by_value(__name__)

SAMPLE = 20_000              # vectors that centroids and ratio are fitted on (all, if fewer)
MOST_LISTS = 2048
FILE_RATIO = 1.03            # a vector is also filed under centroids this near, up to MOST_COPIES
MOST_COPIES = 4
GOAL = 0.97                  # recall on the sample that the search ratio is calibrated to
DEGREE = 24
CELL = 8192                  # vectors, and queries, of a list that meet in one cell
HELD_ROWS = 2_000_000        # partial results a task keeps before it hands them on


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float
    homes: np.ndarray | None = None      # vectors whose nearest list is this one


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm ** 2 - (x * x).sum(1), 0))[:, None]], axis=1)


def balanced_kmeans(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Centroids; a list's size raises its distance, so that none grows far beyond the others."""
    pick = np.random.default_rng(7)
    c = x[pick.choice(len(x), n, replace=False)].copy()
    size = np.zeros(n)
    for _ in range(rounds):
        d = _squared(x, c)
        spread = d.min(axis=1).mean()
        near = (d + spread * 0.3 * (size / (len(x) / n) - 1).clip(-1, 3)[None, :]).argmin(axis=1)
        size = np.bincount(near, minlength=n).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        if (~full).any():                               # an empty list restarts at a far vector
            c[~full] = x[np.argsort(-d.min(axis=1))[:int((~full).sum())]]
    return c


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest others, and as many far ones that keep the graph connected."""
    n = len(c)
    near = min(degree, n - 1)
    d = _squared(c, c)
    np.fill_diagonal(d, np.inf)
    links = np.argsort(d, axis=1)[:, :near] if near else np.zeros((n, 0), int)
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) * 7 + 3) % n, (np.arange(n) * 13 + n // 2) % n], axis=1)
    return np.concatenate([links, ring], axis=1)


def graph_search(x: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int, at_once: int = 256):
    """(centroid numbers, squared distances) of each row's ``beam`` nearest found, nearest first; ``at_once`` rows a time."""
    beam = min(beam, len(c))
    parts = [_walk(x[at:at + at_once], c, graph, beam) for at in range(0, len(x), at_once)]
    if not parts:
        return np.zeros((0, beam), int), np.zeros((0, beam))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _walk(x: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int):
    """Best-first search from a few entry points, all rows at once: each round opens every row's
    nearest unopened centroids until the beam is all open."""
    n, rows = len(c), np.arange(len(x))[:, None]
    if n <= beam:                                       # all are wanted
        d = _squared(x, c)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(d, order, axis=1)
    xx, cc = (x * x).sum(1), (c * c).sum(1)
    ids = np.tile(np.linspace(0, n - 1, beam).astype(int), (len(x), 1))
    dist = np.maximum(xx[:, None] - 2 * np.einsum("id,ijd->ij", x, c[ids]) + cc[ids], 0)
    seen = np.zeros((len(x), n), bool)
    seen[rows, ids] = True
    opened = np.zeros((len(x), n), bool)
    for _ in range(4 * beam):
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        shut = ~opened[rows, ids]
        if not shut.any():
            break
        pick = np.argsort(~shut, axis=1, kind="stable")[:, :4]           # the nearest four unopened
        at = np.take_along_axis(ids, pick, 1)
        opened[rows, at] = True
        new = graph[at].reshape(len(x), -1)
        d = np.maximum(xx[:, None] - 2 * np.einsum("id,ijd->ij", x, c[new]) + cc[new], 0)
        first = np.zeros_like(new, bool)                # a centroid may come from several neighbours
        key = np.argsort(new, axis=1, kind="stable")
        s = np.take_along_axis(new, key, 1)
        np.put_along_axis(first, key, np.concatenate([np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]], axis=1), 1)
        d[seen[rows, new] | ~first] = np.inf
        seen[rows, new] = True
        ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def lists_for(rows: int) -> int:
    return int(max(1, min(MOST_LISTS, round(rows ** 0.5 / 4))))


def fit(sample: np.ndarray, rows: int, norm: float, k: int, goal: float = GOAL) -> Index:
    """Centroids for ``rows`` vectors, their graph, and the search ratio that reaches the recall ``goal`` on the sample."""
    x = lift(sample, norm)
    n = min(lists_for(rows), max(1, len(x) // 4))
    c = balanced_kmeans(x, n) if n > 1 else x.mean(axis=0, keepdims=True)
    graph = neighbour_graph(c)
    ask = np.random.default_rng(11).choice(len(x), min(400, len(x)), replace=False)
    score = sample[ask] @ sample.T
    score[np.arange(len(ask)), ask] = -np.inf
    # The sample's neighbours are sparser than all rows': fewer of them stand for k.
    want = max(1, min(len(x) - 1, round(k * max(len(x) / max(rows, 1), 0.25))))
    best = np.argsort(-score, axis=1)[:, :want]
    filed = _filed(x, c, graph)
    q = np.concatenate([sample[ask], np.zeros((len(ask), 1))], axis=1)
    lists, dist = graph_search(q, c, graph, n)
    ratio = np.sqrt(dist / np.maximum(dist[:, :1], 1e-12))
    place = np.full((len(ask), n), np.inf)
    np.put_along_axis(place, lists, ratio, axis=1)      # a query's ratio at each list
    need = np.stack([place[np.arange(len(ask))[:, None], np.where(filed[best][:, :, j] >= 0, filed[best][:, :, j], 0)]
                     + np.where(filed[best][:, :, j] >= 0, 0, np.inf) for j in range(filed.shape[1])]).min(axis=0)
    return Index(c, graph, norm, float(np.quantile(need, goal)) + 1e-9)


def _filed(x: np.ndarray, c: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """[row, copy]: the lists a vector is filed under (-1: none)."""
    lists, dist = graph_search(x, c, graph, min(max(4 * MOST_COPIES, 32), len(c)))
    lists, dist = lists[:, :MOST_COPIES], dist[:, :MOST_COPIES]
    return np.where(np.sqrt(dist) <= FILE_RATIO * np.sqrt(dist[:, :1]) + 1e-12, lists, -1)


def _probed(q: np.ndarray, index: Index, k: int):
    """The lists each query looks at: all found within the ratio of its nearest, and as many as hold k + 1 vectors."""
    beam = 32
    while True:
        lists, dist = graph_search(q, index.centroids, index.graph, beam)
        homes = index.homes[lists]
        near = np.sqrt(dist) <= index.ratio * np.sqrt(dist[:, :1]) + 1e-12
        near |= homes.cumsum(axis=1) - homes < k + 1
        if beam >= len(index.centroids) or not near[:, -1].any():
            return [l[ok].tolist() for l, ok in zip(lists, near)]
        beam *= 2                                       # the beam, not the ratio, ended it


def _listed(rows: DataFrame, index: Index, k: int = 0) -> DataFrame:
    """(vec_id, v, lists): those a query for ``k`` looks at, or with k = 0 those a vector is filed under."""
    def run(batches):
        for batch in batches:
            for dim, ids, x in _by_dimension(batch):
                if dim + 1 != index.centroids.shape[1]:
                    continue
                for at in range(0, len(ids), 2048):
                    part = x[at:at + 2048].astype(np.float64)
                    if k:
                        lists = _probed(np.concatenate([part, np.zeros((len(part), 1))], axis=1), index, k)
                    else:
                        lists = [r[r >= 0].tolist() for r in _filed(lift(part, index.norm), index.centroids, index.graph)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:at + 2048], pa.int64()),
                         pa.array(list(part), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int32()))],
                        ["vec_id", "v", "lists"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, lists array<int>")


def _score_cells(k: int):
    """Rows sorted by (list, cell), vectors before queries -> each query's best of what this task saw."""
    def exact(q, x):
        s = np.zeros(len(q))
        for d in range(q.shape[1]):                     # one fixed order of summation
            s += q[:, d] * x[:, d]
        return s

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        key, xs, xi = None, [], []

        def ask(qi, q):
            if not xs or not len(qi):
                return
            x, ids = np.concatenate(xs), np.concatenate(xi)
            parts = []
            for at in range(0, len(qi), 256):
                s = q[at:at + 256] @ x.T
                s[qi[at:at + 256, None] == ids[None, :]] = -np.inf
                few = min(k, len(ids)) - 1
                floor = -np.partition(-s, few, axis=1)[:, few]
                # Rounding may disorder near ties: keep all within it, then score them exactly.
                slack = 1e-9 * (1 + np.abs(q[at:at + 256]).sum(1) * np.abs(x).max())
                i, j = np.nonzero((s >= (floor - slack)[:, None]) & np.isfinite(s))
                parts.append(_keep_best(qi[at + i], ids[j], exact(q[at + i], x[j]), k))
            return tuple(np.concatenate(c) for c in zip(*parts))

        def out():
            for at in range(0, len(held[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[at:at + (1 << 16)]) for h in held], ["query_id", "vec_id", "score"])

        fresh = []
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 40) + batch.column(3).to_numpy(zero_copy_only=False)
            query = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            ids, flat, lens = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False), None
            if not len(ids):
                continue
            v = flat.reshape(len(ids), -1)
            cuts = [0, *(np.nonzero(np.diff(place) | np.diff(query.astype(int)))[0] + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if place[a] != key:
                    key, xs, xi = place[a], [], []
                if query[a]:
                    got = ask(ids[a:b], v[a:b])
                    if got is not None:
                        fresh.append(got)
                else:
                    xs.append(v[a:b])
                    xi.append(ids[a:b])
            if fresh and sum(len(f[0]) for f in fresh) > 200_000:
                held = _keep_best(*(np.concatenate(c) for c in zip(held, *fresh)), k)
                fresh = []
                if len(held[0]) > HELD_ROWS:
                    yield from out()
                    held = tuple(h[:0] for h in held)
        held = _keep_best(*(np.concatenate(c) for c in zip(held, *fresh)), k)
        yield from out()

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding",
            sample: int = SAMPLE, goal: float = GOAL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows with another id and a vector of the same length; each length has an
    index of its own.  Vectors null, empty, zero, or holding null or
    non-finite components, and rows without an id, take no part; repeated rows
    count once.  A query with k candidates or fewer gets all of them.  An
    empty table gives an empty result.  Vectors so large that an inner product
    may overflow a double raise ValueError.

    ``goal`` is the recall that the search is calibrated to on the sample; 1
    searches every list that held a neighbour of any sampled query.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = (usable(vectors.where(F.col(key).isNotNull()), column)
            .select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.exists("v", lambda x: x != 0)).distinct())
    rows = stage(rows, "ann-vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = (rows.groupBy(F.size("v").alias("dim"))
               .agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
               .where("asked > 0").orderBy("dim").collect())
    found = spark.createDataFrame([], FOUND)
    for r in lengths:                                   # one job a length that has queries
        if not np.isfinite(r.norm2):
            raise ValueError(f"inner products of vectors of length {r.dim} may overflow a double")
        found = found.unionByName(_search_length(rows.where(F.size("v") == r.dim), r.n, float(np.sqrt(r.norm2)), k, every, sample, goal))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


FOUND = "query_id long, vec_id long, score double"


def _search_length(rows: DataFrame, count: int, norm: float, k: int, every: int, sample: int, goal: float) -> DataFrame:
    """FOUND rows, some more than k a query, among vectors of one length."""
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = lowest_by_hash(rows, sample, "vec_id").select("v").collect()                           # bounded
    index = fit(np.array([r.v for r in taken]), count, norm, k, goal)
    # Of equal vectors only the k + 1 smallest ids can be among the nearest.
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v")
    filed = _listed(kept.repartition(tasks), index)
    filed = stage(filed.select("vec_id", "v", F.posexplode("lists").alias("nth", "list")), "ann-postings")
    load = {r.list: r for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("nth") == 0, 1))
                                                          .alias("homes")).collect()}              # MOST_LISTS rows
    index.homes = np.array([load[i].homes if i in load else 0 for i in range(len(index.centroids))])
    asked = _listed(rows.where(F.col("vec_id") % every == 0).repartition(tasks), index, k)
    asked = stage(asked.select("vec_id", "v", F.explode("lists").alias("list")), "ann-queries")
    asks = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}                   # MOST_LISTS rows
    # A list is a grid: its vectors are dealt over rows, its queries over columns, and each cell holds a bounded part of both.
    grid = lambda n: F.lit(np.array([-(-max(n(i), 1) // CELL) for i in range(len(index.centroids))], np.int64))
    down, across = grid(lambda i: load[i]["all"] if i in load else 0), grid(lambda i: asks.get(i, 0))

    def dealt_over(df, mine, other, place):
        own = F.pmod(F.xxhash64("vec_id"), F.get(mine, F.col("list")))
        return df.select("vec_id", "v", "list", own.alias("own"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.get(other, F.col("list")) - 1)).alias("other")
                         ).select("vec_id", "v", "list", place.alias("cell"))

    posts = dealt_over(filed, down, across, F.col("own") * (1 << 20) + F.col("other")).withColumn("query", F.lit(False))
    queries = dealt_over(asked, across, down, F.col("other") * (1 << 20) + F.col("own")).withColumn("query", F.lit(True))
    dealt = posts.unionByName(queries).repartition(tasks, "list", "cell").sortWithinPartitions("list", "cell", "query")
    return dealt.mapInArrow(_score_cells(k), FOUND)
