"""Exact top-k by inner product: three-phase uniform threshold.

A vector's score is the sum over ``lists`` blocks of dimensions.  Phase one
gathers, for every query, each list's best entries from each task, with their
whole scores; the k-th best of those is a safe cutoff, as the true k-th best
is no lower.  Phase two sends the cutoff back: a vector that reaches it must
reach ``cutoff / lists`` in at least one list, so the entries at or above that
are sufficient.  Phase three resolves the other lists for just these entries,
exactly.  All arithmetic is on integers.

Of equal vectors only the k + 1 smallest ids can matter, so the others leave
before the search (a vector shared by a third of all rows costs no more than
any other).  Queries go to the tasks in blocks of bounded bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, stage

by_value(__name__)

LISTS = 2
SCALE = 256
QUERY_BLOCK_BYTES = 16 << 20     # of the query matrix that is sent to every task at once
QUERIES_AT_ONCE = 128


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null or empty and holds neither nulls nor non-finite components."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))


def quantised(vectors: DataFrame, key: str, column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale x component), as long; rows without an id take no part, repeated rows count once."""
    ints = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))
    return (usable(vectors.where(F.col(key).isNotNull()), column)
            .select(F.col(key).cast("long").alias("vec_id"), ints.alias("v")).distinct())


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer matrix product; in floating point where that is exact."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if big < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _keep_best(q, ids, score, k):
    """Of (query, id, score) rows: each query's k best, ties to the smaller id; an id counts once."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    if len(q):
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        q, ids, score = q[new], ids[new], score[new]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        top = np.arange(len(q)) - start < k
        q, ids, score = q[top], ids[top], score[top]
    return q, ids, score


def _vectors(batch):
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    col = batch.column(1)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    return ids, flat, lens


def _by_dimension(batch):
    """(ids, matrix) for each vector length in an Arrow batch."""
    ids, flat, lens = _vectors(batch)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else lens
    for dim in np.unique(lens):
        rows = np.nonzero(lens == dim)[0]
        yield int(dim), ids[rows], flat[starts[rows][:, None] + np.arange(dim)]


OUT = "query_id long, vec_id long, score long"


def _rows(q, ids, score):
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
                                      ["query_id", "vec_id", "score"])


def _search(candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, lists: int, cutoff):
    """One pass over the candidates: phase one without ``cutoff``, phases two and three with it."""
    parts = np.array_split(np.arange(queries.shape[1]), min(lists, queries.shape[1]))
    m = len(parts)

    def run(batches):
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for dim, ids, x in _by_dimension(batch):
                if dim != queries.shape[1]:
                    continue
                for at in range(0, len(query_ids), QUERIES_AT_ONCE):
                    qs = queries[at:at + QUERIES_AT_ONCE]
                    own = query_ids[at:at + QUERIES_AT_ONCE, None] == ids[None, :]
                    local = [_dot(qs[:, p], x[:, p]) for p in parts]
                    if cutoff is None:
                        take = np.zeros(own.shape, bool)
                        few = min(k + 1, len(ids))
                        for s in local:                  # each list's best entries
                            best = np.argpartition(-np.where(own, np.iinfo(np.int64).min + 1, s), few - 1, axis=1)[:, :few]
                            np.put_along_axis(take, best, True, axis=1)
                    else:
                        c = cutoff[at:at + QUERIES_AT_ONCE, None]
                        take = np.zeros(own.shape, bool)
                        for s in local:                  # sufficient entries
                            take |= (s * m >= c)
                    i, j = np.nonzero(take & ~own)
                    total = sum(s[i, j] for s in local)  # the remaining lists, exactly
                    if cutoff is not None:
                        ok = total >= cutoff[at + i]
                        i, j, total = i[ok], j[ok], total[ok]
                    held = tuple(np.concatenate(c) for c in zip(held, (query_ids[at + i], ids[j], total)))
            held = _keep_best(*held, k)
        if len(held[0]):
            for at in range(0, len(held[0]), 1 << 16):
                yield _rows(*(h[at:at + (1 << 16)] for h in held))

    return candidates.mapInArrow(run, OUT)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", column: str = "embedding",
          scale: int = SCALE, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all
    rows with another id; only vectors of one length meet.  Vectors null,
    empty or holding null or non-finite components, and rows without an id,
    take no part; repeated rows count once.  An empty table, or one without
    queries, gives an empty result.  Components so large that a score, or a
    list's part of it times ``lists``, may leave 64 bits raise ValueError.
    """
    spark = vectors.sparkSession
    largest = (usable(vectors.where(F.col(key).isNotNull()), column)
               .groupBy(F.size(column).alias("dim")).agg(F.max(F.array_max(F.transform(F.col(column), lambda x: F.abs(x.cast("double"))))).alias("x")))
    for r in largest.collect():                         # one row a length
        big = abs(r.x * scale) + 1
        if big * big * r.dim * 4 * lists >= 2.0 ** 63:
            raise ValueError(f"scores of vectors of length {r.dim} may leave 64 bits: a component is as large as {r.x}")
    whole = stage(quantised(vectors, key, column, scale), "topk-ints")
    same = Window.partitionBy("v").orderBy("vec_id")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = stage(whole.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
                       .select("vec_id", "v").repartition(tasks), "topk-candidates")
    asked = stage(whole.where(F.col("vec_id") % every == 0).withColumn("dim", F.size("v"))
                  .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))), "topk-queries")
    found = spark.createDataFrame([], OUT)
    for dim, n in sorted((r.dim, r.n) for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        blocks = max(1, -(-n * dim * 8 // QUERY_BLOCK_BYTES))
        for b in range(blocks):
            block = asked.where((F.col("dim") == dim) & (F.col("block") % blocks == b)).select("vec_id", "v")
            rows = block.collect()                       # QUERY_BLOCK_BYTES, more or less
            if not rows:
                continue
            ids = np.array([r.vec_id for r in rows], np.int64)
            matrix = np.array([r.v for r in rows], np.int64)
            gathered = _search(candidates, ids, matrix, k, lists, None).distinct()
            nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            floor = {r.query_id: r.score for r in gathered.withColumn("n", F.row_number().over(nth))
                     .where(F.col("n") == k).select("query_id", "score").collect()}
            lowest = np.iinfo(np.int64).min // (2 * lists)
            cutoff = np.array([floor.get(int(i), lowest) for i in ids], np.int64)
            # With fewer than k candidates nothing may be cut: every entry passes the lowest cutoff.
            found = found.unionByName(stage(_search(candidates, ids, matrix, k, lists, cutoff), "topk-found"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
