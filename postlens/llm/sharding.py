"""Histogram sort: exact byte-balanced range sharding with one exchange.

Keys are 128 bits: the hash of the text, then the hash of the doc_id, so equal
texts are neighbours in the sorted order and a text that holds a third of all
rows can still be divided between its documents.  Each round counts, over all
partitions, the exact bytes below finer candidate boundaries inside the bins
that still hold a wanted splitter; a bin is refined until it is within
tolerance or a single row.  Only counts reach the driver: at most 2**16 rows in
round one and 256 for each bin still open later.  Then every row moves once, straight
to its key range, where it is sorted and numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import replace_columns, stage

FIRST_BITS, NEXT_BITS, KEY_BITS = 16, 8, 128
LEAST_RANGES, MOST_RANGES = 32, 4096   # of a shard; of all shards (what the driver holds)
LOWEST = -(1 << 63)


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _prefix(bits: int):
    """Columns that hold the key's first ``bits`` bits in key order (signed)."""
    if bits <= 64:
        return F.shiftright("k1", 64 - bits), F.lit(0).cast("long")
    return F.col("k1"), F.shiftright("k2", KEY_BITS - bits)


def _boundary(bits: int, p1: int, p2: int) -> tuple[int, int]:
    """Smallest key with this prefix."""
    if bits <= 64:
        return p1 << (64 - bits), LOWEST
    return p1, p2 << (KEY_BITS - bits)


def find_splitters(keys: DataFrame, shards: int, range_bytes: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """(ascending key boundaries of even ranges, ranges a shard).

    ``keys`` has k1, k2, bytes.  A shard has as many ranges as it holds
    ``range_bytes``, LEAST_RANGES at least and MOST_RANGES over all shards at
    most.  A boundary's byte count is exact.  One between shards is within
    ``tolerance`` of a range's bytes of its target, one inside a shard within a
    quarter of a range, or it cuts beside the one row (or the rows of one whole
    key) that the target falls in.
    """
    # Open bins: (prefix, bits) -> (bytes below it, targets inside).
    def histogram(bits, inside):
        p1, p2 = _prefix(bits)
        rows = keys
        if inside is not None:
            q1, q2 = _prefix(inside[0])
            rows = keys.where(F.concat_ws(":", q1, q2).isin([f"{a}:{b}" for a, b in inside[1]]))
        return rows.groupBy(p1.alias("p1"), p2.alias("p2")).agg(
            F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()

    bits = FIRST_BITS
    bins = sorted((r.p1, r.p2, r.b, r.n) for r in histogram(bits, None))
    total = sum(b for _, _, b, _ in bins)
    per = max(LEAST_RANGES, min(MOST_RANGES // shards, -(-total // (shards * range_bytes))))
    ranges = shards * per
    if not total:
        return [], per
    goals = [(total * i / ranges, total / ranges * (0.25 if i % per else tolerance)) for i in range(1, ranges)]
    done: list[tuple[int, int]] = []
    groups = [(0, bins, goals)]                        # bytes below, bins, goals in them
    while groups:
        still: dict[tuple[int, int], tuple[int, list]] = {}
        for below, bins, wanted in groups:
            i = 0
            for p1, p2, size, n in bins:
                mine = []
                while i < len(wanted) and (wanted[i][0] < below + size or (p1, p2) == bins[-1][:2]):
                    mine.append(wanted[i])
                    i += 1
                if mine and size > min(ok for _, ok in mine) and n > 1 and bits < KEY_BITS:
                    still[(p1, p2)] = (below, mine)
                else:                                  # cut at the nearer edge
                    for g, _ in mine:
                        low = g - below <= below + size - g
                        done.append(_boundary(bits, p1, p2) if low
                                    else _above(_boundary(bits, p1, p2), bits))
                below += size
        if not still:
            break
        inside = (bits, list(still))
        bits += NEXT_BITS
        finer: dict[tuple[int, int], list] = {k: [] for k in still}
        back = bits - NEXT_BITS
        for r in histogram(bits, inside):
            parent = ((r.p1 >> NEXT_BITS, 0) if bits <= 64
                      else (r.p1, 0) if back == 64 else (r.p1, r.p2 >> NEXT_BITS))
            finer[parent].append((r.p1, r.p2, r.b, r.n))
        groups = [(below, sorted(finer[k]), mine) for k, (below, mine) in sorted(still.items())]
    return sorted(done), per


def _above(key: tuple[int, int], bits: int) -> tuple[int, int]:
    """The first key after those that share ``key``'s first ``bits`` bits (may lie past the last key)."""
    k1, k2 = key
    if bits <= 64:
        return k1 + (1 << (64 - bits)), LOWEST
    k2 += 1 << (KEY_BITS - bits)
    return (k1 + 1, LOWEST) if k2 > -LOWEST - 1 else (k1, k2)


def shard(docs: DataFrame, shards: int = 8, range_bytes: int = 128 << 20, tolerance: float = 0.02) -> DataFrame:
    """Documents with size, law, shard, slot and grown_shard.

    Shards are consecutive key ranges of near equal bytes (a null text counts
    one byte, like an empty one); ``slot`` is the place in the shard's key
    order, from 0.  Repeated rows stay neighbours; rows that agree in text and
    doc_id are ordered arbitrarily among themselves and never divided.  An empty table gives an empty
    result.  Input columns named like a result column are replaced, others
    pass through.  A shard is sorted in ranges of about ``range_bytes``, one task each.
    """
    keyed = (replace_columns(docs, ["size", "law", "shard", "slot", "grown_shard", "__shard_k1", "__shard_k2", "__shard_range"])
             .withColumns({"size": _size(), "__shard_k1": F.xxhash64("text"), "__shard_k2": F.xxhash64("doc_id")}))
    keys = stage(keyed.select(F.col("__shard_k1").alias("k1"), F.col("__shard_k2").alias("k2"), F.col("size").alias("bytes")),
                 "shard-keys")
    cuts, ranges_per_shard = find_splitters(keys, shards, range_bytes, tolerance)
    ranges = shards * ranges_per_shard
    # A boundary past the last key leaves the ranges above it empty.
    top = -LOWEST - 1
    inside = [c for c in cuts if c[0] <= top]

    def range_of(k1: str, k2: str):
        if not inside:
            return F.lit(0)
        # Two steps, so that thousands of boundaries cost some tens of comparisons a row.
        step = max(1, int(len(inside) ** 0.5))
        key = F.struct(F.col(k1).alias("a"), F.col(k2).alias("b"))
        first = F.size(F.filter(_marks(inside[step - 1::step]), lambda m: m <= key)) * step
        return first + F.size(F.filter(F.slice(_marks(inside), first + 1, F.lit(step)), lambda m: m <= key))

    counts = {r.r: r.n for r in keys.groupBy(range_of("k1", "k2").alias("r"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    # ``ranges`` rows at most: rows before a range inside its shard.
    before, seen = [], 0
    for r in range(ranges):
        seen = 0 if r % ranges_per_shard == 0 else seen
        before.append(seen)
        seen += counts.get(r, 0)
    starts = F.array(*[F.lit(b).cast("long") for b in before])
    order = Window.partitionBy("__shard_range").orderBy("__shard_k1", "__shard_k2")
    placed = (keyed.withColumn("__shard_range", range_of("__shard_k1", "__shard_k2"))
              .withColumn("slot", F.row_number().over(order) - 1 + F.get(starts, F.col("__shard_range")))
              .withColumn("shard", F.floor(F.col("__shard_range") / ranges_per_shard).cast("int")))
    return placed.withColumns({"law": F.lit("bytes"), "slot": F.col("slot").cast("long"),
                               "grown_shard": F.lit(None).cast("int")}).drop("__shard_k1", "__shard_k2", "__shard_range")


def _marks(keys: list[tuple[int, int]]):
    return F.expr("array(" + ",".join(f"struct(CAST('{a}' AS BIGINT) as a, CAST('{b}' AS BIGINT) as b)" for a, b in keys) + ")")
