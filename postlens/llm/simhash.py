"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes over word shingles.  The anchors are the
codewords of a linear covering code (built from a rule in GF(64)): every
fingerprint lives at its nearest anchor, at distance ``r``, its local covering
radius, and is replicated to every anchor within ``r + threshold``.  Of two
fingerprints within the threshold, let x be the one with the smaller radius:
``d(y, home(x)) <= d(x, y) + r(x) <= threshold + r(y)``, so y is replicated to
x's home.  Comparing, per anchor, replicas with homes of no larger radius
therefore finds every link, whatever the code; the local radius never exceeds
the code's covering radius, so this replicates no more than the global bound.

Equal fingerprints are one node from the start.  An anchor that holds many is
dealt over a grid of cells (home chunk x replica chunk), and a cell returns a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, replace_columns, stage
from postlens.llm.components import components

by_value(__name__)

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
HOMES_A_CELL = 4096          # homes, and replicas, that one comparison cell may hold
REPLICAS_A_CELL = 32768


# Fingerprints
def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (XXH64, seed 42); 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()      # bytes: lowers A-Z only, splits at \x20 \x09-\x0d only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    over = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):                     # bounded memory for very long texts
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])),
                        np.uint64)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): fp as a signed long; text_key tells apart texts under one doc_id."""
    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())],
                                             ["doc_id", "text_key", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return src.mapInArrow(run, "doc_id long, text_key long, fp long")


# Anchors
def covering_code(dimension: int) -> np.ndarray:
    """All codewords of a [64, dimension] code: positions are GF(64); rows 1, x, x**3, x**5 by bit."""
    if not 1 <= dimension <= 19:
        raise ValueError("dimension must be in 1..19")

    def times(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            a ^= 0b1000011 if a & 64 else 0            # x**6 + x + 1
        return out

    def power(x, e):
        out = 1
        for _ in range(e):
            out = times(out, x)
        return out

    rows = [(1 << BITS) - 1]
    for e in (1, 3, 5):
        rows += [sum(((power(x, e) >> bit) & 1) << x for x in range(BITS)) for bit in range(6)]
    words = np.zeros(1, np.uint64)
    for row in rows[:dimension]:
        words = np.concatenate([words, words ^ np.uint64(row)])
    return words


def dimension_for(distinct: int) -> int:
    """About 64 homes an anchor: more anchors for more fingerprints, 2**6 to 2**16."""
    return max(6, min(16, int(np.ceil(np.log2(max(distinct, 1) / 64 + 1)))))


def _forest(a: np.ndarray, b: np.ndarray):
    """Spanning links (node, smallest node) of the graph with links a-b (arrays of fingerprints)."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[:len(a)], idx[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while True:                                     # pointer jumping
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _anchored(fps: DataFrame, dimension: int, distance: int) -> DataFrame:
    """(anchor, fp, r, d): each distinct fingerprint at every anchor within r + distance; d == r at home."""
    def run(batches):
        code = covering_code(dimension)
        step = max(1, (1 << 22) >> dimension)           # 4 M distances at a time
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fp), step):
                fp = all_fp[at:at + step]
                d = np.bitwise_count(fp[:, None] ^ code[None, :])
                r = d.min(axis=1)
                home = d.argmin(axis=1)
                row, anchor = np.nonzero(d <= (r + distance)[:, None])
                dist = d[row, anchor].astype(np.int16)
                dist[anchor == home[row]] = -1          # its home
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(fp[row].view(np.int64)),
                     pa.array(r[row].astype(np.int16)), pa.array(dist)], ["anchor", "fp", "r", "d"])

    return fps.select("fp").mapInArrow(run, "anchor int, fp long, r short, d short")


def _chunks(n: int, most: int) -> int:
    return -(-n // most)


def links(fps: DataFrame, distance: int = DISTANCE, dimension: int | None = None,
          homes_a_cell: int = HOMES_A_CELL, replicas_a_cell: int = REPLICAS_A_CELL) -> DataFrame:
    """Links (a, b) that span the graph of distinct fingerprints ``fp`` within ``distance`` bits."""
    spark = fps.sparkSession
    put = _anchored(fps, dimension or dimension_for(fps.count()), distance)
    # One row an anchor, 2**16 at most: the crowded ones are dealt over a grid of cells.
    load = (put.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("d") < 0, 1)).alias("homes"))
            .withColumn("h", F.greatest(F.ceil(F.col("homes") / homes_a_cell), F.lit(1)).cast("int"))
            .withColumn("g", F.ceil(F.col("all") / replicas_a_cell).cast("int"))
            .where("h > 1 or g > 1").select("anchor", "h", "g"))
    load = stage(load, "simhash-crowded")
    one = F.lit(1)
    put = (put.join(F.broadcast(load), "anchor", "left")
           .withColumns({"h": F.coalesce("h", one), "g": F.coalesce("g", one)}))
    at_h = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("h")).cast("int")
    at_g = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("g")).cast("int")
    # A home goes to its chunk in every replica chunk; a replica (homes are replicas too) to every home chunk.
    # Of a row's entries the first ``k`` are homes, one for each replica chunk, the others replicas.
    k = F.when(F.col("d") < 0, F.col("g")).otherwise(0)
    entry = F.explode(F.sequence(F.lit(0), k + F.col("h") - 1))
    home = F.col("e") < F.col("k")
    dealt = (put.withColumn("k", k).withColumn("e", entry)
             .select("anchor", "fp", "r", F.when(F.col("d") < 0, F.col("r")).otherwise(F.col("d")).cast("short").alias("d"),
                     home.alias("home"), F.when(home, at_h).otherwise(F.col("e") - F.col("k")).cast("int").alias("ch"),
                     F.when(home, F.col("e")).otherwise(at_g).cast("int").alias("cg")))

    def compare(batches):
        held: list[tuple] = []
        key = None

        def compared(parts):
            fp, r, d, home = (np.concatenate(c) for c in zip(*parts))
            hf, hr = fp[home], r[home]
            yf, yr, yd = fp[~home], r[~home], d[~home]
            if not len(hf) or not len(yf):
                return None
            order = np.argsort(hr, kind="stable")
            hf, hr = hf[order], hr[order]
            found_a, found_b = [], []
            ask = np.argsort(yr, kind="stable")
            yf, yr, yd = yf[ask], yr[ask], yd[ask]
            # Only homes with d - distance <= r(x) <= r(y) can be partners.
            lo = np.searchsorted(hr, yd - distance, "left")
            hi = np.searchsorted(hr, yr, "right")
            for at in range(0, len(yf), 512):
                s = slice(at, at + 512)
                a, b = int(lo[s].min()), int(hi[s].max())
                if a >= b:
                    continue
                i, j = np.nonzero(np.bitwise_count(yf[s, None] ^ hf[None, a:b]) <= distance)
                one, two = yf[s][i], hf[a:b][j]
                other = one != two
                if other.any():
                    x, y = _forest(np.concatenate([one[other], *found_a]), np.concatenate([two[other], *found_b]))
                    found_a, found_b = [x], [y]
            if not found_a:
                return None
            return pa.RecordBatch.from_arrays([pa.array(found_a[0].view(np.int64)), pa.array(found_b[0].view(np.int64))],
                                              ["a", "b"])

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "ch", "cg", "fp", "r", "d", "home")]
            if not len(cols[0]):
                continue
            change = np.nonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))[0] + 1
            edges = [0, *change.tolist(), len(cols[0])]
            for a, b in zip(edges, edges[1:]):
                this = (cols[0][a], cols[1][a], cols[2][a])
                if key is not None and this != key:
                    if (out := compared(held)) is not None:
                        yield out
                    held = []
                key = this
                held.append((cols[3][a:b].view(np.uint64), cols[4][a:b], cols[5][a:b], cols[6][a:b].astype(bool)))
        if held and (out := compared(held)) is not None:
            yield out

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = (dealt.repartition(n, "anchor", "ch", "cg")
             .sortWithinPartitions("anchor", "ch", "cg"))
    return cells.mapInArrow(compare, "a long, b long")


# Groups
def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    dimension: int | None = None) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id): the near-duplicate group of every document.

    Fingerprints are linked at ``distance`` or fewer differing bits; groups are
    connected components; component_id is a group's smallest doc_id (null only
    if all its doc_ids are).  A null, empty or blank text has fingerprint 0
    and is linked like any other.  Repeated rows each get their row.  An empty table
    gives an empty result; other input columns are not read.
    """
    prints = stage(fingerprints(docs, shingle), "simhash-prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes, distance, dimension), "a", "b")
    roots = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = stage(roots, "simhash-roots")
    lowest = stage(roots.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
    classes = stage(roots.join(lowest, "root").select("fp", "root", "component_id"), "simhash-classes")
    return prints.join(classes, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents, one of each near-duplicate group: the smallest doc_id's (null last), ties by text.

    Rows are kept whole with all their columns; rows repeated in doc_id and
    text count as one document, of which one row stays.
    """
    groups = near_duplicates(docs, shingle, distance)
    first = stage(groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__sim_id"),
                                                            F.col("text_key").alias("__sim_key"))).alias("k"))
                  .select("k.__sim_id", "k.__sim_key"), "simhash-kept")
    rows = replace_columns(docs, ["__sim_id", "__sim_key", "__sim_n"]).withColumns(
        {"__sim_id": F.col("doc_id").cast("long"), "__sim_key": F.xxhash64("text")})
    kept = rows.join(first, (rows["__sim_id"].eqNullSafe(first["__sim_id"])) & (rows["__sim_key"] == first["__sim_key"]), "left_semi")
    one = Window.partitionBy("__sim_id", "__sim_key").orderBy(F.lit(1))
    return kept.withColumn("__sim_n", F.row_number().over(one)).where("__sim_n = 1").drop("__sim_id", "__sim_key", "__sim_n")
