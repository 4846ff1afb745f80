"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenised once and queue up by source in the order of a hash of
their id.  Packets (a document's consecutive slices of at most one sequence)
are served in rounds: a round, the window, credits every queue its quantum,
``window tokens x target proportion``; a queue sends packets while its credit
covers them and carries the rest, its deficit, into the next window.  A packet
whose last token is the E-th of its queue is thus served in window
``ceil(E / quantum)``, so no state has to walk the data: two distributed
running totals (over the queues, then over the served stream) carry deficits
and positions across windows and partitions.  The stream is cut every
``length`` tokens; only the very last sequence can be short.

Only (id, source, count) rows are sorted; token ids are stored once and move
once, when each document meets its pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, stage, stage_compressed

by_value(__name__)

LENGTH = 2048
WINDOW_SEQUENCES = 32
END_ID = 1
MOST_BROADCAST_ROWS = 50_000
PIECE_BYTES = 8 << 20        # token bytes in one output batch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Tokenisation
def _byte_letters() -> dict[str, int]:
    """The printable letters by which a byte-level vocabulary file writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def load_encoder(path: str):
    """text -> ids of a byte-level BPE file of the tokenizers library, added tokens included.

    The ids are those of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)`` (tested over whole tables); the same ranks run
    about five times faster in tiktoken.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(encoder, text: str, at_once: int = 1 << 20) -> np.ndarray:
    """Ids of a text of any length.  Long ones go by parts cut before a space that follows a
    letter and precedes one, where the word pattern always starts a new word."""
    if len(text) <= at_once:
        return encoder.encode_to_numpy(text, allowed_special="all")
    import re

    cut, parts, start = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])"), [], 0
    while len(text) - start > at_once:
        m = cut.search(text, start + at_once)
        if not m:
            break
        parts.append(encoder.encode_to_numpy(text[start:m.start()], allowed_special="all"))
        start = m.start()
    parts.append(encoder.encode_to_numpy(text[start:], allowed_special="all"))
    return np.concatenate(parts)


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, queue, n, ids): every document's ids with ``end_id`` after them, 16 bits an id (32 if needed)."""
    path = path or default_tokenizer()

    def run(batches):
        encoder = load_encoder(path)
        small = max(encoder.max_token_value, end_id) < 1 << 16
        for b in batches:
            texts = b.column(2).to_pylist()
            for at in range(0, len(texts), 256):
                ids = [np.append(encode(encoder, t or ""), end_id).astype("<u2" if small else "<u4")
                       for t in texts[at:at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 256), b.column(1).slice(at, 256), pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "queue", "n", "ids"])

    queue = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")
            .mapInArrow(run, "doc_id long, queue string, n long, ids binary"))


# Running totals
def running_total(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """+ ``out``: sum of ``value`` over the earlier rows of the group, and ``out``_all, the group's sum.

    Rows are range-partitioned by (group, order), so a group of any size
    spans as many tasks as its share; what is combined is one row for each
    partition and group that meet.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stage(df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()), "pack-range")
    sums = placed.groupBy(group, "__part").agg(F.sum(value).alias("__s"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(sums.withColumns({"__base": F.coalesce(F.sum("__s").over(earlier), F.lit(0)),
                                   f"{out}_all": F.sum("__s").over(Window.partitionBy(group))}).drop("__s"), "pack-base")
    if base.count() <= MOST_BROADCAST_ROWS:
        base = F.broadcast(base)
    inside = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(base, [group, "__part"])
            .withColumn(out, F.col("__base") + F.col("__in")).drop("__part", "__in", "__base"))


# Packing
def schedule(counts: DataFrame, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES,
             weights: dict[str, float] | None = None) -> DataFrame:
    """Packets (uid, queue, start, tokens, window, place) of documents (uid, doc_id, queue, n).

    Targets are the queues' own proportions, so that all run dry together, or
    ``weights`` by source (1 where not named); then a queue that has run dry
    loses its turn and windows hold the others in proportion.
    """
    queued = running_total(counts.withColumn("__h", F.xxhash64("doc_id")), "queue", ["__h", "doc_id", "uid"], "n", "before")
    budget = float(length * window_sequences)
    if weights is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        quantum = F.lit(budget / total) * F.col("before_all")
    else:
        named = F.lit(1.0)
        for s, w in weights.items():
            named = F.when(F.col("queue") == "s" + s, F.lit(float(w))).otherwise(named)
        whole = counts.select("queue").distinct().agg(F.sum(named)).first()[0] or 1.0
        quantum = F.lit(budget / whole) * named
    slots = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / length) - 1)
    packets = (queued.withColumn("slot", F.explode(slots)).withColumn("start", F.col("slot") * length)
               .withColumn("tokens", F.least(F.lit(length), F.col("n") - F.col("start")).cast("long")))
    last = F.col("before") + F.col("start") + F.col("tokens")
    packets = packets.withColumn("window", F.ceil(last / quantum) - 1).withColumn("at", last)
    served = running_total(packets.select("uid", "queue", "start", "tokens", "window", "at", F.lit(0).alias("all")),
                           "all", ["window", "queue", "at"], "tokens", "place")
    return served.select("uid", "queue", "start", "tokens", "window", "place")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH,
         window_sequences: int = WINDOW_SEQUENCES, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces: doc_id, source, start, length, doc_tokens, window_id, sequence_id, offset, token_bytes, ids_crc32.

    ``token_bytes`` are the piece's ids as little-endian unsigned 32-bit
    numbers.  A null text is an empty one (its document is the end id alone);
    a null source is a queue of its own; every row is a document, repeated
    rows too.  An empty table gives an empty result.  Other columns are not
    read.
    """
    # The row number is written with the ids, so that all later steps see the same.
    rows = tokenize(docs, path, end_id).withColumn("uid", F.monotonically_increasing_id())
    rows = stage_compressed(rows, "pack-ids")
    served = schedule(rows.select("uid", "doc_id", "queue", "n"), length, window_sequences, weights)
    runs = served.groupBy("uid").agg(F.collect_list(F.struct("start", "tokens", "window", "place")).alias("runs"))

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("window_id", pa.int64()), ("sequence_id", pa.int64()),
                            ("offset", pa.int64()), ("token_bytes", pa.binary()), ("ids_crc32", pa.int64())])
        for b in batches:
            out, size = [], 0
            for doc_id, queue, n, raw, parts in zip(*(b.column(i) for i in range(5))):
                raw, n = raw.as_buffer(), n.as_py()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4")
                source = None if (q := queue.as_py()) == "n" else q[1:]
                for p in sorted(parts.as_py(), key=lambda p: p["start"]):
                    start, place, left = p["start"], p["place"], p["tokens"]
                    while left:
                        take = min(left, length - place % length)
                        piece = ids[start:start + take].astype("<u4").tobytes()
                        out.append((doc_id.as_py(), source, start, take, n, p["window"], place // length, place % length,
                                    piece, zlib.crc32(piece)))
                        start, place, left, size = start + take, place + take, left - take, size + 4 * take
                        if size > PIECE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (rows.join(runs, "uid").select("doc_id", "queue", "n", "ids", "runs")
            .mapInArrow(cut, "doc_id long, source string, start long, length long, doc_tokens long, window_id long, "
                             "sequence_id long, offset long, token_bytes binary, ids_crc32 long"))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, tokens, ids): each sequence's ids in order, padded to ``length``.

    A sequence whose token count is a power of two is left as it is.  A
    sequence holds at most ``length`` tokens, so one row is bounded.
    """
    parts = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "token_bytes"))).alias("parts"),
        F.sum("length").alias("tokens"))

    def join(batches):
        for b in batches:
            ids = []
            for parts, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = np.frombuffer(b"".join(p["token_bytes"] for p in parts), "<u4").astype(np.int32)
                ids.append(a if n & (n - 1) == 0 else np.pad(a, (0, length - n), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int32()))],
                                             ["sequence_id", "tokens", "ids"])

    return parts.mapInArrow(join, "sequence_id long, tokens long, ids array<int>")

