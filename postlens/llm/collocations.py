"""Phrase collocation mining by a multikey three-way quicksort of word suffixes.

A suffix pointer is a word's place in a text; its key is that word and those
after it in the same piece, up to the greatest phrase length.

1. Tasks read texts into word numbers and add up equal suffixes of a few
   million words; a row holds the suffixes of one leading word.
2. Suffixes are routed by their leading words: by the first word, by the
   first two where one word has more suffixes than a task's fair share, by
   the first three where a pair has, and so on.  All suffixes of a leading
   phrase meet in one task, and no task gets more than about a share.
3. A task drops leading phrases that are too rare and sorts the others by a
   multikey three-way quicksort, all partitions of a round at once: keys of
   one depth are split around a pivot, the equal part goes one word deeper
   and its size is the count of the phrase; parts below the least count are
   abandoned.  Sorting ends at the greatest phrase length.

Counts, cuts and scores are exact integers (38 digits).
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, stage, stage_compressed

by_value(__name__)

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
CONTAINED_PERCENT = 50       # of a candidate's occurrences inside a longer one
UNKNOWN_LANG = "und"
CHUNK_WORDS = 2_000_000      # words whose equal suffixes a task adds up at a time
SORT_SUFFIXES = 1_000_000    # distinct suffixes that are sorted at a time (a leading phrase is not divided)
TEXT_BYTES = 1 << 20         # of a text, split into words at a time
SEED = 7

#: Pieces end at .,;:!? and the ends of lines; a tab separates words as a blank does.
_BYTES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_ROWS = "lang string, lead string, words int, n long, tails binary, counts binary"


# Suffixes
def words_of(text: bytes):
    """Lists of lower-cased words of a text, a bounded part at a time; a line feed is the end of a piece."""
    data, at = text.lower().translate(_BYTES), 0
    while at < len(data):
        cut = data.find(b" ", at + TEXT_BYTES) if len(data) - at > TEXT_BYTES else -1
        end = cut if cut >= 0 else len(data)
        yield filter(None, data[at:end].replace(b"\n", b" \n ").split(b" "))
        at = end
    yield (b"\n",)


def _added_up(lang, stream: array, known: dict, depth: int):
    """Rows of the equal suffixes of a stream of word numbers, in which 0 ends a piece."""
    ids = np.frombuffer(stream, np.int32)
    keys = np.zeros((depth, len(ids)), np.int32)
    keys[0] = ids
    for d in range(1, depth):
        keys[d, :-1] = keys[d - 1, 1:]
        keys[d, keys[d - 1] == 0] = 0
    keys = keys[:, ids != 0]
    if not keys.shape[1]:
        return
    keys = keys[:, np.lexsort(keys[::-1])]
    new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, keys.shape[1])).astype("<u4")
    keys = keys[:, at]
    words = [b""] * len(known)
    for w, i in known.items():
        words[i] = w
    words[0] = b""
    tails = [words[i] for i in keys[1:].T.ravel().tolist()]
    first = np.flatnonzero(np.append(True, keys[0, 1:] != keys[0, :-1]))
    ends = np.append(first[1:], len(at))
    sums = np.add.reduceat(counts.astype(np.int64), first)
    step = depth - 1
    for s, e, lead, n in zip(first.tolist(), ends.tolist(), keys[0, first].tolist(), sums.tolist()):
        yield lang, words[lead], 1, n, b" ".join(tails[s * step:e * step]), counts[s:e].tobytes()


def _batches(rows, size: int = 4 << 20):
    """Record batches of rows (bytes where strings are), of bounded size."""
    def batch(out):
        lang, lead, words, n, tails, counts = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(lead, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()),
             pa.array(n, pa.int64()), pa.array(tails, pa.binary()), pa.array(counts, pa.binary())],
            ["lang", "lead", "words", "n", "tails", "counts"])

    out, held = [], 0
    for r in rows:
        out.append(r)
        held += 64 + len(r[4]) + len(r[5])
        if held > size:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def suffixes(docs: DataFrame, lang: Column, text: str, depth: int, chunk_words: int) -> DataFrame:
    """(lang, lead, words, n, tails, counts): a chunk's suffixes of one leading word.

    ``tails`` are the ``depth - 1`` words after it of each distinct suffix,
    blank-separated and empty beyond the piece; ``counts`` how often each
    occurs, and ``n`` their sum.
    """
    def run(batches):
        def fresh():
            known = defaultdict(None, {b"\n": 0})
            known.default_factory = known.__len__
            return array("i"), known

        chunk, held = defaultdict(fresh), 0

        def rows():
            for lang, (stream, known) in chunk.items():
                yield from _added_up(lang, stream, known, depth)

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lang, t in zip(b.column(0).to_pylist(), texts):
                stream, known = chunk[lang]
                before = len(stream)
                for part in words_of(t.as_py() or b""):
                    stream.extend(map(known.__getitem__, part))
                held += len(stream) - before
                if held >= chunk_words:
                    yield from _batches(rows())
                    chunk.clear()
                    held = 0
        yield from _batches(rows())

    return docs.select(lang.alias("lang"), F.col(text).alias("text")).mapInArrow(run, _ROWS)


# Routing
def _split_leads(rows: DataFrame, depth: int) -> DataFrame:
    """The same suffixes, one leading word more in each row."""
    def run(batches):
        def split():
            for b in batches:
                for lang, lead, words, tails, counts in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                    step, fields, lead = depth - words, tails.split(b" "), lead.encode()
                    each = np.frombuffer(counts, "<u4").astype(np.int64)
                    for word, group in groupby(range(len(each)), key=lambda i: fields[i * step]):
                        if word:                              # else the piece ends with the lead
                            own = list(group)
                            rest = [f for i in own for f in fields[i * step + 1:(i + 1) * step]]
                            yield lang, lead + b" " + word, words + 1, int(each[own].sum()), b" ".join(rest), counts[own[0] * 4:own[-1] * 4 + 4]

        yield from _batches(split())

    return rows.mapInArrow(run, _ROWS)


def _by_leading_words(rows: DataFrame, depth: int, parts: int):
    """(rows to sort, counts of the leads that were split): leads grow by a word until none has more than a fair share."""
    share = (rows.agg(F.sum("n")).first()[0] or 0) / parts
    level, cold, split = rows, [], []
    for words in range(1, depth + 1):
        if words == depth:                                    # whole phrases: nothing left to sort
            split.append(level.groupBy("lang", "lead", "words").agg(F.sum("n").alias("n")))
            break
        sums = level.groupBy("lang", "lead", "words").agg(F.sum("n").alias("n"))
        hot = stage(sums.where(F.col("n") > share), "collocation-hot")     # fewer than ``parts`` rows
        if hot.isEmpty():
            cold.append(level)
            break
        keys = F.broadcast(hot.select("lang", "lead"))
        cold.append(level.join(keys, ["lang", "lead"], "left_anti"))
        split.append(hot)
        level = _split_leads(level.join(keys, ["lang", "lead"], "left_semi").select(*rows.columns), depth)
    return reduce(DataFrame.unionByName, cold), split


# Sorting
def multikey_quicksort(keys: np.ndarray, weights: np.ndarray, part: np.ndarray, least: int):
    """(row, depth, count) of every prefix that occurs ``least`` times or more, ``row`` being one that has it.

    ``keys`` is depth x rows, 0 beyond a piece; rows of one initial partition
    lie together.  Every round splits all partitions around a pivot each, into
    less, equal and greater; equal parts go a key deeper, and parts that weigh
    less than ``least`` are abandoned.
    """
    depth, rnd = keys.shape[0], np.random.default_rng(SEED)
    rows = np.arange(keys.shape[1])
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    level = np.zeros(len(first), np.int64)
    found = []
    while len(rows) and depth:
        size = np.diff(np.append(first, len(rows)))
        mine = np.repeat(np.arange(len(first)), size)
        key = keys[level[mine], rows]
        pivot = key[first + (rnd.random(len(first)) * size).astype(np.int64)]
        side = np.sign(key - pivot[mine]) + 1
        # Stable three-way placement: where each part of each partition begins, and the place inside the part.
        inside, count = np.zeros(len(rows), np.int64), np.zeros((len(first), 3), np.int64)
        for s in range(3):
            is_side = side == s
            run = np.cumsum(is_side)
            base = run[first] - is_side[first]
            count[:, s] = run[first + size - 1] - base
            inside[is_side] = (run - base[mine] - 1)[is_side]
        begin = (np.cumsum(count.ravel()) - count.ravel()).reshape(-1, 3)
        order = np.empty(len(rows), np.int64)
        order[begin[mine, side] + inside] = rows
        begin, count, deep = begin.ravel(), count.ravel(), np.repeat(level, 3)
        equal = np.tile([False, True, False], len(first))
        live = np.flatnonzero(count)
        begin, count, deep, equal = begin[live], count[live], deep[live], equal[live]
        weight = np.add.reduceat(weights[order], begin)
        keep = weight >= least
        ended = equal & (keys[deep, order[begin]] == 0)       # the piece ends here: no phrase of that length
        told = keep & equal & ~ended
        found.append((order[begin[told]], deep[told] + 1, weight[told]))
        keep &= ~ended & ~(equal & (deep + 1 == depth))
        rows = order[np.repeat(keep, count)]
        level, count = (deep + equal)[keep], count[keep]
        first = np.cumsum(count) - count
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _sorted_counts(rows: DataFrame, depth: int, least: int, parts: int, sort_suffixes: int) -> DataFrame:
    """(lang, phrase, words, f): leads and the phrases that begin with them, if they occur ``least`` times."""
    def run(batches):
        def leads():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(6)))

        def counted(held):
            """Held leads have one length."""
            if not held:
                return
            words, step = held[0][2], depth - held[0][2]
            sizes = [len(c) // 4 for h in held for c in h[5]]
            known = defaultdict(None, {b"": 0})
            known.default_factory = known.__len__
            fields = b" ".join(t for h in held for t in h[4]).split(b" ")
            keys = np.fromiter(map(known.__getitem__, fields), np.int32, len(fields)).reshape(-1, step).T
            weights = np.frombuffer(b"".join(c for h in held for c in h[5]), "<u4").astype(np.int64)
            part = np.repeat(np.repeat(np.arange(len(held)), [len(h[5]) for h in held]), sizes)
            row, deep, n = multikey_quicksort(np.ascontiguousarray(keys), weights, part, least)
            for r, d, f in zip(row.tolist(), deep.tolist(), n.tolist()):
                lead = held[part[r]]
                tail = b" ".join(fields[r * step:r * step + d]).decode()
                yield lead[0], f"{lead[1]} {tail}", words + d, f

        def phrases():
            held, size = [], 0
            for (lang, words, lead), group in groupby(leads(), key=lambda r: (r[0], r[2], r[1])):
                tails, counts, n = [], [], 0
                for r in group:
                    tails.append(r[4])
                    counts.append(r[5])
                    n += r[3]
                if n < least:
                    continue                                  # abandoned unread
                yield lang, lead, words, n
                if words < depth:
                    if held and (held[0][2] != words or size >= sort_suffixes):
                        yield from counted(held)
                        held, size = [], 0
                    held.append((lang, lead, words, n, tails, counts))
                    size += sum(map(len, counts)) // 4
            yield from counted(held)

        def batch(out):
            lang, phrase, words, f = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()),
                                               pa.array(f, pa.int64())], ["lang", "phrase", "words", "f"])

        out = []
        for p in phrases():
            out.append(p)
            if len(out) == 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    routed = rows.repartition(parts, "lang", "lead").sortWithinPartitions("lang", "words", "lead")
    return routed.mapInArrow(run, "lang string, phrase string, words int, f long")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                  chunk_words: int = CHUNK_WORDS, sort_suffixes: int = SORT_SUFFIXES):
    """((lang, phrase, words, f), (lang, n)): phrases of 1 to ``max_words`` words with f >= ``min_count``; all word occurrences.

    Texts are whole, a null one is empty; a null language is ``und``.
    """
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = suffixes(docs, F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)), text, max_words, chunk_words)
    rows = stage_compressed(rows, "collocation-suffixes")
    sums = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    cold, split = _by_leading_words(rows, max_words, parts)
    counts = _sorted_counts(cold, max_words, min_count, parts, sort_suffixes)
    for s in split:
        counts = counts.unionByName(s.where(F.col("n") >= min_count).select("lang", F.col("lead").alias("phrase"), "words", F.col("n").alias("f")))
    return counts, sums


# Scores
def mine(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
         top: int = TOP, contained_percent: int = CONTAINED_PERCENT, chunk_words: int = CHUNK_WORDS,
         sort_suffixes: int = SORT_SUFFIXES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's collocations, best first.

    Candidates are phrases of 2 to ``max_words`` words with a >= ``min_count``.
    ``score`` is the lowest floor(1000000 a a / (l r)) over the cuts into a
    first part and a rest, ties to the earliest ``cut``.  A candidate inside a
    longer one that has ``contained_percent`` of its occurrences is dropped.
    Every row is counted, repeated rows too; a null language is ``und``, a null
    text is empty, words and pieces are cut at ASCII characters only.  An empty
    table gives an empty result.  Other columns are not read.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words at least, and candidates occur once at least")
    counts, sums = phrase_counts(docs, lang, text, max_words, min_count, chunk_words, sort_suffixes)
    counts = stage(counts, "collocation-counts")
    long = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = (long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
            .withColumn("rest", F.expr("substring_index(phrase, ' ', cut - words)"))
            .join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"__above": (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"),
                             "__below": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("__above div __below"))
    lowest = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "words")).alias("c"))
              .select("lang", "phrase", "c.*"))
    inner = (long.where("words > 2")
             .select("lang", F.col("a").alias("outer"), F.split("phrase", " ").alias("w"), "words")
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "outer")
             .groupBy("lang", "phrase").agg(F.max("outer").alias("outer")))
    kept = (lowest.join(inner, ["lang", "phrase"], "left")
            .where(F.col("outer").isNull() | (100 * F.col("outer") < contained_percent * F.col("a"))))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return (ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut"))
