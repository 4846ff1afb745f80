"""Ranked lexical search by presence masks.

One pass over the documents keeps, of each, its length and the counts of the
terms that any item asks for.  A second pass takes the documents in blocks.
In a block every item term is a list of the documents that hold it; setting
bit j for the documents of term j gives each document a mask, its documents
fall into groups of equal masks, and a mask's greatest score is the sum of
its terms' greatest contributions.  Groups are scored by descending greatest
score until the next one is below the k-th score found: no later document can
reach it.  What a block returns, k rows an item at most, is merged by rank.

Items go in blocks of bounded text (their terms are sent to the tasks); a
larger item table takes further passes.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import by_value, stage

by_value(__name__)

TOP = 20
ITEM_BYTES = 8 << 20         # item text that one pass sends to the tasks
BLOCK_POSTINGS = 3_000_000   # document terms that are grouped at a time
TEXT_BYTES = 1 << 20         # of a text, split into terms at a time
FIRST_SCORED = 64            # documents that are scored first (a whole group at least); then twice as many each time

#: Terms are runs of ASCII letters, digits and all that is not ASCII; A-Z are lower-cased.
_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes):
    """Lists of the terms of a UTF-8 text, a bounded part of it at a time."""
    data, at = text.translate(_BYTES), 0
    while at < len(data):
        cut = data.find(b" ", at + TEXT_BYTES) if len(data) - at > TEXT_BYTES else -1
        end = cut if cut >= 0 else len(data)
        yield data[at:end].split()
        at = end


# First pass
def term_counts(docs: DataFrame, asked: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term: its length, and its counts of the asked terms."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        get = shared.value.get
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at in range(0, b.num_rows, 512):
                keep, ns, terms, tfs, ends = [], [], [], [], [0]
                for i, t in enumerate(texts.slice(at, 512)):
                    n, counts = 0, Counter()
                    for part in terms_of(t.as_py() or b""):
                        n += len(part)
                        counts.update(map(get, part))
                    counts.pop(None, None)
                    if n:
                        keep.append(at + i)
                        ns.append(n)
                        terms += counts.keys()
                        tfs += counts.values()
                        ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>"))


# Second pass
class Block:
    """Documents in the order in which ties are broken, and each term's documents and contributions."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        rows = rows.take(pc.sort_indices(rows.column("doc_id"), null_placement="at_start")).combine_chunks()
        self.ids = rows.column("doc_id")
        n = rows.column("n").to_numpy()
        if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
            length = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
        else:
            length = 75 + 25 * n * n_docs // max(1, n_terms)
        lists = rows.column("terms")
        sizes = pc.list_value_length(lists).to_numpy()
        doc = np.repeat(np.arange(len(n)), sizes)
        term, tf = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "tfs"))
        by_term = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        self.value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length[self.doc]))
        self.terms, self.first = np.unique(term, return_index=True)
        self.end = np.append(self.first[1:], len(term))
        self.most = np.maximum.reduceat(self.value, self.first) if len(term) else self.value

    def best(self, asked: np.ndarray, times: np.ndarray, k: int):
        """(documents, scores) of the k best of the block, best first."""
        at = np.searchsorted(self.terms, asked)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == asked[there]
        at, times = at[there], times[there]
        lists = [(self.doc[self.first[j]:self.end[j]], self.value[self.first[j]:self.end[j]]) for j in at]
        docs, group, bound = self._groups(lists, times * self.most[at])
        by_bound = np.argsort(-bound, kind="stable")
        place = np.empty(len(bound), np.int64)
        place[by_bound] = np.arange(len(bound))
        docs = docs[np.argsort(place[group], kind="stable")]
        bound, ends = bound[by_bound], np.cumsum(np.bincount(group, minlength=len(bound))[by_bound])
        top_d, top_s, begin, done, share = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, FIRST_SCORED
        while done < len(bound) and bound[done] > 0 and not (len(top_s) == k and bound[done] < top_s[-1]):
            done = max(done + 1, int(np.searchsorted(ends, begin + share, side="right")))
            some = docs[begin:ends[done - 1]]
            score = np.zeros(len(some), np.int64)
            for (mine, value), t in zip(lists, times):
                where = np.minimum(np.searchsorted(mine, some), len(mine) - 1)
                score += np.where(mine[where] == some, t * value[where], 0)
            top_d, top_s = np.concatenate((top_d, some)), np.concatenate((top_s, score))
            order = np.lexsort((top_d, -top_s))[:k]
            order = order[top_s[order] > 0]
            top_d, top_s = top_d[order], top_s[order]
            begin, share = ends[done - 1], 2 * share
        return top_d, top_s

    def _groups(self, lists, most):
        """(documents, their group, greatest score of each group); a group is a mask of present terms."""
        group, bound = np.zeros(len(self.ids), np.int64), np.zeros(1, np.int64)
        for low in range(0, len(lists), 62):                # masks of up to 62 terms; more terms split the groups again
            mask, own = np.zeros(len(self.ids), np.int64), most[low:low + 62]
            for j, (mine, _) in enumerate(lists[low:low + 62]):
                mask[mine] |= 1 << j
            masks, which = np.unique(mask, return_inverse=True)
            has = sum((masks >> j & 1) * m for j, m in enumerate(own))
            both, group = np.unique(group * len(masks) + which, return_inverse=True)
            bound = bound[both // len(masks)] + has[both % len(masks)]
        held = np.flatnonzero(bound[group] > 0) if lists else np.zeros(0, np.int64)
        return held, group[held], bound


def _best_of_blocks(counts: DataFrame, queries: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, k: int,
                    id_type: str, block_postings: int) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        held, size = [], 0

        def results():
            block = Block(pa.Table.from_batches(held), weights, n_docs, n_terms)
            items, docs, scores = [], [], []
            for key, asked, times in queries:
                d, s = block.best(asked, times, k)
                items.append(np.full(len(d), key, np.int64))
                docs.append(d)
                scores.append(s)
            docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            taken = block.ids.take(pa.array(docs, pa.int64()))
            if isinstance(taken, pa.ChunkedArray):
                taken = taken.combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(items) if items else docs), taken,
                                               pa.array(np.concatenate(scores) if scores else docs)], ["item", "doc_id", "score"])

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                held.append(part)
                size += pc.sum(pc.list_value_length(part.column(2))).as_py() or 0
                if size >= block_postings:
                    yield results()
                    held, size = [], 0
        if held:
            yield results()

    return counts.mapInArrow(run, f"item long, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties by document id.

    Every row of ``docs`` is a document (repeated rows too; a null id comes
    first among equal scores); a null text has no terms and is no document of
    the statistics.  Item rows that are equal in id and text are one item; an
    item without terms, or whose terms no document holds, has no rows.  Empty
    tables give an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    kinds = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / item_bytes))
    found = []
    for p in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        asked, queries, ids = {}, [], []
        for row in mine.collect():               # about item_bytes of text
            own = Counter(t for part in terms_of((row.text or "").encode()) for t in part)
            if own:
                numbers = [asked.setdefault(t, len(asked)) for t in own]
                queries.append((len(ids), np.array(numbers, np.int64), np.array(list(own.values()), np.int64)))
                ids.append((len(ids), row.item_id))
        counts = stage(term_counts(docs, asked, doc_id, text), "ranked-terms")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(asked), np.int64)
        for term, df in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():     # asked terms only
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        best = _best_of_blocks(counts, queries, weights, n_docs, n_terms, k, kinds[1], block_postings)
        in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(ids, f"item long, item_id {kinds[0]}")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)
