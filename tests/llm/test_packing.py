import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import packing as P
from tests.llm.helpers import ROWS, docs, empty


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(P.default_tokenizer())


def ids_of(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def check(pieces, want, length=2048):
    """Every id of every row in exactly one piece; sequences gapless, full but for the last."""
    docs_seen, seqs = {}, {}
    for p in pieces:
        docs_seen.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert set(docs_seen) == set(want)
    for d, mine in docs_seen.items():
        times = {}
        for p in mine:
            ids = np.array(want[d][p.start:p.start + p.length], "<u4")
            assert p.length == len(ids) and p.doc_tokens == len(want[d]) and p.ids_crc32 == zlib.crc32(ids.tobytes())
            for i in range(p.start, p.start + p.length):
                times[i] = times.get(i, 0) + 1
        assert len(times) == len(want[d]) and len(set(times.values())) == 1
    assert sorted(seqs) == list(range(len(seqs)))
    for s, mine in seqs.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == len(seqs) - 1 and 0 < at <= length


def test_ids_are_those_of_the_tokenizers_library(reference, sf_small):
    import pyarrow.parquet as pq
    enc = P.load_encoder(P.default_tokenizer())
    texts = pq.read_table(f"{sf_small}/documents.parquet")["text"].to_pylist()
    texts += ["", " ", "a  b\n\n c", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "don't I'LL we've 123 ½ ñ 漢字 🙂", " \t\x00x"]
    for t in texts:
        assert P.encode(enc, t or "").tolist() == reference.encode(t or "", add_special_tokens=False).ids


def test_long_texts_go_by_parts(reference):
    enc = P.load_encoder(P.default_tokenizer())
    t = "Ab cd  ef'll 12 x\n\n yz. " * 500
    for size in (7, 100, 1001):
        assert P.encode(enc, t, at_once=size).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_query(spark, sf_small, reference):
    import __spark_entry__ as E
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    check(E.queries()["op4_pack"](spark, sf_small).collect(), {d: ids_of(reference, t) for d, t in text.items()})


def test_windows_keep_the_target_proportions(spark):
    rows = [(i, "word " * (50 + i % 300), "en", "abc"[i % 7 % 3], 0) for i in range(3000)]
    pieces = P.pack(docs(spark, rows, False), length=512, window_sequences=64)
    share = pieces.groupBy("source").agg(F.sum("length").alias("n")).toPandas().set_index("source")["n"]
    share = (share / share.sum()).sort_index()
    w = pieces.groupBy("window_id", "source").agg(F.sum("length").alias("n")).toPandas().pivot(index="window_id", columns="source", values="n")
    w = w.iloc[:-1]
    assert len(w) > 10 and (w.div(w.sum(axis=1), axis=0) - share).abs().max().max() < 0.02
    # Deficits are carried: up to any window, a queue is at most one packet behind its credit.
    behind = np.arange(1, len(w) + 1)[:, None] * 512 * 64 * share.to_numpy() - w.cumsum().to_numpy()
    assert behind.min() >= -1 and behind.max() <= 512


def test_weights(spark):
    rows = [(i, "word " * 100, "en", "ab"[i % 2], 0) for i in range(2000)]
    pieces = P.pack(docs(spark, rows, False), length=256, window_sequences=32, weights={"a": 3.0, "b": 1.0})
    first = pieces.where("window_id < 5").groupBy("source").agg(F.sum("length").alias("n")).collect()
    n = {r.source: r.n for r in first}
    assert n["a"] / n["b"] == pytest.approx(3, rel=0.05)


def test_sequences(spark, reference):
    pieces = P.pack(docs(spark), length=64)
    rows = P.sequences(pieces, 64, pad_id=7).collect()
    assert all(len(r.ids) == (r.tokens if r.tokens & (r.tokens - 1) == 0 else 64) for r in rows)
    short = [r for r in rows if r.tokens < 64]
    assert len(short) <= 1 and all(set(r.ids[r.tokens:]) <= {7} for r in short)
    whole = sorted(i for r in rows for i in r.ids[:r.tokens])
    assert whole == sorted(i for r in ROWS for i in ids_of(reference, r[1]))


def test_awkward_rows(spark, reference):
    check(P.pack(docs(spark)).collect(), {r[0]: ids_of(reference, r[1]) for r in ROWS})
    assert P.pack(empty(spark)).collect() == []
