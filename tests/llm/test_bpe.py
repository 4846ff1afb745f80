"""Byte-level BPE: ids and bytes against the tiktoken library, both tiers, awkward rows."""

import hashlib
import struct

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import bpe

CASES = ["", " ", "a", "It's we're they'll 'sa x'sab !'s 's \t's\n's  's 'S don't'd''s", " \n a", "a  b   c\n\n d \n", "'", "a'",
         "''re're", "'r", "'lll", "été 日本語 \U0001f600\U0001f600   x", "<|endoftext|>", "\x00\x1c\x85 \x85a",
         "1234567 ١٢ ½", "a" * 5000, " " * 5000 + "b", "zxqj" * 3000]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.default_ranks())


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return bpe.character_classes()


def encoded(encoder, texts):
    ids, until = encoder.encode(texts)
    until = np.append(0, until)
    return [ids[a:b].tolist() for a, b in zip(until[:-1], until[1:])]


def test_hash_is_minimal_and_perfect(ranks, vocabulary):
    h, keys = vocabulary.hash, list(ranks)
    assert sorted(h.keys_at.tolist()) == list(range(len(keys)))
    data = np.frombuffer(b"".join(keys), np.uint8)
    lengths = np.array([len(k) for k in keys])
    slots = h.lookup(data, np.cumsum(lengths) - lengths, lengths)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (h.keys_at[slots] == np.arange(len(keys))).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 256])
def test_hash_of_few_keys(n):
    keys = [b"k%d" % i for i in range(n)]
    assert sorted(bpe.PerfectHash(keys).keys_at.tolist()) == list(range(n))


def test_words_that_are_entries_and_words_that_are_not(vocabulary, ranks):
    import pyarrow as pa
    words = [b" the", b"the", b"", b"zxqj", b"\xff", b"\x00", b"x" * 500]
    ids, found = vocabulary.find(pa.array(words, pa.large_binary()))
    assert found.tolist() == [w in ranks for w in words]
    assert [i for i, f in zip(ids.tolist(), found) if f] == [ranks[w] for w in words if w in ranks]


def test_cases(vocabulary, classes, library):
    encoder = bpe.Encoder(vocabulary, classes, bpe.default_pattern())
    assert encoded(encoder, CASES) == [library.encode_ordinary(t) for t in CASES]


def test_every_character(vocabulary, classes, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}!{c}" for c in every[i:i + 4000]) for i in range(0, len(every), 4000)]
    encoder = bpe.Encoder(vocabulary, classes, bpe.default_pattern())
    for t in texts:
        assert encoded(encoder, [t]) == [library.encode_ordinary(t)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abstrevlmd''' \n\t\r12!.é 日\U0001f600ſ")), max_size=40), max_size=6))
def test_any_text(vocabulary, classes, library, texts):
    forgetful = bpe.Encoder(vocabulary, classes, bpe.default_pattern(), remembered=0)
    by_pattern = bpe.Encoder(vocabulary, None, bpe.default_pattern())
    want = [library.encode_ordinary(t) for t in texts]
    if texts:
        assert encoded(forgetful, texts) == want
        assert encoded(forgetful, texts) == want
        assert encoded(by_pattern, texts) == want


def test_merge_takes_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert bpe.merge(b"aaa", ranks) == [2, 0]
    assert bpe.merge(b"aaaab", ranks) == [2, 4]          # then the two a at the end take the b
    assert bpe.merge(b"bab", ranks) == [1, 3]


def test_vocabulary_without_every_byte_is_refused(tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.load_ranks(str(tmp_path / "few.tiktoken"))


def test_awkward_rows(spark, library):
    rows = [(1, None, 5, "x"), (None, "It's", 5, None), (3, "", 5, "x"), (3, "", 5, "x"), (4, "zq" * 300_000, 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int, ids string")
    got = bpe.decode(bpe.encode(docs, batch_chars=1000)).collect()
    assert bpe.encode(docs).columns == ["doc_id", "text", "n_tokens", "ids"]
    assert len(got) == 5
    for r in got:
        want = library.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want) and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    assert bpe.encode(docs, keep_text=False).columns == ["doc_id", "n_tokens", "ids"]


def test_unknown_id_fails(spark):
    bad = spark.createDataFrame([(bytearray(struct.pack("<I", 60000)),)], "ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad).collect()


def test_null_ids_decode_to_no_bytes(spark):
    got = bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first()
    assert bytes(got.decoded) == b""


def test_query(spark, sf_small, library):
    import __spark_entry__ as E
    got = {r.doc_id: r for r in E.queries()["op13_bpe"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, text = library.encode_ordinary(d.text or ""), (d.text or "").encode()
        r = got[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_no_shuffle(spark, sf_small):
    import __spark_entry__ as E
    plan = E.queries()["op13_bpe"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
