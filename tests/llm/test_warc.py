import gzip
import hashlib
import io
import os

import pytest

from postlens.llm import warc as W
from tests.llm.helpers import LONG, assert_oracle

PAGES = "page_id long, url string, html string, record_id string, digest string, row int"
BIG = "<p>é\r\n\r\n" + "x" * 1200
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/ 9\r\nX: y", BIG), (3, None, None), (4, "http://b", ""),
        (5, "http://c", "short"), (6, "http://c", "short"), (7, "http://l", LONG), (8, "http://u", "漢" * 400),
        (10, "http://u", "漢" * 400), (None, "http://n", BIG), (11, "http://x", "WARC/1.0\r\nContent-Length: 3\r\n\r\n" * 60)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra", "extra", 0) for r in rows], PAGES)


def test_oracle(spark, sf_small):
    assert_oracle(spark, sf_small, "op7_warc")


def brute(rows):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and best[h] != (-1 if i is None else i)
        out.append((-1 if i is None else i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    got = W.round_trip(pages(spark), str(tmp_path)).collect()
    mine = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in got]
    assert sorted(mine, key=str) == brute(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(r.payload == html[r.page_id] for r in got if r.record_type == "response")
    assert {r.page_id: r.target_uri for r in got}[9] == "http://a/%209%20%20X:%20y"


def test_archives_and_sidecar_index(spark, tmp_path):
    W.round_trip(pages(spark).coalesce(1), f"file:{tmp_path}").collect()
    mono = [f for f in os.listdir(tmp_path / "monolithic") if f.endswith(".gz")]
    assert mono and not [f for f in os.listdir(tmp_path / "normalised") if "attempt" in f]
    for f in mono:
        raw = (tmp_path / "monolithic" / f).read_bytes()
        new = (tmp_path / "normalised" / (f.removesuffix(".txt.gz") + ".warc.gz")).read_bytes()
        assert gzip.decompress(new) == gzip.decompress(raw)                    # the same records
        assert len(list(W.split_records(io.BytesIO(new)))) == len(list(W.split_records(io.BytesIO(raw))))
        at = 0
        for line in (tmp_path / "normalised" / (f.removesuffix(".txt.gz") + ".warc.gz.idx")).read_text().splitlines():
            offset, length, record_id, kind, _ = line.split("\t")
            assert int(offset) == at
            member = gzip.decompress(new[at:at + int(length)])                 # a gzip member of its own
            assert member.startswith(b"WARC/1.0\r\n") and record_id.encode() in member and kind.encode() in member
            at += int(length)
        assert at == len(new)


def record(body=b"hello", extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n%s\r\n%s\r\n\r\n" % (len(body), extra, body)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_split_streams(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    records = [record(b"a" * n, b"X: y\r\n" * (n % 3)) for n in (0, 1, 5, 300)]
    one = gzip.compress(b"".join(records))
    many = b"".join(gzip.compress(r) for r in records)
    halves = gzip.compress(b"".join(records)[:200]) + gzip.compress(b"".join(records)[200:]) + b"\0" * 9
    for stream in (one, many, halves):
        assert [r for _, r in W.split_records(io.BytesIO(stream))] == records
    assert list(W.split_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("stream", [gzip.compress(record())[:-9], gzip.compress(record()[:-6]), gzip.compress(b"no record\r\n\r\n"),
                                    b"plain", gzip.compress(record()) + b"junk"])
def test_cut_streams_are_refused(stream):
    with pytest.raises(ValueError):
        list(W.split_records(io.BytesIO(stream), "x"))


def test_digests_in_either_writing():
    raw = hashlib.sha1(b"x").digest()
    import base64
    assert W._digest_hex("sha1:" + raw.hex().upper()) == W._digest_hex("sha1:" + base64.b32encode(raw).decode()) == raw.hex()


def test_ties_and_empty(spark, tmp_path):
    got = W.round_trip(pages(spark, [(5, "u", BIG)] * 3), str(tmp_path / "a")).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to_page for r in got if r.record_type == "revisit"} == {5}
    assert W.round_trip(pages(spark, []), str(tmp_path / "b")).collect() == []
