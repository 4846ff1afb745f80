"""Log prompt extraction: filters, malformed lines, numbering across partitions."""

import json
import os
import tempfile

from postlens.operators.sequence import global_row_number
from postlens.plans.prompts import extract_prompts, prompt_log_summary
from postlens.sources.logs import read_jsonl_logs


def _rec(content, typ="user", role="user", meta=False, ts="2026-01-01T10:00:00Z"):
    return json.dumps({"type": typ, "isMeta": meta, "timestamp": ts,
                       "message": {"role": role, "content": content}})


def test_extract_prompts(spark):
    d = tempfile.mkdtemp(prefix="postlens-logs-")
    with open(os.path.join(d, "b.jsonl"), "w") as f:
        f.write("\n".join([
            _rec("  second  ", ts="2026-01-01T10:05:00Z"),
            "{not json",
            "",
            _rec("<command-name>x</command-name>"),
            _rec("<wrapped>"),
            _rec(["list", "content"]),
            _rec("meta", meta=True),
            _rec("assistant says", typ="assistant", role="assistant"),
        ]) + "\n")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(_rec("first", ts="2026-01-01T09:00:00Z") + "\n" + _rec("third", ts="2026-01-01T11:00:00Z"))
    with open(os.path.join(d, "c.jsonl"), "w") as f:
        f.write(_rec("<local-command-stdout>") + "\n")
    logs = read_jsonl_logs(spark, d)
    got = [tuple(r) for r in extract_prompts(logs).orderBy("n").collect()]
    assert got == [(1, "a", "2026-01-01 09:00 UTC", "first", True),
                   (2, "b", "2026-01-01 10:05 UTC", "second", True),
                   (3, "a", "2026-01-01 11:00 UTC", "third", True)]
    s = prompt_log_summary(logs).collect()[0]
    assert (s.n_sessions, s.n_prompts) == (3, 3)


def test_global_row_number_is_dense_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id * 7 % 5000 AS k")
    got = global_row_number(df, ["k"]).select("k", "n").collect()
    assert sorted((r.n, r.k) for r in got) == [(i + 1, i) for i in range(5000)]


def test_times_are_utc_in_any_session_zone(spark):
    d = tempfile.mkdtemp(prefix="postlens-logs-")
    stamps = {"2024-01-02T12:00:00Z": "2024-01-02 12:00 UTC", "2024-01-02T12:00:00.5+02:00": "2024-01-02 10:00 UTC",
              "2024-01-02T23:30:00-05:00": "2024-01-03 04:30 UTC", "2024-03-10T02:30:00": "2024-03-10 02:30 UTC", "soon": "soon"}
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write("\n".join(_rec(f"prompt {t}", ts=t) for t in stamps))
    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r.content: r.timestamp for r in extract_prompts(read_jsonl_logs(spark, d)).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
        assert got == {f"prompt {t}": want for t, want in stamps.items()}


def test_empty_log_files_count_as_sessions(spark):
    from postlens.sources.logs import log_files
    d = tempfile.mkdtemp(prefix="postlens-logs-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(_rec("hello"))
    open(os.path.join(d, "b.jsonl"), "w").close()
    with open(os.path.join(d, "c d.jsonl"), "w") as f:
        f.write(_rec("a name that is written differently in a URI"))
    got = prompt_log_summary(read_jsonl_logs(spark, d), log_files(spark, d)).first()
    assert (got.n_sessions, got.n_prompts) == (3, 2)
    assert log_files(spark, f"{d}/*.jsonl").count() == 3 and log_files(spark, f"{d}/none").isEmpty()
