"""Parser rules on an inline dump."""

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postlens.sources.rdf import rdf_to_tables

DUMP = """@prefix sioc: <http://rdfs.org/sioc/ns#> .

_:e5 rdf:type nee:Entity ; nee:detectedAs "orphan" ; nee:hasMatchedURI <u:0> ; nee:confidence "-1.0"^^xsd:double .
schema:interactionType schema:LikeAction ; schema:userInteractionCount "9"^^xsd:integer .
_:t100 rdf:type sioc:Post ; dc:created "2013-01-05T10:00:00Z"^^xsd:dateTime ; sioc:id "100" ; sioc:has_creator _:uab12 ;
   schema:interactionType schema:LikeAction ; schema:userInteractionCount "3"^^xsd:integer .
   schema:interactionType schema:LikeAction ; schema:userInteractionCount "4"^^xsd:integer .
   onyx:hasEmotionCategory wna:positive-emotion ; onyx:hasEmotionIntensity "0.5"^^xsd:double .
_:e1 rdf:type nee:Entity ; nee:detectedAs "alpha" ; nee:hasMatchedURI <u:1> ; nee:confidence "-0.5"^^xsd:double .
_:t777 schema:mentions _:e2 .
_:e2 rdf:type nee:Entity ; nee:detectedAs "beta" ; nee:hasMatchedURI <u:2> ; nee:confidence "-0.2"^^xsd:double .
_:m1 rdf:type sioc:UserAccount ; sioc:name "someone" .
_:t101 rdf:type sioc:Post ; dc:created "2013-01-06T11:00:00Z"^^xsd:dateTime ; sioc:id "101" ; sioc:has_creator _:u0f ;
   onyx:hasEmotionCategory wna:negative-emotion ; onyx:hasEmotionIntensity "0.25"^^xsd:double .
"""


def test_parse_rules(spark):
    d = tempfile.mkdtemp(prefix="postlens-rdf-")
    with gzip.open(os.path.join(d, "month_2013-01.n3.gz"), "wt") as f:
        f.write(DUMP)
    tw, ent, men = rdf_to_tables(spark, d)
    t = sorted(tuple(r) for r in tw.select("tweet_id", "likes", "shares", "positive_emotion",
                                           "negative_emotion", "user_id", "year_month").collect())
    # header-less like dropped; repeated like: last wins; missing values default 0
    assert t == [("100", 4, 0, 0.5, 0.0, "ab12", "2013-01"), ("101", 0, 0, 0.0, 0.25, "0f", "2013-01")]
    e = sorted(tuple(r) for r in ent.select("tweet_id", "detected_as").collect())
    # entity before any header is dropped; a mentions-link line switches the id
    assert e == [("100", "alpha"), ("777", "beta")]
    assert [tuple(r) for r in men.select("tweet_id", "username").collect()] == [("777", "someone")]


def test_convert_skips_done_months(spark):
    from postlens.sources.rdf import convert_dump
    src = tempfile.mkdtemp(prefix="postlens-src-")
    out = tempfile.mkdtemp(prefix="postlens-out-")
    for ym in ("2013-01", "2013-02"):
        with gzip.open(os.path.join(src, f"month_{ym}.n3.gz"), "wt") as f:
            f.write(DUMP)
    assert sorted(r.status for r in convert_dump(spark, src, out).collect()) == ["converted"] * 2
    assert sorted(r.status for r in convert_dump(spark, src, out).collect()) == ["skipped"] * 2
    tw = spark.read.parquet(f"{out}/tweets")
    assert sorted((r.year_month, r.n) for r in tw.groupBy("year_month").count()
                  .withColumnRenamed("count", "n").collect()) == [("2013-01", 2), ("2013-02", 2)]


def test_month_files_reader(spark):
    from postlens.sources.tables import paired_months, read_kind
    d = tempfile.mkdtemp(prefix="postlens-mf-")
    import pyarrow as pa
    import pyarrow.parquet as pq
    t = pa.table({"tweet_id": ["1"], "created_at": pa.array([None], pa.timestamp("us")),  # no zone
                  "user_id": ["u"], "likes": pa.array([1], pa.int32()), "shares": pa.array([0], pa.int32()),
                  "positive_emotion": pa.array([0.0], pa.float32()),
                  "negative_emotion": pa.array([0.0], pa.float32())})
    e = pa.table({"tweet_id": ["1"], "detected_as": ["a"], "matched_uri": ["u"],
                  "confidence": pa.array([0.0], pa.float32())})
    pq.write_table(t, os.path.join(d, "month_2013-01_tweets.parquet"))
    pq.write_table(t, os.path.join(d, "month_2013-02_tweets.parquet"))
    pq.write_table(e, os.path.join(d, "month_2013-01_entities.parquet"))
    assert [r.year_month for r in read_kind(spark, d, "tweets").orderBy("year_month").collect()] == \
        ["2013-01", "2013-02"]
    assert [r.year_month for r in paired_months(spark, d).collect()] == ["2013-01"]


HEADER = ('_:t%d rdf:type sioc:Post ; dc:created "2013-01-05T10:00:00Z"^^xsd:dateTime ; sioc:id "%d" ; '
          'sioc:has_creator _:uab12 ;')
LIKE = 'schema:interactionType schema:LikeAction ; schema:userInteractionCount "%d"^^xsd:integer .'
ENTITY = '_:e1 rdf:type nee:Entity ; nee:detectedAs "%s" ; nee:hasMatchedURI <u:%d> ; nee:confidence "-0.5"^^xsd:double .'
LINK = "_:t%d schema:mentions _:e1 ."


def brute(lines):
    """The parser's rules, line by line: {id: likes} of posts in order, and (id, name) of entities."""
    import re
    posts, ents, cur, now = [], [], None, None
    for x in map(str.strip, lines):
        if m := re.match(r'_:t\d+ rdf:type sioc:Post.*sioc:id "(\d+)"', x):
            posts.append([m[1], 0])
            cur = now = m[1]
        elif m := re.search(r'LikeAction ; .*"(\d+)"', x):
            if now is not None:
                posts[-1][1] = int(m[1])
        elif m := re.match(r"_:t(\d+) schema:mentions", x):
            cur = m[1]
        elif (m := re.search(r'detectedAs "([^"]+)"', x)) and cur is not None:
            ents.append((cur, m[1]))
    return sorted(map(tuple, posts)), sorted(ents)


def parsed(spark, lines, name="month_2013-01.n3.gz"):
    d = tempfile.mkdtemp(prefix="postlens-rdf-")
    with (gzip.open if name.endswith(".gz") else open)(os.path.join(d, name), "wt") as f:
        f.write("\n".join(lines) + "\n")
    tw, ent, _ = rdf_to_tables(spark, d)
    return (sorted((r.tweet_id, r.likes) for r in tw.collect()), sorted((r.tweet_id, r.detected_as) for r in ent.collect()))


@pytest.mark.parametrize("lines", [
    [HEADER % (1, 1)],
    [HEADER % (1, 1), ENTITY % ("a", 1)],
    [ENTITY % ("a", 1), LIKE % 3],
    [LINK % 5, ENTITY % ("a", 1)],
    [HEADER % (1, 1), HEADER % (2, 2), *[x for i in range(10_000) for x in (LINK % i, ENTITY % (f"n{i % 7}", i))]],
    [HEADER % (1, 1), LIKE % 1, *[LINK % i for i in range(25_000)], LIKE % 2, HEADER % (2, 2)],
    [HEADER % (1, 1), *[LIKE % i for i in range(25_000)]],
    [HEADER % (1, 1), ENTITY % ("x rdf:type sioc:Post y", 1)],
    [],
])
def test_dumps_without_a_post_in_every_batch(spark, lines):
    assert parsed(spark, lines) == brute(lines)


@pytest.mark.parametrize("size", [700, 5_000, 50_000])
def test_plain_files_may_be_cut_anywhere(spark, size):
    lines = [LIKE % 77, ENTITY % ("orphan", 0)]
    for i in range(400):
        lines += [HEADER % (i, i), LIKE % (i % 50), *[x for j in range(i % 9) for x in (LINK % (1000 + j), ENTITY % (f"n{j}", j))]]
        lines += [LIKE % (i % 31)] * (i % 3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = parsed(spark, lines, "month_2013-01.n3")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == brute(lines)


def test_open_post_holds_five_rows_at_most():
    import pyarrow as pa

    from postlens.sources.rdf import _last_of_each
    rows = pa.table({"kind": ["header"] + ["like", "pos"] * 500, "a": [str(i) for i in range(1001)]})
    assert _last_of_each(rows).to_pylist() == [{"kind": "header", "a": "0"}, {"kind": "like", "a": "999"}, {"kind": "pos", "a": "1000"}]


def counts(spark, out, table="tweets"):
    return {r.year_month: r["count"] for r in spark.read.parquet(f"{out}/{table}").groupBy("year_month").count().collect()}


def write_gz(src, ym, posts, cut=1.0):
    data = gzip.compress("\n".join(x for i in range(posts) for x in (HEADER % (i, i), LIKE % i)).encode())
    with open(os.path.join(src, f"month_{ym}.n3.gz"), "wb") as f:
        f.write(data[:int(len(data) * cut)])


@pytest.mark.parametrize("lenient", ["false", "true"])
def test_cut_gzip_fails_its_month_and_is_repaired(spark, lenient):
    from postlens.sources.rdf import convert_dump
    src, out = tempfile.mkdtemp(prefix="postlens-src-"), tempfile.mkdtemp(prefix="postlens-out-")
    write_gz(src, "2013-01", 50)
    write_gz(src, "2013-02", 60_000, cut=0.6)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", lenient)
    try:
        got = {r.year_month: r for r in convert_dump(spark, src, out).collect()}
        assert {m: r.status for m, r in got.items()} == {"2013-01": "converted", "2013-02": "failed"} and got["2013-02"].error
        assert counts(spark, out) == {"2013-01": 50}
        write_gz(src, "2013-02", 60_000)
        assert {r.year_month: r.status for r in convert_dump(spark, src, out).collect()} == {"2013-01": "skipped", "2013-02": "converted"}
        assert counts(spark, out) == {"2013-01": 50, "2013-02": 60_000}
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_months_without_rows_are_done_too(spark):
    from postlens.sources.rdf import convert_dump
    src, out = tempfile.mkdtemp(prefix="postlens-src-"), tempfile.mkdtemp(prefix="postlens-out-")
    write_gz(src, "2013-01", 5)                                  # no entities, no user mentions
    with gzip.open(os.path.join(src, "month_2013-02.n3.gz"), "wt") as f:
        f.write("@prefix x: <y> .\n")                            # nothing at all
    assert {r.status for r in convert_dump(spark, src, out).collect()} == {"converted"}
    for table in ("tweets", "entities", "mentions"):
        assert sorted(x for x in os.listdir(f"{out}/{table}") if x.startswith("year")) == ["year_month=2013-01", "year_month=2013-02"]
    assert {r.status for r in convert_dump(spark, src, out).collect()} == {"skipped"}


def test_month_labels_come_from_the_files_own_name(spark):
    from postlens.sources.rdf import _month_of
    from postlens.sources.tables import month_label
    paths = {"/d/month_2013-01b.n3.gz": "2013-01b", "/month_x/year_month=2013-02/part-0.gz": "2013-02", "/d/foo.n3": "foo",
             "/month_9/month_2013-03.n3": "2013-03"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in df.select("p", _month_of(F.col("p")).alias("m")).collect()} == paths
    tables = {"/month_z/month_2013-01b_tweets.parquet": "2013-01b", "/d/month_2013-01_entities.parquet": "2013-01",
              "/month_q/year_month=2013-02/part-0.parquet": "2013-02", "/d/other.parquet": "other"}
    df = spark.createDataFrame([(p,) for p in tables], "p string")
    assert {r.p: r.m for r in df.select("p", month_label("p").alias("m")).collect()} == tables


@pytest.mark.parametrize("name", ["month_2013-01.n3.gz", "month_2013-01.n3"])
def test_one_file_feeds_many_tasks(spark, name):
    """A single stream is inflated once; its parts are parsed apart and agree on posts that they cut."""
    from postlens.sources import rdf
    lines = [LIKE % 77, ENTITY % ("orphan", 0)]
    for i in range(900):
        lines += [HEADER % (i, i), "", *[LIKE % (i % 50)] * (i % 40), *[x for j in range(i % 9) for x in (LINK % (1000 + j), ENTITY % (f"n{j}", j))]]
    d = tempfile.mkdtemp(prefix="postlens-rdf-")
    with (gzip.open if name.endswith(".gz") else open)(os.path.join(d, name), "wt") as f:
        f.write("\n".join(lines) + "\n")
    inflated = rdf.inflate(rdf.read_dump_lines(spark, d), 500)
    assert len(inflated.inputFiles()) > 20 and inflated.rdd.getNumPartitions() >= min(6, spark.sparkContext.defaultParallelism)
    whole = brute(lines)
    for per_file in (37, 1000, 10**6):
        tw, ent, _ = rdf.tables_from_parsed(rdf.parse_dump(spark, d, spread=True, inflated_lines=per_file))
        assert sorted((r.tweet_id, r.likes) for r in tw.collect()) == whole[0]
        assert sorted((r.tweet_id, r.detected_as) for r in ent.collect()) == whole[1]


def test_uneven_gzip_files_are_spread(spark):
    from postlens.sources import rdf
    src = tempfile.mkdtemp(prefix="postlens-src-")
    write_gz(src, "2013-01", 3000)
    write_gz(src, "2013-02", 10)
    assert rdf._shape(rdf.dump_labels(spark, src)) == (False, True)
    even = tempfile.mkdtemp(prefix="postlens-src-")
    for m in range(1, 13):
        write_gz(even, f"2013-{m:02d}", 50)
        write_gz(even, f"2014-{m:02d}", 50)
    assert rdf._shape(rdf.dump_labels(spark, even)) == (False, False)
    labels = {r.year_month for r in rdf.rdf_to_tables(spark, even)[0].select("year_month").distinct().collect()}
    assert len(labels) == 24 and {"2013-01", "2014-12"} <= labels


def test_a_pattern_runs_once_a_line_and_none_on_the_path(spark):
    from postlens.sources import rdf
    src = tempfile.mkdtemp(prefix="postlens-src-")
    write_gz(src, "2013-01", 5)
    plan = rdf._classify(rdf.read_dump_lines(spark, src))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("regexp_replace(") == 8
    assert not [x for x in plan.splitlines() if "file_path" in x and "regexp" in x]


@pytest.mark.parametrize("blank", [" ", "\t", "\x0b", " \t\f"])
def test_blanks_before_a_line(spark, blank):
    lines = [HEADER % (1, 1), LIKE % 5, LINK % 9, ENTITY % ("a", 1)]
    assert parsed(spark, [blank + x + blank for x in lines]) == brute(lines)
    assert parsed(spark, [blank + "@prefix x: " + x for x in lines]) == ([], [])


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_a_large_month_is_written_in_more_files_with_posts_whole(spark, compression):
    """A file is a task's work: it holds about so many rows, whatever its month holds."""
    from postlens.sources import rdf
    n = 400
    tweets = spark.range(n).selectExpr(
        "CAST(id AS string) tweet_id", "TIMESTAMP_NTZ '2013-01-05 10:00:00' created_at", "'ab' user_id", "CAST(id % 9 AS int) likes",
        "IF(id % 5 = 0, NULL, 1) shares", "CAST(0.5 AS float) positive_emotion", "CAST(NULL AS float) negative_emotion",
        "IF(id < 390, '2013-01', '2013-02') year_month")
    entities = spark.range(3 * n).selectExpr(
        "CAST(id % 400 AS string) tweet_id", "concat('n', id) detected_as", "concat('u:', id) matched_uri",
        "CAST(-1 AS float) confidence", "IF(id % 400 < 390, '2013-01', '2013-02') year_month")
    mentions = tweets.selectExpr("tweet_id", "concat('m', tweet_id) username", "year_month")
    out = os.path.join(tempfile.mkdtemp(prefix="postlens-dump-"), "d")
    rdf.write_dump(rdf.render_dump(tweets, entities, mentions), out, 1, compression, file_records=100)
    files = [x for x in os.listdir(f"{out}/year_month=2013-01") if x.startswith("part")]
    assert len(files) > 10 and len([x for x in os.listdir(f"{out}/year_month=2013-02") if x.startswith("part")]) == 1
    tw, ent, men = rdf.rdf_to_tables(spark, out)
    keys = ["tweet_id", "likes", "year_month"]
    assert sorted(map(tuple, tw.select(*keys).collect())) == sorted(map(tuple, tweets.select(*keys).collect()))
    assert {r.shares for r in tw.collect()} == {0, 1} and {r.negative_emotion for r in tw.collect()} == {0.0}
    names = ["tweet_id", "detected_as", "year_month"]
    assert sorted(map(tuple, ent.select(*names).collect())) == sorted(map(tuple, entities.select(*names).collect()))
    assert sorted(map(tuple, men.collect())) == sorted(map(tuple, mentions.collect()))


def test_a_dump_row_is_shuffled_as_fields_and_sorted_once(spark):
    from postlens.sources import rdf
    rows = rdf.render_dump(*[spark.createDataFrame([], s + ", year_month string") for s in (
        "tweet_id string, created_at timestamp_ntz, user_id string, likes int, shares int, positive_emotion float, negative_emotion float",
        "tweet_id string, detected_as string, matched_uri string, confidence float", "tweet_id string, username string")])
    assert "value" not in rows.columns
    text = rows.withColumn("k3", F.lit(0)).sortWithinPartitions("year_month", "k0", "k3").select("year_month", rdf._lines().alias("value"))
    assert "Generate" not in text._jdf.queryExecution().executedPlan().toString()


def test_splits_of_a_plain_dump_grow_with_it():
    from postlens.plans import catalog
    assert catalog._split_bytes(0) == catalog._split_bytes(1 << 24) == catalog.FX_SPLIT_BYTES
    for size in (1 << 34, 1 << 37):
        assert size / catalog._split_bytes(size) <= catalog.FX_SPLITS + 1


def test_of_a_repeated_post_the_last_header_has_the_values(spark):
    from postlens.sources import rdf
    post = ("7", None, "ab", 3, 4, 0.5, 0.25, "2013-01")
    tweets = spark.createDataFrame([post, post], "tweet_id string, created_at string, user_id string, likes int, shares int, "
                                                 "positive_emotion float, negative_emotion float, year_month string")
    tweets = tweets.withColumn("created_at", F.expr("TIMESTAMP_NTZ '2013-01-05 10:00:00'"))
    none = spark.createDataFrame([], "tweet_id string, detected_as string, matched_uri string, confidence float, year_month string")
    out = os.path.join(tempfile.mkdtemp(prefix="postlens-dump-"), "d")
    rdf.write_dump(rdf.render_dump(tweets, none, none.selectExpr("tweet_id", "detected_as username", "year_month")), out)
    assert sorted((r.likes, r.shares) for r in rdf.rdf_to_tables(spark, out)[0].collect()) == [(0, 0), (3, 4)]


def test_turns_hold_every_row_once_and_about_as_many_each():
    from postlens.sources import rdf
    counts = [(None, 3), ("1995", 1000), ("1996", 10), ("1997", 0), ("1998", 95)]
    for size in (1, 50, 100, 10_000):
        turns = rdf._turns(counts, size)
        most = max(size, -(-sum(n for _, n in counts) // rdf.MOST_TURNS))
        rows = dict(counts)
        assert all(sum(rows[m] / of for m, _, of in t) <= most + 1e-6 for t in turns) and len(turns) <= 2 * rdf.MOST_TURNS
        for month, n in counts:
            mine = [(i, of) for t in turns for m, i, of in t if m == month]
            assert sorted(i for i, _ in mine) == list(range(len(mine))) and {of for _, of in mine} <= {len(mine)} and bool(mine) == (n > 0)
    assert rdf._turns([], 10) == [[]]


@pytest.mark.parametrize("turn_records", [60, 100_000])
def test_a_dump_used_in_turns_is_there_a_turn_at_a_time(spark, turn_records):
    from postlens.session import ensure_checkpoint_dir
    from postlens.sources import rdf
    n = 120
    tweets = spark.range(n).selectExpr(
        "CAST(id DIV 2 AS string) tweet_id", "TIMESTAMP_NTZ '2013-01-05 10:00:00' created_at", "'ab' user_id", "CAST(id DIV 2 AS int) likes",
        "1 shares", "CAST(0.5 AS float) positive_emotion", "CAST(NULL AS float) negative_emotion",
        "CASE WHEN id < 90 THEN '2013' WHEN id < 116 THEN '2014' END year_month")
    entities = tweets.selectExpr("tweet_id", "'n' detected_as", "concat('u:', tweet_id) matched_uri", "CAST(-1 AS float) confidence", "year_month")
    mentions = tweets.selectExpr("tweet_id", "concat('m', tweet_id) username", "year_month")
    out = os.path.join(tempfile.mkdtemp(prefix="postlens-dump-"), "d")
    stages = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "stage")
    before, seen, shares, ids = set(os.listdir(stages)) if os.path.isdir(stages) else set(), [], [], []

    def use(folder, share):
        assert os.listdir(out) == [os.path.basename(folder)]                      # the turns before are gone
        tables = rdf.rdf_to_tables(spark, folder)
        ids.append({(r.tweet_id, r.year_month) for r in tables[0].collect()})
        seen.append([sorted(map(tuple, t.collect())) for t in tables])
        shares.append(share)

    rdf.use_in_turns(rdf.render_dump(tweets, entities, mentions), out, use, 1, "none", 20, turn_records)
    assert (len(seen) > 3) == (turn_records == 60) and abs(sum(shares) - 1) < 1e-6 and len(seen) == len(shares)
    assert sum(map(len, ids)) == len(set().union(*ids))                           # a post of a month never spans two
    assert os.listdir(out) == [] and set(os.listdir(stages)) == before
    whole = f"{out}-whole"
    rdf.write_dump(rdf.render_dump(tweets, entities, mentions), whole, 1, "none", 20)
    for got, want in zip(zip(*seen), rdf.rdf_to_tables(spark, whole)):
        assert sorted(x for part in got for x in part) == sorted(map(tuple, want.collect()))


def test_the_plain_dump_does_not_stay_on_disk(spark, tmp_path, monkeypatch):
    from functools import partial

    from postlens.plans import catalog
    from postlens.session import ensure_checkpoint_dir
    from postlens.sources import rdf
    orders = spark.range(90).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1.0D * id AS o_totalprice",
                                        "CAST(add_months(DATE '1997-01-05', CAST(id % 30 AS INT)) AS TIMESTAMP) AS o_orderdate")
    lines = spark.range(180).selectExpr("id % 90 AS l_orderkey", "id % 5 AS l_partkey", "0.0D AS l_discount")
    parts = spark.range(5).selectExpr("id AS p_partkey", "concat('B', id) AS p_brand", "'SMALL' AS p_type")
    customers = spark.range(7).selectExpr("id AS c_custkey", "concat('C#', id) AS c_name")
    for name, rows in (("orders", orders), ("lineitem", lines), ("part", parts), ("customer", customers)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(rdf, "use_in_turns", partial(rdf.use_in_turns, turn_records=100), raising=False)
    root = ensure_checkpoint_dir(spark).removeprefix("file:")

    def there():
        return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}

    before = there()
    got = catalog.QUERIES["rdf_plain_split"](spark, str(tmp_path))
    made = there() - before
    assert made and not [f for f in made if f.endswith(".txt") or "/stage/" in f]
    assert got.count() == 90 and {r.year_month for r in got.collect()} == {f"{1997 + m // 12}-{m % 12 + 1:02d}" for m in range(30)}
