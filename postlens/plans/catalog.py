"""The query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the driver's tables through ``postlens.sources.fixtures``
(or tables Spark built from them) and runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import tables as TB
from postlens.operators.redaction import redaction_table
from postlens.plans.gold import gold_path, is_complete, materialize
from postlens.sources.fixtures import DATE_TOP_N, ENTITY_TOP_N, load_corpus

Query = Callable[[SparkSession, str], DataFrame]


def q_month_table(spark, sf_dir):
    return TB.month_table(load_corpus(spark, sf_dir).tweets)


def q_date_table(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    return TB.date_table(c.tweets, c.entities, top_n=DATE_TOP_N, wordlist=c.words)


def q_entity_table(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    return TB.entity_table(c.tweets, c.entities, top_n=ENTITY_TOP_N, wordlist=c.words)


def gold_month(spark, sf_dir):
    return materialize(spark, sf_dir, "month", lambda: q_month_table(spark, sf_dir))


def _gold_paths(spark, sf_dir, kind):
    """(table, its redaction list), and whether both were written."""
    paths = [gold_path(spark, sf_dir, name) for name in (kind, f"{kind}_redactions")]
    return paths, all(is_complete(spark, p) for p in paths)


def _gold_with_redactions(spark, sf_dir, kind, facts=None):
    """Build a table once and write it with its redaction list (as the builders do).

    Both are read back when both exist; if either is missing both are rebuilt.
    """
    (t_path, r_path), complete = _gold_paths(spark, sf_dir, kind)
    if not complete:
        c = load_corpus(spark, sf_dir)
        fn, n = (TB.date_table, DATE_TOP_N) if kind == "date" else (TB.entity_table, ENTITY_TOP_N)
        table, red = fn(c.tweets, c.entities, n, c.words, with_redactions=True, facts=facts)
        red.write.mode("overwrite").parquet(r_path)
        table.write.mode("overwrite").parquet(t_path)
    return spark.read.parquet(t_path), spark.read.parquet(r_path)


def _gold_date_and_entity(spark, sf_dir):
    """Both tables with their redactions; if both are missing, posts and mentions are read and joined once for the two."""
    kinds, facts = ("date", "entity"), None
    if not any(_gold_paths(spark, sf_dir, k)[1] for k in kinds):
        c = load_corpus(spark, sf_dir)
        facts = TB.post_facts(c.tweets, c.entities)
    return {k: _gold_with_redactions(spark, sf_dir, k, facts) for k in kinds}


def gold_date(spark, sf_dir):
    return _gold_with_redactions(spark, sf_dir, "date")[0]


def gold_entity(spark, sf_dir):
    return _gold_with_redactions(spark, sf_dir, "entity")[0]


def q_redaction_table(spark, sf_dir):
    """Q04: the side table after the date run, then the entity run (S9 upsert)."""
    gold = _gold_date_and_entity(spark, sf_dir)
    return redaction_table(gold["entity"][1], existing=redaction_table(gold["date"][1]))


QUERIES: dict[str, Query] = {
    "month_table": q_month_table,
    "date_table": q_date_table,
    "entity_table": q_entity_table,
    "redaction_table": q_redaction_table,
}


# Reports / explore
from postlens.model import QuerySpec  # noqa: E402
from postlens.plans import explore as X  # noqa: E402
from postlens.plans import reports as R  # noqa: E402

# Fixed fixture parameters (shared with postlens.plans.oracle).
FX_GAP_MONTHS = ("1998-12", "1999-01")
FX_MISSING_MONTHS = ("2000-06",)
FX_CAL_START, FX_CAL_END = "1994-07", "2002-02"
FX_SELECTED = ("brand#1 small", "brand#2 large", "brand#3 medium", "brand#4 promo",
               "brand#5 economy")
FX_NAME = "brand#7 economy"
FX_LO, FX_HI = "1996-01", "1999-12"
FX_GROUPS = {"economy": "economy", "standard": "standard"}
FX_NEEDLE = "d#1"
FX_YEARLY = ("brand#1 small", "brand#2 large", "brand#3 medium")
FX_PARTIAL = {2001: 2}
FX_SPEC = QuerySpec(entities=FX_SELECTED, lo=FX_LO, hi=FX_HI)


def _spec(**kw):
    base = dict(entities=FX_SELECTED, lo=FX_LO, hi=FX_HI)
    base.update(kw)
    return QuerySpec(**base)


QUERIES.update({
    "monthly_volume": lambda s, d: R.monthly_volume(gold_date(s, d), FX_GAP_MONTHS, FX_MISSING_MONTHS),
    "monthly_volume_summary": lambda s, d: R.monthly_volume_summary(gold_date(s, d)),
    "calendar_gaps": lambda s, d: R.calendar_gaps(gold_month(s, d), FX_CAL_START, FX_CAL_END),
    "sentiment_trend": lambda s, d: R.sentiment_trend(gold_date(s, d), k=10),
    "entity_spikiness": lambda s, d: R.entity_spikiness(gold_entity(s, d), top=50, k=20),
    "entity_growth": lambda s, d: R.entity_growth(gold_entity(s, d), top=200, min_months=6, k=20),
    "entity_sentiment": lambda s, d: R.entity_sentiment(gold_entity(s, d), top=100, k=10),
    "top_entity_names": lambda s, d: X.top_entity_names(gold_entity(s, d)),
    "entity_names_by_filter": lambda s, d: X.entity_names_by_filter(gold_entity(s, d)),
    "search_entities": lambda s, d: X.search_entities(gold_entity(s, d), FX_NEEDLE),
    "keyword_group": lambda s, d: X.keyword_group(gold_entity(s, d), FX_GROUPS),
    "yearly_mentions": lambda s, d: X.yearly_mentions(gold_entity(s, d), FX_YEARLY, FX_PARTIAL),
    "entity_timeline": lambda s, d: X.entity_timeline(gold_entity(s, d), FX_NAME),
    "volume_and_net_sentiment": lambda s, d: X.volume_and_net_sentiment(gold_entity(s, d), FX_NAME),
    "net_sentiment_ranking": lambda s, d: X.net_sentiment_ranking(gold_entity(s, d), top=200, k=10),
    "normalized_growth": lambda s, d: X.normalized_growth(gold_entity(s, d), top=500, min_n=6, k=15),
    "filter_entities": lambda s, d: X.filter_entities(gold_entity(s, d), FX_SELECTED, FX_LO, FX_HI),
    "all_entities": lambda s, d: X.all_entities(gold_entity(s, d), FX_LO, FX_HI, cap=200),
    "metric_timeseries": lambda s, d: X.metric_timeseries(gold_entity(s, d), _spec()),
    "metric_timeseries_all": lambda s, d: X.metric_timeseries(
        gold_entity(s, d), _spec(scope="all", metric="positive_sentiment")),
    "metric_ranking": lambda s, d: X.metric_ranking(gold_entity(s, d), _spec(metric="total_likes")),
    "metric_ranking_all": lambda s, d: X.metric_ranking(
        gold_entity(s, d), _spec(scope="all", metric="negative_sentiment")),
    "sentiment_space": lambda s, d: X.sentiment_space(gold_entity(s, d), _spec()),
    "entity_summary": lambda s, d: X.entity_summary(gold_entity(s, d), _spec()),
    "entity_summary_all": lambda s, d: X.entity_summary(gold_entity(s, d), _spec(scope="all")),
    "sentiment_density": lambda s, d: X.sentiment_density(gold_entity(s, d), _spec(scope="all")),
    "month_timeseries": lambda s, d: X.month_timeseries(gold_month(s, d), "total_likes", FX_LO, FX_HI),
    "redacted_share": lambda s, d: X.redacted_share(gold_date(s, d), FX_LO, FX_HI),
    "group_comparison_snapshot": lambda s, d: X.group_comparison_snapshot(
        gold_entity(s, d), FX_GROUPS, FX_LO, FX_HI),
    "group_comparison_frames": lambda s, d: X.group_comparison_frames(
        gold_entity(s, d), FX_GROUPS, FX_LO, FX_HI),
})


# Logs / profile / checks
from postlens.plans.profile import entity_sentiment_profile  # noqa: E402
from postlens.plans.prompts import extract_prompts, prompt_log_summary  # noqa: E402
from postlens.plans.quality import compare_by_id, quality_checks  # noqa: E402
from postlens.sources.fixtures import read_table  # noqa: E402
from postlens.sources.logs import conversations_as_logs  # noqa: E402

FX_MIN_CONFIDENCE = -2.0
FX_PROFILE_MIN_POSTS = 3
FX_AMBIVALENT_AT = 0.5


def _logs(spark, sf_dir):
    return conversations_as_logs(read_table(spark, sf_dir, "conversations"))


def q_entity_sentiment_profile(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    return entity_sentiment_profile(c.tweets, c.entities, FX_MIN_CONFIDENCE, "month",
                                    FX_PROFILE_MIN_POSTS, FX_AMBIVALENT_AT)


def q_quality_checks(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    (date, red_d), (entity, red_e) = _gold_date_and_entity(spark, sf_dir).values()
    return quality_checks(c.tweets, c.entities, gold_month(spark, sf_dir), date, entity,
                          DATE_TOP_N, ENTITY_TOP_N, red_d.unionByName(red_e))


QUERIES.update({
    "extract_prompts": lambda s, d: extract_prompts(_logs(s, d)),
    "prompt_log_summary": lambda s, d: prompt_log_summary(_logs(s, d)),
    "entity_sentiment_profile": q_entity_sentiment_profile,
    "quality_checks": q_quality_checks,
})


# RDF dump
from postlens.sources import rdf as RDF  # noqa: E402
from postlens.sources.fixtures import mentions_from_orders  # noqa: E402


def dump_path(spark, sf_dir):
    """Render the corpus once as a gzip N3 dump in the checkpoint folder."""
    path = gold_path(spark, sf_dir, "n3dump")
    if is_complete(spark, path):
        return path
    c = load_corpus(spark, sf_dir)
    m = mentions_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    RDF.write_dump(RDF.render_dump(c.tweets, c.entities, m), path)
    return path


def _rdf(i):
    def q(spark, sf_dir):
        return RDF.rdf_to_tables(spark, dump_path(spark, sf_dir))[i]
    return q


QUERIES.update({"rdf_tweets": _rdf(0), "rdf_entities": _rdf(1), "rdf_mentions": _rdf(2)})


# Incremental / streaming
import uuid  # noqa: E402

from postlens.streaming import incremental as INC  # noqa: E402
from postlens.streaming import state as STATE  # noqa: E402

FX_FIRST_WAVE_END = "1998-07-15"     # posts up to this day arrive first


def _waves(spark, sf_dir, root):
    """Write the corpus as partitioned sources in two arrival waves.

    Wave 1: posts created up to ``FX_FIRST_WAVE_END`` (so one month arrives
    half-way), all mention files.  Wave 2: the remaining posts.
    """
    c = load_corpus(spark, sf_dir)
    cut = F.col("created_at") <= F.to_timestamp(F.lit(FX_FIRST_WAVE_END + " 23:59:59"))
    tw = c.tweets.select(*[f.name for f in INC.TWEETS_SOURCE.fields])
    ent = c.entities.select(*[f.name for f in INC.ENTITIES_SOURCE.fields])
    ent.write.mode("overwrite").partitionBy("year_month").parquet(f"{root}/entities")
    return (lambda: tw.filter(cut).write.mode("append").partitionBy("year_month").parquet(f"{root}/tweets"),
            lambda: tw.filter(~cut).write.mode("append").partitionBy("year_month").parquet(f"{root}/tweets"))


def q_incremental_date_table(spark, sf_dir):
    root = gold_path(spark, sf_dir, f"incremental/{uuid.uuid4().hex}")
    wave1, wave2 = _waves(spark, sf_dir, root)
    staging = f"{root}/staging"
    wave1()
    require_whole(INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", staging, "date", DATE_TOP_N))
    wave2()
    # resume: new months are built, the half-arrived month is rebuilt
    # because its new file is newer than its staged rows
    require_whole(INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", staging, "date", DATE_TOP_N))
    return INC.assemble(spark, staging, "date", load_corpus(spark, sf_dir).words)


def q_streaming_date_table(spark, sf_dir):
    root = gold_path(spark, sf_dir, f"stream/{uuid.uuid4().hex}")
    wave1, wave2 = _waves(spark, sf_dir, root)
    staging, ckpt = f"{root}/staging", f"{root}/_stream_checkpoint"
    for wave in (wave1, wave2):
        wave()
        require_whole(INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", staging, ckpt, "date", DATE_TOP_N))
    return INC.assemble(spark, staging, "date", load_corpus(spark, sf_dir).words)


QUERIES.update({
    "incremental_date_table": q_incremental_date_table,
    "streaming_date_table": q_streaming_date_table,
})


# Summaries / P17
FX_LO_IDX, FX_HI_IDX = 12, 999      # hi beyond the axis: clamped to the last month

QUERIES.update({
    "date_run_summary": lambda s, d: R.run_summary(gold_date(s, d)),
    "date_sample_rows": lambda s, d: R.sample_rows(
        gold_date(s, d), ["year_month", "entity", "positive_sentiment", "negative_sentiment"]),
    "filter_entities_by_index": lambda s, d: X.filter_entities_by_index(
        gold_entity(s, d), FX_SELECTED, FX_LO_IDX, FX_HI_IDX),
})

QUERIES.update({
    "entity_summary_display": lambda s, d: X.entity_summary_display(gold_entity(s, d), _spec(scope="all")),
})


# Dumps, files and months in unusual shapes
from postlens.operators.redaction import dirty_names  # noqa: E402
from postlens.sources import publish as PUB  # noqa: E402
from postlens.sources import tables as SRC  # noqa: E402
from postlens.sources.manifest import require_whole  # noqa: E402
from postlens.sources.publish import delete_file, put_bytes  # noqa: E402

FX_HOLE_EVERY = 97                  # in the hole dump one post in so many has a header
FX_SPLIT_BYTES = 1 << 18            # splits of the plain dump, at least
FX_SPLITS = 2_000                   # splits of the plain dump, about, where it is larger
FX_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}      # when a query ends
FX_INFLATED_LINES = 20_000          # lines that a task parses of an inflated dump
FX_SWAPPED = ("1995-03", "1997-08")
FX_BAD_MONTH = "1996-04"            # has an unreadable file when the stream first runs
FX_PHRASES = ("pr0m0", "BRAND#2", "brand-4  large", "#", "straße")
FX_LOG_START = "2024-03-09 22:00:00"
FX_LOG_OFFSETS = ("Z", "-05:00", "+02:00")          # by conv_id
FX_LOG_ZONE = "America/New_York"                    # the session's zone while prompts are read


def _scratch(spark, sf_dir, name):
    return gold_path(spark, sf_dir, f"{name}/{uuid.uuid4().hex}")


def _with_conf(spark, conf, run):
    """Run an eager step under other settings."""
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def q_rdf_hole_month(spark, sf_dir):
    """Q05 on a dump that is nearly all header-less mention lines."""
    c = load_corpus(spark, sf_dir)
    few = c.tweets.filter(F.col("tweet_id").cast("long") % FX_HOLE_EVERY == 0)
    m = mentions_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    path = _scratch(spark, sf_dir, "n3hole")
    RDF.write_dump(RDF.render_dump(few, c.entities, m), path, files_per_month=1)
    return RDF.rdf_to_tables(spark, path)[1]


def _split_bytes(size: int) -> int:
    """Small splits, but no more of them than ``FX_SPLITS`` or so: a split costs a task and a file a kind, however small."""
    return max(FX_SPLIT_BYTES, size // FX_SPLITS)


def q_rdf_plain_split(spark, sf_dir):
    """Q05 on plain text files that are read in many splits; of a large dump some files at a time are on disk."""
    c = load_corpus(spark, sf_dir)
    m = mentions_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    path, posts = _scratch(spark, sf_dir, "n3plain"), []

    def read(dump, share):
        size = RDF.dump_labels(spark, dump).agg(F.sum("size")).first()[0] or 0
        small = {"spark.sql.files.maxPartitionBytes": str(_split_bytes(int(size / share)))}
        tweets = _with_conf(spark, small, lambda: RDF.rdf_to_tables(spark, dump))[0]
        posts.append(f"{path}/posts-{len(posts):04d}")
        tweets.write.parquet(posts[-1])

    rows = RDF.render_dump(c.tweets, c.entities, m).withColumn("year_month", F.substring("year_month", 1, 4))
    _with_conf(spark, FX_DROP_SHUFFLES, lambda: RDF.use_in_turns(rows, f"{path}/dump", read, files_per_month=1, compression="none"))
    return spark.read.parquet(*posts).withColumn("year_month", F.date_format("created_at", "yyyy-MM"))


def q_rdf_long_streams(spark, sf_dir):
    """Q05 on gzip files of a year each, inflated once and parsed by many tasks."""
    c = load_corpus(spark, sf_dir)
    m = mentions_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    path = _scratch(spark, sf_dir, "n3years")
    RDF.write_dump(RDF.render_dump(c.tweets, c.entities, m).withColumn("year_month", F.substring("year_month", 1, 4)), path,
                   files_per_month=1)
    parsed = RDF.parse_dump(spark, path, spread=True, inflated_lines=FX_INFLATED_LINES)
    return RDF.tables_from_parsed(parsed)[0].withColumn("year_month", F.date_format("created_at", "yyyy-MM"))


def q_incremental_entity_table(spark, sf_dir):
    root = _scratch(spark, sf_dir, "incremental-entity")
    for wave in _waves(spark, sf_dir, root):
        wave()
        require_whole(INC.run_incremental(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", "entity", ENTITY_TOP_N))
    return INC.assemble(spark, f"{root}/staging", "entity", load_corpus(spark, sf_dir).words)


def q_incremental_month_table(spark, sf_dir):
    """Built from posts alone, then all over again without resuming."""
    root = _scratch(spark, sf_dir, "incremental-month")
    for wave, resume in zip(_waves(spark, sf_dir, root), (True, False)):
        wave()
        require_whole(INC.run_incremental(spark, f"{root}/tweets", f"{root}/none", f"{root}/staging", "month", resume=resume))
    return INC.assemble(spark, f"{root}/staging", "month", None)


def q_streaming_late_entities(spark, sf_dir):
    """M7: all posts and part of the mentions arrive first, the other mentions later."""
    root = _scratch(spark, sf_dir, "stream-late")
    c = load_corpus(spark, sf_dir)
    c.tweets.select(*[f.name for f in INC.TWEETS_SOURCE.fields]).write.partitionBy("year_month").parquet(f"{root}/tweets")
    ent = c.entities.select(*[f.name for f in INC.ENTITIES_SOURCE.fields])
    first = F.pmod(F.col("tweet_id").cast("long"), F.lit(3)) == 0
    for part in (first, ~first):
        ent.filter(part).write.mode("append").partitionBy("year_month").parquet(f"{root}/entities")
        require_whole(INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", f"{root}/_ckpt", "date",
                                        DATE_TOP_N))
    return INC.assemble(spark, f"{root}/staging", "date", c.words)


def q_month_table_with_empty_months(spark, sf_dir):
    """A1 over a calendar: months without posts are 0/0/0."""
    months = spark.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(FX_CAL_START + "-01")), F.to_date(F.lit(FX_CAL_END + "-01")), F.expr("interval 1 month"))).alias("d"))
    months = months.select(F.date_format("d", "yyyy-MM").alias("year_month"))
    return TB.month_table(load_corpus(spark, sf_dir).tweets, months)


def q_redaction_phrases(spark, sf_dir):
    """K1 with entries of one, two and three words, symbols and other alphabets."""
    words = spark.createDataFrame([(w,) for w in FX_PHRASES], "word string")
    return dirty_names(load_corpus(spark, sf_dir).entities, words, "detected_as")


def q_written_date_table(spark, sf_dir):
    """The final table as written, sorted and typed, read back with its month."""
    root = _scratch(spark, sf_dir, "final")
    SRC.write_table(gold_date(spark, sf_dir), f"{root}/date", "date")
    return SRC.read_table_with_month(spark, f"{root}/date").withColumn("month", F.date_format("month", "yyyy-MM-dd"))


_MERGED: dict[str, str] = {}


def _merged_state(spark, sf_dir):
    """M2: a state of two merges: half the posts with a third of the mentions, then the rest of both.  Once a session."""
    key = gold_path(spark, sf_dir, "merged-state")
    if key not in _MERGED:
        root = f"{key}/{uuid.uuid4().hex}"
        c = load_corpus(spark, sf_dir)
        tw = c.tweets.select(*[f.name for f in INC.TWEETS_SOURCE.fields])
        ent = c.entities.select(*[f.name for f in INC.ENTITIES_SOURCE.fields])
        cut = F.col("created_at") <= F.to_timestamp(F.lit(FX_FIRST_WAVE_END + " 23:59:59"))
        first = F.pmod(F.col("tweet_id").cast("long"), F.lit(3)) == 0
        for posts, mentions in ((cut, first), (~cut, ~first)):
            for rows, source in ((tw.filter(posts), "tweets"), (ent.filter(mentions), "entities")):
                # a month's rows in files of Spark's advisory size, not one a task
                rows.hint("rebalance", "year_month").write.mode("append").partitionBy("year_month").parquet(f"{root}/{source}")
            require_whole(STATE.merge_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/state", DATE_TOP_N))
        _MERGED[key] = f"{root}/state"
    return _MERGED[key]


def q_merged_date_table(spark, sf_dir):
    rows = STATE.state_rows(spark, _merged_state(spark, sf_dir), "date", DATE_TOP_N)
    return TB.redacted_date_table(rows, load_corpus(spark, sf_dir).words)[0]


def q_merged_entity_table(spark, sf_dir):
    rows = STATE.state_rows(spark, _merged_state(spark, sf_dir), "entity", DATE_TOP_N, ENTITY_TOP_N)
    return TB.redacted_entity_table(rows, load_corpus(spark, sf_dir).words)[0]


def q_merged_month_table(spark, sf_dir):
    return STATE.state_rows(spark, _merged_state(spark, sf_dir), "month", DATE_TOP_N)


class _Interrupted(Exception):
    """The fault that the queries below put in."""


def _published(spark, sf_dir):
    """The date and entity tables published by swap, with a writer that dies between its data and the pointer."""
    root = _scratch(spark, sf_dir, "published")
    gold = _gold_date_and_entity(spark, sf_dir)

    def version(kind, table, red):
        side = redaction_table(red, PUB.read_published(spark, root, "redactions"))
        return {kind: lambda f: SRC.write_table(table, f, kind), "redactions": lambda f: side.write.parquet(f)}

    def dies(_folder):
        raise _Interrupted

    date, entity = gold["date"], gold["entity"]
    PUB.publish(spark, root, version("date", date[0].filter(F.col("year_month") < FX_LO), date[1]))
    PUB.publish(spark, root, version("date", *date))
    try:
        PUB.publish(spark, root, {**version("date", date[0].limit(0), date[1].limit(0)), "month": dies})
    except _Interrupted:
        pass
    PUB.publish(spark, root, version("entity", *entity))
    return root


def q_published_date_table(spark, sf_dir):
    table = PUB.read_published(spark, _published(spark, sf_dir), "date")
    return table.withColumns({c: F.col(c).cast("double") for c in ("positive_sentiment", "negative_sentiment")})


def q_published_redactions(spark, sf_dir):
    return PUB.read_published(spark, _published(spark, sf_dir), "redactions")


def _stream_with_a_bad_month(spark, sf_dir):
    """M5, M7: (root, status of the run that met an unreadable file); it is taken away and the stream run again."""
    root = _scratch(spark, sf_dir, "stream-bad")
    wave1, wave2 = _waves(spark, sf_dir, root)
    bad = f"{root}/tweets/year_month={FX_BAD_MONTH}/part-broken.parquet"

    def run():
        return INC.stream_months(spark, f"{root}/tweets", f"{root}/entities", f"{root}/staging", f"{root}/_ckpt", "date", DATE_TOP_N)

    wave1()
    put_bytes(spark, bad, b"not parquet")
    status = run()
    delete_file(spark, bad)
    wave2()
    require_whole(run())
    return root, status


def q_streaming_status(spark, sf_dir):
    return _stream_with_a_bad_month(spark, sf_dir)[1].select("year_month", "status")


def q_streaming_mended_month(spark, sf_dir):
    return INC.assemble(spark, f"{_stream_with_a_bad_month(spark, sf_dir)[0]}/staging", "date", load_corpus(spark, sf_dir).words)


def _converted(spark, sf_dir):
    """(folder, status of a second run) of the whole dump, converted."""
    out, dump = _scratch(spark, sf_dir, "converted"), dump_path(spark, sf_dir)
    RDF.convert_dump(spark, dump, out)
    return out, RDF.convert_dump(spark, dump, out)


def q_converted_posts(spark, sf_dir):
    return spark.read.parquet(f"{_converted(spark, sf_dir)[0]}/tweets")


def q_conversion_status(spark, sf_dir):
    return _converted(spark, sf_dir)[1].select("year_month", "status")


def q_swapped_posts_found(spark, sf_dir):
    """U4: posts of the parsed dump against their source, after every ``FX_HOLE_EVERY``-th of two months changed places."""
    a, b = FX_SWAPPED
    moved = (F.col("tweet_id").cast("long") % FX_HOLE_EVERY == 0) & F.col("year_month").isin(a, b)
    built = RDF.rdf_to_tables(spark, dump_path(spark, sf_dir))[0].withColumn(
        "year_month", F.when(moved, F.when(F.col("year_month") == a, b).otherwise(a)).otherwise(F.col("year_month")))
    return compare_by_id(load_corpus(spark, sf_dir).tweets, built)


def q_month_files_posts(spark, sf_dir):
    """Posts read from month folders, labelled by their path."""
    root = _scratch(spark, sf_dir, "month-files")
    c = load_corpus(spark, sf_dir)
    c.tweets.select(*[f.name for f in INC.TWEETS_SOURCE.fields]).write.partitionBy("year_month").parquet(f"{root}/tweets")
    return TB.month_table(SRC.read_kind(spark, [f"{root}/tweets"], "tweets"))


def q_extract_prompts_in_zones(spark, sf_dir):
    """Q31 on logs with offsets, read under a session zone that is not UTC."""
    conv = read_table(spark, sf_dir, "conversations")
    at = F.expr(f"TIMESTAMP_NTZ '{FX_LOG_START}' + make_interval(0, 0, 0, 0, 0, CAST(turn AS INT), 0)")
    offsets = F.array(*[F.lit(o) for o in FX_LOG_OFFSETS])
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.get(offsets, F.pmod("conv_id", F.lit(len(FX_LOG_OFFSETS)))))
    return _with_conf(spark, {"spark.sql.session.timeZone": FX_LOG_ZONE},
                      lambda: extract_prompts(conversations_as_logs(conv, stamp)))


QUERIES.update({
    "rdf_hole_month": q_rdf_hole_month,
    "rdf_plain_split": q_rdf_plain_split,
    "rdf_long_streams": q_rdf_long_streams,
    "incremental_entity_table": q_incremental_entity_table,
    "incremental_month_table": q_incremental_month_table,
    "streaming_late_entities": q_streaming_late_entities,
    "month_table_with_empty_months": q_month_table_with_empty_months,
    "redaction_phrases": q_redaction_phrases,
    "merged_date_table": q_merged_date_table,
    "merged_entity_table": q_merged_entity_table,
    "merged_month_table": q_merged_month_table,
    "written_date_table": q_written_date_table,
    "published_date_table": q_published_date_table,
    "published_redactions": q_published_redactions,
    "streaming_status": q_streaming_status,
    "converted_posts": q_converted_posts,
    "conversion_status": q_conversion_status,
    "swapped_posts_found": q_swapped_posts_found,
    "streaming_mended_month": q_streaming_mended_month,
    "month_files_posts": q_month_files_posts,
    "extract_prompts_in_zones": q_extract_prompts_in_zones,
})
