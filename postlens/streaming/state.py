"""Mergeable month state (M2, A2-A5, W1): a late file is added to what is known of its month.

``run_incremental`` reads a touched month's files all over again.  Here a merge
reads the new files and the state, nothing else; one state gives the date,
entity and month tables.  What it holds, by month:

* ``posts``   sums of the post rows by (post, sentiments);
* ``pairs``   distinct (post, name); a null name stands for a mention without one;
* ``counts``  posts by name, from which the top names follow (W1);
* ``sums``    the date table's aggregates of *every* name, top or not;
* ``rest``    the sums of posts under ``Other`` and ``None``, and of all posts;
* ``files``   the files that were merged.

All of them are added up on reading, so a merge writes differences only.  New
names of a post add to ``counts`` and ``sums``.  ``rest`` also moves when the
top names do: the posts that hold a name which entered or left the top are
looked up, taken back from the bucket they were in and put where they are now.
No row holds more than one (post, name), so an id with very many mentions
costs no task more memory than any other.

A merge is one publication (``postlens.sources.publish``): differences and the
list of files they came from become current together, so a crash or a second
writer merges nothing twice.  A file that was replaced or vanished cannot be
subtracted: its month starts anew from its files (``epochs`` voids the old
rows).  After ``most_deltas`` merges the differences are added up and written
as one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions.columns import signal_mean
from postlens.model import ENTITIES_SCHEMA, NONE, OTHER, TWEETS_SCHEMA
from postlens.operators.ranking import top_n_per_group
from postlens.operators.tables import KEY, MOST_BROADCAST_NAMES, MOST_MONTHS, quantized_posts
from postlens.session import cut_lineage
from postlens.sources.manifest import FILE, SCHEMA as FILE_SCHEMA, changed_months, run_isolated
from postlens.sources.publish import PublishConflict, current, publish
from postlens.sources.tables import month_label
from postlens.streaming.incremental import LISTING, _months_with_posts, _status, source_files

SENTIMENTS = ["positive_sentiment", "negative_sentiment"]
ALL = "All"
_MEASURES = "positive_sentiment double, negative_sentiment double, likes long, shares long, n long, v int"
SCHEMAS = {
    "posts": f"year_month string, tweet_id string, {_MEASURES}",
    "pairs": "year_month string, tweet_id string, name string, v int",
    "counts": "year_month string, name string, n_posts long, v int",
    "sums": f"year_month string, name string, {_MEASURES}",
    "rest": f"year_month string, label string, {_MEASURES}",
    "files": f"{FILE_SCHEMA}, v int",
}
_SUMS = "positive_sentiment:double,negative_sentiment:double,likes:bigint,shares:bigint,n:bigint"
_HELD = f"struct<new:boolean,{_SUMS}>"                         # a post's sums by sentiments
_MOVE = f"struct<name:string,label:string,{_SUMS}>"
MOST_DELTAS = 16


def _total(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("likes", "shares", "n")])


@dataclass(frozen=True)
class MonthState:
    """The state as one publication shows it; ``first`` voids a month's rows of merges before that one."""

    spark: SparkSession
    place: str
    number: int
    tables: dict
    first: dict
    top_n: int

    @classmethod
    def open(cls, spark: SparkSession, place: str, top_n: int) -> MonthState:
        place = place.rstrip("/")
        number, tables = current(spark, place)
        rests = {name.split(".")[0] for name in tables if name.startswith("rest")}
        if rests - {f"rest{top_n}"}:
            raise ValueError(f"{place} was built for another top_n than {top_n}: {sorted(rests)}")
        first = {}
        if "epochs" in tables:
            first = {r.year_month: r.v for r in spark.read.parquet(f"{place}/{tables['epochs']}").collect()}   # a row a month
        return cls(spark, place, number, tables, first, top_n)

    @property
    def deltas(self) -> list[int]:
        return sorted(int(name.split(".")[1]) for name in self.tables if name.startswith("files."))

    def name(self, table: str, v: int) -> str:
        return f"{table}{self.top_n if table == 'rest' else ''}.{v:010d}"

    def restarted(self, months: list[str], v: int) -> MonthState:
        return MonthState(self.spark, self.place, self.number, self.tables, {**self.first, **dict.fromkeys(months, v)}, self.top_n)

    def read(self, table: str, months: list[str] | None = None) -> DataFrame:
        """Rows to be added up; those of ``months`` only, by the files' own statistics."""
        folders = [f"{self.place}/{self.tables[self.name(table, v)]}" for v in self.deltas]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table]).limit(0)      # known to be empty: joins with it are left out
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(*folders)
        if months is not None:
            rows = rows.filter(F.col("year_month").isin(months))
        voided = {m: v for m, v in self.first.items() if months is None or m in months}
        if voided:
            since = F.create_map(*[F.lit(x) for pair in sorted(voided.items()) for x in pair])
            rows = rows.filter(F.col("v") >= F.coalesce(since[F.col("year_month")], F.lit(0)))
        return rows

    def top(self, counts: DataFrame, top_n: int | None = None) -> DataFrame:
        """W1 on name counts that may come in several rows a name."""
        whole = counts.groupBy("year_month", "name").agg(F.sum("n_posts").alias("n_posts"))
        return top_n_per_group(whole, ["year_month"], [F.col("n_posts").desc(), F.col("name").asc()],
                               top_n or self.top_n).select("year_month", "name")


def _small(rows: DataFrame, top_n: int) -> DataFrame:
    return F.broadcast(rows) if 2 * top_n * MOST_MONTHS <= MOST_BROADCAST_NAMES else rows


def _read_files(spark: SparkSession, files: list[str], schema) -> DataFrame:
    """Exactly these files: one that lands meanwhile belongs to the next merge."""
    if not files:
        return spark.createDataFrame([], schema).withColumn("year_month", F.lit(None).cast("string"))
    plain = [re.sub(r"([\\*?{}\[\]])", r"\\\1", f) for f in files]
    return (spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(*plain)
            .withColumn("year_month", month_label()))


def _touched(posts: DataFrame, pairs: DataFrame, d_posts: DataFrame, d_pairs: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state's rows of the posts that a merge may change, if these are few enough to broadcast; else all its rows.

    A post is touched by new rows and new names, and by a name of its own that entered or left the top.
    """
    if d_posts.count() + d_pairs.count() > MOST_BROADCAST_NAMES:
        return posts, pairs
    moved = pairs.join(tops.filter("was != now"), ["year_month", "name"], "left_semi")
    touched = cut_lineage(d_posts.select(*KEY).unionByName(d_pairs.select(*KEY)).unionByName(moved.select(*KEY)), "touched-posts")
    if touched.count() > MOST_BROADCAST_NAMES:
        return posts, pairs
    return tuple(rows.join(F.broadcast(touched), KEY, "left_semi") for rows in (posts, pairs))


def _moves(posts: DataFrame, pairs: DataFrame, d_posts: DataFrame, d_pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """What a merge adds to ``sums`` (rows with a ``name``) and to ``rest`` (rows with a ``label``).

    Posts and their names meet in one shuffle: every row of a post sees the
    post's sums by sentiments (``held``, some few) and whether names of it
    were, and are now, at the top.
    """
    measures = [*SENTIMENTS, "likes", "shares", "n"]
    mentions = (pairs.withColumn("new", F.lit(False)).unionByName(d_pairs.withColumn("new", F.lit(True)))
                .join(tops, ["year_month", "name"], "left")
                .select(*KEY, "name", "new", "was", "now", F.lit(None).cast(_HELD).alias("post")))
    own = (posts.withColumn("new", F.lit(False)).unionByName(d_posts.filter("tweet_id IS NOT NULL").withColumn("new", F.lit(True)))
           .select(*KEY, F.lit(None).cast("string").alias("name"), "new", F.lit(None).cast("boolean").alias("was"),
                   F.lit(None).cast("boolean").alias("now"), F.struct("new", *measures).alias("post")))
    post, mention = Window.partitionBy(*KEY), F.col("post").isNull()

    def seen(c: Column) -> Column:
        return F.coalesce(F.max(c).over(post), F.lit(False))

    def bucket(mentioned: Column, named: Column) -> Column:
        return F.when(~mentioned, NONE).when(~named, OTHER)

    rows = mentions.unionByName(own).select(
        "year_month", "name", "new", "post", F.collect_list("post").over(post).alias("held"),
        bucket(seen(mention & ~F.col("new")), seen(~F.col("new") & F.col("was"))).alias("before"),
        bucket(seen(mention), seen(F.col("now"))).alias("after"))
    none = F.lit(None).cast("string")
    # A new name takes all rows of its post, a known one the new rows; a new row goes under its label, a known one may change it.
    to_sums = F.transform(F.filter("held", lambda h: F.col("new") | h["new"]),
                          lambda h: F.struct(F.col("name").alias("name"), none.alias("label"), *[h[c].alias(c) for c in measures]))

    def under(label: str, sign: int) -> Column:
        return F.struct(none.alias("name"), F.col(label).alias("label"), *[F.col(f"post.{c}").alias(c) for c in SENTIMENTS],
                        *[(F.lit(sign) * F.col(f"post.{c}")).alias(c) for c in ("likes", "shares", "n")])

    nothing = F.array().cast(f"array<{_MOVE}>")
    to_rest = (F.when(F.col("new"), F.array(under("after", 1)))
               .when(~F.col("before").eqNullSafe(F.col("after")), F.array(under("before", -1), under("after", 1)))
               .otherwise(nothing))
    found = rows.select("year_month", F.explode(F.when(~mention, to_rest).when(F.col("name").isNotNull(), to_sums)
                                                .otherwise(nothing)).alias("x")).select("year_month", "x.*")
    whole = d_posts.select("year_month", none.alias("name"), F.lit(ALL).alias("label"),
                           *[F.lit(0.0).alias(c) for c in SENTIMENTS], "likes", "shares", "n")
    unkeyed = d_posts.filter("tweet_id IS NULL").select("year_month", none.alias("name"), F.lit(NONE).alias("label"), *measures)
    return _total(found.filter("name IS NOT NULL OR label IS NOT NULL").unionByName(unkeyed).unionByName(whole),
                  "year_month", "name", "label", *SENTIMENTS)


def _merge(state: MonthState, new: DataFrame, months: list[str], v: int) -> dict[str, DataFrame]:
    """The differences that the new files make to each table of the state."""
    spark = state.spark
    paths = {s: [r.file for r in new.filter(F.col("source") == s).select("file").collect()] for s in ("tweets", "entities")}
    d_posts = cut_lineage(_total(quantized_posts(_read_files(spark, paths["tweets"], TWEETS_SCHEMA))
                                 .withColumn("n", F.lit(1)), *KEY, *SENTIMENTS), "new-posts")
    mentioned = (_read_files(spark, paths["entities"], ENTITIES_SCHEMA)
                 .filter(F.col("year_month").isNotNull() & F.col("tweet_id").isNotNull())
                 .select(*KEY, F.col("detected_as").alias("name")).distinct())
    mentioned = cut_lineage(mentioned, "new-mentions")        # its size is known from here on: small ones are broadcast
    posts, pairs = state.read("posts", months).drop("v"), state.read("pairs", months).drop("v")

    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY] + [F.col("a.name").eqNullSafe(F.col("b.name"))]
    d_pairs = mentioned
    if state.deltas:
        met = pairs.alias("a").join(mentioned.alias("b"), same, "left_semi")
        d_pairs = cut_lineage(mentioned.alias("a").join(met.alias("b"), same, "left_anti"), "new-pairs")

    counts = state.read("counts", months).drop("v")
    d_counts = cut_lineage(d_pairs.filter("name IS NOT NULL").groupBy("year_month", "name")
                           .agg(F.count(F.lit(1)).alias("n_posts")), "new-counts")
    tops = (state.top(counts).withColumn("was", F.lit(True))
            .join(state.top(counts.unionByName(d_counts)).withColumn("now", F.lit(True)), ["year_month", "name"], "full_outer")
            .filter(F.col("name") != OTHER).na.fill(False, ["was", "now"]))
    tops = _small(cut_lineage(tops, "tops"), state.top_n)

    if state.deltas:
        posts, pairs = _touched(posts, pairs, d_posts, d_pairs, tops)
    moves = cut_lineage(_moves(posts, pairs, d_posts, d_pairs, tops), "moves")
    return {"posts": d_posts.filter("tweet_id IS NOT NULL"), "pairs": d_pairs, "counts": d_counts,
            "sums": moves.filter("name IS NOT NULL").drop("label"),
            "rest": moves.filter("label IS NOT NULL AND (n != 0 OR likes != 0 OR shares != 0)").drop("name"),
            "files": new.select(*FILE)}


def _writers(state: MonthState, rows: dict[str, DataFrame], v: int) -> dict:
    """Rows in the order of the months, so that a reader of some skips the others by the files' statistics."""
    def writer(table: str):
        cols = [c.strip().split(" ")[0] for c in SCHEMAS[table].split(",")]
        out = rows[table].withColumn("v", F.lit(v)).select(*cols).sortWithinPartitions("year_month")
        return lambda folder: out.write.parquet(folder)

    return {state.name(table, v): writer(table) for table in SCHEMAS}


def compact(spark: SparkSession, place: str, top_n: int) -> int:
    """Add the differences up and publish the state as one; voided rows go.  Returns the entry's number."""
    state = MonthState.open(spark, place, top_n)
    v = max(state.deltas, default=0) + 1
    rows = {
        "posts": _total(state.read("posts"), *KEY, *SENTIMENTS), "pairs": state.read("pairs"),
        "counts": state.read("counts").groupBy("year_month", "name").agg(F.sum("n_posts").alias("n_posts")),
        "sums": _total(state.read("sums"), "year_month", "name", *SENTIMENTS),
        "rest": _total(state.read("rest"), "year_month", "label", *SENTIMENTS).filter("n != 0 OR likes != 0 OR shares != 0"),
        "files": state.read("files"),
    }
    return publish(spark, place, _writers(state, rows, v), drop=list(state.tables), since=state.number)


def merge_months(spark: SparkSession, tweets_path: str, entities_path: str, place: str, top_n: int = 100,
                 most_deltas: int = MOST_DELTAS) -> DataFrame:
    """Merge the files that the state at ``place`` does not hold; (year_month, status, error) for every month with posts.

    A month that cannot be read fails alone, is reported (without posts, too)
    and keeps what the state had of it.  ``top_n`` is the date table's; a state
    is built for one.
    """
    place = place.rstrip("/")
    files = cut_lineage(source_files(spark, tweets_path, entities_path, "date"), "source-files")
    known = MonthState.open(spark, place, top_n).read("files").select(*FILE)
    pending = changed_months(files, known)
    gone = {r.year_month for r in known.join(files, FILE, "left_anti").select("year_month").distinct().collect()}
    lost = []                                                  # to another writer: not the months' fault

    def build(some: list[str]) -> None:
        if lost:
            raise lost[0]
        state = MonthState.open(spark, place, top_n)
        v = max(state.deltas, default=0) + 1
        restart = sorted(gone.intersection(some))
        state = state.restarted(restart, v)
        new = files.filter(F.col("year_month").isin(some)).join(state.read("files", some).select(*FILE), FILE, "left_anti")
        write = _writers(state, _merge(state, cut_lineage(new, "new-files"), some, v), v)
        if restart:
            epochs = spark.createDataFrame(sorted(state.first.items()), "year_month string, v int").coalesce(1)
            write["epochs"] = lambda folder: epochs.write.parquet(folder)
        try:
            publish(spark, place, write, since=state.number)
        except PublishConflict as e:
            lost.append(e)
            raise

    failed = run_isolated(pending, build)
    if lost:
        raise lost[0]
    if len(MonthState.open(spark, place, top_n).deltas) > most_deltas:
        compact(spark, place, top_n)
    return _status(spark, sorted({*_months_with_posts(files), *failed}), set(pending), failed)


def stream_merge(spark: SparkSession, tweets_path: str, entities_path: str, place: str, checkpoint: str, top_n: int = 100) -> DataFrame:
    """M7 on the state: micro-batches of new file names of either source, each merged once (a replay finds nothing new).

    Returns the status as ``merge_months`` does, of a last look at what the state does not hold.
    """
    def batch(names: DataFrame, _epoch: int) -> None:
        if not names.isEmpty():
            merge_months(spark, tweets_path, entities_path, place, top_n)

    for name, path in (("posts", tweets_path), ("entities", entities_path)):
        try:
            stream = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", "true").load(path)
        except AnalysisException:
            continue                                           # not there yet: a later run sees it
        (stream.select("path").writeStream.foreachBatch(batch)
         .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").trigger(availableNow=True).start().awaitTermination())
    return merge_months(spark, tweets_path, entities_path, place, top_n)


def state_rows(spark: SparkSession, place: str, kind: str, top_n: int, entity_top_n: int = 10_000) -> DataFrame:
    """Pre-redaction rows of a table, as ``build_rows`` has them from the files.  ``top_n`` is the state's."""
    state = MonthState.open(spark, place, top_n)
    if kind == "month":
        months = state.read("files").filter("source = 'tweets'").select("year_month").distinct()
        total = _total(state.read("rest").filter(F.col("label") == ALL), "year_month")
        return months.join(total, "year_month", "left").na.fill(0).select(
            "year_month", F.col("likes").alias("total_likes"), F.col("shares").alias("total_shares"), F.col("n").alias("post_count"))
    if kind == "date":
        top = _small(state.top(state.read("counts")).filter(F.col("name") != OTHER), top_n)
        named = state.read("sums").join(top, ["year_month", "name"], "left_semi").withColumnRenamed("name", "entity")
        rest = state.read("rest").filter(F.col("label") != ALL).withColumnRenamed("label", "entity")
        return (_total(named.unionByName(rest), "year_month", *SENTIMENTS, "entity").filter("n > 0")
                .withColumnsRenamed({"likes": "total_likes", "shares": "total_shares", "n": "post_count"}))
    if kind == "entity":
        top = state.top(state.read("counts"), entity_top_n)
        by_name = state.read("sums").groupBy("year_month", "name").agg(
            *[F.sum(c).alias(c) for c in ("likes", "shares", "n")],
            *[F.sum(F.col(c) * F.col("n")).alias(f"{c}_sum") for c in SENTIMENTS],
            *[F.sum(F.when(F.col(c) > 0, F.col("n")).otherwise(0)).alias(f"{c}_nz") for c in SENTIMENTS])
        return by_name.join(top, ["year_month", "name"], "left_semi").select(
            F.col("name").alias("entity"), "year_month",
            *[signal_mean(f"{c}_sum", f"{c}_nz").alias(c) for c in SENTIMENTS],
            F.col("likes").alias("total_likes"), F.col("shares").alias("total_shares"), F.col("n").alias("post_count"))
    raise ValueError(f"unknown table kind {kind!r}")
