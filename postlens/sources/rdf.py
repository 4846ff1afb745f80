"""RDF (N3) dump -> posts / mentions / user-mention tables (Q05: S1 S2 W2 S3).

The dump is order dependent: attribute lines belong to the latest post
header, mention lines to the latest post *or* mentions-link blank node.
Plan:

1. ``spark.read.text``: plain files are cut into splits like any text.  A
   gzip file is one stream that one task has to inflate; where a file holds
   more than a core's fair share, its lines are only inflated and numbered by
   that task and written as a table of many files, which as many tasks as
   there are read and parse from there on (``inflate``);
2. the eight patterns are matched JVM-side, each at most once a line;
3. ``mapInArrow`` carries the two keys forward inside each run of consecutive
   lines that a task reads (state crosses Arrow batches): no shuffle of the
   raw lines, and of a post still open at the end of a batch only the header
   and the last value of each attribute are held;
4. "last value wins" is resolved in the same Arrow step;
5. where files are read in several runs, a run also reports the state it ends
   with and what it met before its first header.  One row a run, filled
   forward along each file, gives every run the state it begins with, and
   rows and attribute values that precede a run's first header are joined to
   it;
6. lines carry a number for their file; month labels are worked out once a
   file and joined to the records.

Posts cut by a chunk boundary keep their attributes.  A file that cannot be
read to its end fails its month, which is reported and left as it was; no
half-read month is ever written.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.session import cut_lineage, delete_folder, passing_stages, stage_path
from postlens.sources.manifest import changed_months, list_files, read_manifest, run_isolated, write_manifest

# The Arrow step runs in Python workers; ship this module's functions by
# value so workers need not import the package (no --py-files required).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The line patterns of the dump format, in match order.
RE_HEADER = (r'^_:t(\d+)\s+rdf:type sioc:Post\s*;\s*'
             r'dc:created "([^"]+)"\^\^xsd:dateTime\s*;\s*'
             r'sioc:id "(\d+)"\s*;\s*'
             r'sioc:has_creator _:u([0-9a-f]+)\s*;')
RE_LIKE = (r'schema:interactionType schema:LikeAction\s*;\s*'
           r'schema:userInteractionCount "(\d+)"\^\^xsd:integer')
RE_SHARE = (r'schema:interactionType schema:ShareAction\s*;\s*'
            r'schema:userInteractionCount "(\d+)"\^\^xsd:integer')
RE_POS = (r'onyx:hasEmotionCategory wna:positive-emotion\s*;\s*'
          r'onyx:hasEmotionIntensity "([^"]+)"\^\^xsd:double')
RE_NEG = (r'onyx:hasEmotionCategory wna:negative-emotion\s*;\s*'
          r'onyx:hasEmotionIntensity "([^"]+)"\^\^xsd:double')
RE_LINK = r'^_:t(\d+)\s+schema:mentions\s+_:([emh]\d+)'
RE_ENTITY = (r'rdf:type nee:Entity\s*;\s*'
             r'nee:detectedAs "([^"]+)"\s*;\s*'
             r'nee:hasMatchedURI <([^>]+)>\s*;\s*'
             r'nee:confidence "([^"]+)"\^\^xsd:double')
RE_MENTION = r'rdf:type sioc:UserAccount\s*;\s*sioc:name "([^"]+)"'
MOST_BROADCAST_SPLITS = 500_000
INFLATED_LINES = 250_000            # lines in a file of an inflated dump

KINDS = ["header", "like", "share", "pos", "neg", "link", "entity", "mention"]
_PATTERNS = [RE_HEADER, RE_LIKE, RE_SHARE, RE_POS, RE_NEG, RE_LINK, RE_ENTITY, RE_MENTION]
# A literal piece of each pattern: a cheap substring test guards the regex,
# so most lines run one regex instead of up to eight (same result: every
# match contains its marker).
_MARKERS = ["rdf:type sioc:Post", "schema:LikeAction", "schema:ShareAction", "wna:positive-emotion",
            "wna:negative-emotion", "schema:mentions", "rdf:type nee:Entity", "rdf:type sioc:UserAccount"]

# What a pattern needs besides its marker, tested once for the rules that share it:
# most lines are searched for a few short strings and not for all the markers.
_SHARED = {"t": (0, 5), "i": (1, 2), "c": (3, 4), "r": (6, 7)}

_RECORD_SCHEMA = ("fid long, block long, first long, line long, kind string, id string, a string, "
                  "b string, c string, like string, share string, pos string, neg string")


WS_CHARS = " \t\n\r\f\x0b"
SEP = "\u0001"


def _classify(lines: DataFrame) -> DataFrame:
    """S1 + S2: leading blanks skipped, blank and @prefix lines dropped, first matching rule wins.

    Each rule is guarded by its literal marker.  What a rule catches is a
    column of its own in a projection below the one that tests it, so that a
    pattern runs once on a line that holds its marker.  ``code`` is
    ``"<rule index>|<captures>"``, the captures of header and entity lines
    joined by a separator and split in the Arrow step.  Lines matching no
    rule keep a null code and are dropped in the carry-forward step, which
    needs the line numbers to be without gaps.
    """
    v = F.col("v")
    anchored = [r.replace("^", f"^[{WS_CHARS}]*", 1) if r.startswith("^") else r for r in _PATTERNS]      # no other rule minds blanks
    several = {0: ("(?s)" + anchored[0] + ".*$", f"$3{SEP}$2{SEP}$4"), 6: ("(?s)^.*?" + RE_ENTITY + ".*$", f"$1{SEP}$2{SEP}$3")}

    def caught(i: int):
        got = F.regexp_replace(v, *map(F.lit, several[i])) if i in several else F.regexp_extract(v, anchored[i], 1)
        shared = next(name for name, rules in _SHARED.items() if i in rules)
        return F.when(F.col(f"has_{shared}") & v.contains(_MARKERS[i]), got).alias(f"c{i}")

    def matched(i: int):                     # replacing leaves a line as it is where the pattern does not match
        return F.col(f"c{i}") != (v if i in several else F.lit(""))

    rules = range(len(_PATTERNS))
    lines = lines.withColumnRenamed("value", "v").select(
        "fid", "block", "line", "v", (v.startswith("_:t") | (v < F.lit("!"))).alias("has_t"),       # or begins with a blank
        v.contains("schema:interactionType").alias("has_i"), v.contains("onyx:hasEmotionCategory").alias("has_c"),
        v.contains("rdf:type ").alias("has_r"))
    found = lines.select("fid", "block", "line", "v", *[caught(i) for i in rules])
    prefix = v.contains("@prefix") & F.btrim(v, F.lit(WS_CHARS)).startswith("@prefix")
    code = F.coalesce(*[F.when(matched(i), F.concat(F.lit(f"{i}|"), F.col(f"c{i}"))) for i in rules])
    return found.select("fid", "block", "line", F.when(~prefix, code).alias("code"))


_ATTRS = ("like", "share", "pos", "neg")


def _last_of_each(rows):
    """A post's header and its last row of each attribute: at most five rows, however many there were."""
    import numpy as np
    import pyarrow.compute as pc

    keep = []
    for k in ("header", *_ATTRS):
        at = np.flatnonzero(pc.equal(rows.column("kind"), k).combine_chunks().to_numpy(zero_copy_only=False))
        keep += at[-1:].tolist()
    return rows.take(sorted(keep))


def _carry_forward(cut_files: bool):
    """W2 + "last value wins", inside one scan partition, on Arrow batches.

    Keys are forward-filled per run of consecutive lines of one split of one
    file, named by its ``first`` line; the previous batch's last state seeds
    the first run when it continues the same one.  Output rows: ``post`` (one
    per header, ``line`` its key) and ``entity``/``mention``.  With
    ``cut_files`` also ``state`` (what a run ends with) and ``patch`` (the
    last attribute values before its first header), and mention rows that
    precede any id keep a null one.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds, header, entity = pa.array(KINDS), KINDS.index("header"), KINDS.index("entity")
        link, attrs = KINDS.index("link"), [KINDS.index(k) for k in _ATTRS]
        names = ["fid", "block", "first", "line", "kind", "id", "a", "b", "c", *_ATTRS]
        types = [pa.int64()] * 4 + [pa.string()] * 9
        read = None                           # (fid, block, first, line) of the last line read
        carry = None                          # (fid, block, first, post_line, cur_id) after the last line with a code
        opened = None                         # ((fid, block, first, line) of the post still open, its header and last values)
        patch: dict[str, str] = {}            # of the current split

        def table(**cols):
            n = len(cols["fid"])
            return pa.table([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, types)],
                            schema=pa.schema(list(zip(names, types))))

        def split(texts):
            """The three captures of header and entity lines."""
            parts = pc.split_pattern(texts, SEP, max_splits=2)
            return [pc.list_element(parts, i) for i in range(3)] if len(texts) else [texts] * 3

        def picked(texts, at):
            """``texts`` at these places; null where the place is below 0."""
            return texts.take(pa.array(at, pa.int64(), mask=at < 0))

        def close_post():
            (fid, block, first, line), rows = opened
            got = dict(zip(rows.column("kind").to_pylist(), rows.column("a").to_pylist()))
            a, b, c = got["header"].split(SEP, 2)
            return table(fid=[fid], block=[block], first=[first], line=[line], kind=["post"], id=[a], a=[b], b=[c],
                         **{k: pa.array([got.get(k)], pa.string()) for k in _ATTRS})

        def end_of_split():
            fid, block, first, post_line, cur_id = carry
            out = [table(fid=[fid], block=[block], first=[first], line=pa.array([post_line], pa.int64()),
                         kind=["state"], id=pa.array([cur_id], pa.string()))]
            if patch:
                out.append(table(fid=[fid], block=[block], first=[first], kind=["patch"],
                                 **{k: pa.array([patch.get(k)], pa.string()) for k in _ATTRS}))
            patch.clear()
            return out

        for rb in batches:
            if rb.num_rows == 0:
                continue
            fid, block, line = (rb.column(rb.schema.get_field_index(c)).to_numpy() for c in ("fid", "block", "line"))
            new = np.append(True, (fid[1:] != fid[:-1]) | (block[1:] != block[:-1]) | (line[1:] != line[:-1] + 1))
            begins = line[new]
            if read is not None and read[:2] == (fid[0], block[0]) and read[3] + 1 == line[0]:
                begins[0] = read[2]
            first = begins[np.cumsum(new) - 1]
            read = (fid[-1], block[-1], first[-1], line[-1])
            code = rb.column(rb.schema.get_field_index("code"))
            known = pc.is_valid(code).to_numpy(zero_copy_only=False)
            if not known.any():
                continue
            fid, block, line, first, code = fid[known], block[known], line[known], first[known], code.drop_null()
            n, out = len(line), []
            kind = pc.cast(pc.utf8_slice_codeunits(code, 0, 1), pa.int8()).to_numpy()
            rest = pc.utf8_slice_codeunits(code, 2)
            at = np.arange(n)
            begin = np.append(True, first[1:] != first[:-1])               # of a run among these rows
            starts = np.flatnonzero(begin)
            run_start = starts[np.cumsum(begin) - 1]
            same = carry is not None and carry[2] == first[0]
            held = same & (run_start == 0)                                 # rows that the carried state reaches
            is_hdr = kind == header
            # the row of a line's post and of its id, -1 where it is not among these rows
            post, cur = (np.maximum.accumulate(np.where(x, at, -1)) for x in (is_hdr, is_hdr | (kind == link)))
            post, cur = (np.where(x >= run_start, x, -1) for x in (post, cur))
            hdr = np.flatnonzero(is_hdr)
            h_a, h_b, h_c = split(rest.take(pa.array(hdr)))
            place = at.copy()
            place[hdr] = n + np.arange(len(hdr))
            ids = pa.concat_arrays([rest, h_a, pa.array([carry[4] if same else None], pa.string())])
            id_at = np.where(cur >= 0, place[cur], np.where(held, n + len(hdr), -1))

            # mention lines with a current id (or one to be joined)
            is_ref = kind > link
            if not cut_files and not (same and carry[4] is not None):
                is_ref &= cur >= 0
            elif not cut_files:
                is_ref &= id_at >= 0
            for k in (entity, KINDS.index("mention")):
                ref = np.flatnonzero(is_ref & (kind == k))
                if len(ref):
                    texts = rest.take(pa.array(ref))
                    caught = dict(zip("abc", split(texts))) if k == entity else {"a": texts}
                    out.append(table(fid=fid[ref], block=block[ref], first=first[ref], line=line[ref],
                                     kind=pa.array([KINDS[k]]).take(pa.array(np.zeros(len(ref), np.int8))),
                                     id=picked(ids, id_at[ref]), **caught))

            # header and attribute lines with a post
            in_open = held & (post < 0) & (same and carry[3] is not None)
            if len(hdr):
                ordinal = np.cumsum(is_hdr) - 1
                done, last = hdr[:-1], {}
                for k, i in zip(_ATTRS, attrs):
                    rows = np.flatnonzero((kind == i) & (post >= 0))
                    last[k] = np.full(len(hdr), -1)
                    last[k][ordinal[rows]] = rows                          # of several the last stays
            mine = np.flatnonzero(in_open & (kind <= attrs[-1]))
            if opened is not None and len(mine):
                more = pa.table({"kind": kinds.take(pa.array(kind[mine])), "a": rest.take(pa.array(mine))})
                opened = (opened[0], _last_of_each(pa.concat_tables([opened[1], more]).combine_chunks()))
            if len(hdr):
                if opened is not None:
                    out.append(close_post())
                if len(done):
                    out.append(table(fid=fid[done], block=block[done], first=first[done], line=line[done],
                                     kind=pa.array(["post"]).take(pa.array(np.zeros(len(done), np.int8))),
                                     id=h_a[:-1], a=h_b[:-1], b=h_c[:-1],
                                     **{k: picked(rest, last[k][:-1]) for k in _ATTRS}))
                z = hdr[-1]
                mine = np.array([z, *[last[k][-1] for k in _ATTRS if last[k][-1] >= 0]])
                opened = ((int(fid[z]), int(block[z]), int(first[z]), int(line[z])),
                          pa.table({"kind": kinds.take(pa.array(kind[mine])), "a": rest.take(pa.array(mine))}))

            ends = np.append(starts[1:], n)
            for s0, e0 in zip(starts, ends) if cut_files else [(starts[-1], n)]:
                goes_on = bool(held[s0])
                if carry is not None and not goes_on and cut_files:
                    out += end_of_split()
                if cut_files and post[s0] < 0 and not (goes_on and carry[3] is not None):   # attributes before the split's first header
                    early = s0 + np.flatnonzero(post[s0:e0] < 0)
                    for k, i in zip(_ATTRS, attrs):
                        rows = early[kind[early] == i]
                        if len(rows):
                            patch[k] = rest[int(rows[-1])].as_py()
                z, was = e0 - 1, (carry[3:] if goes_on else (None, None))
                carry = (int(fid[s0]), int(block[s0]), int(first[s0]), int(line[post[z]]) if post[z] >= 0 else was[0],
                         ids[int(place[cur[z]])].as_py() if cur[z] >= 0 else was[1])
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        out = [close_post()] if opened is not None else []
        if carry is not None and cut_files:
            out += end_of_split()
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def _with_entry_state(p: DataFrame) -> DataFrame:
    """Give rows that precede a run's first header (or id) the state that the run before ended with."""
    along = Window.partitionBy("fid").orderBy("block", "first").rowsBetween(Window.unboundedPreceding, -1)
    entry = p.filter("kind = 'state'").select(
        "fid", "block", "first", F.last("line", True).over(along).alias("e_line"), F.last("id", True).over(along).alias("e_id"))
    entry = cut_lineage(entry, "rdf-runs")               # one row a run
    hint = F.broadcast if entry.count() <= MOST_BROADCAST_SPLITS else (lambda d: d)
    late = (p.filter("kind = 'patch'").join(hint(entry.drop("fid", "block")), "first").filter("e_line IS NOT NULL")
            .groupBy(F.col("e_line").alias("line"))
            .agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.struct("block", "first"))).alias(f"late_{k}") for k in _ATTRS]))
    keep = [c for c in p.columns if c not in _ATTRS]
    posts = (p.filter("kind = 'post'").join(hint(late), "line", "left")
             .select(*keep, *[F.coalesce(f"late_{k}", k).alias(k) for k in _ATTRS]))
    refs = (p.filter("kind IN ('entity', 'mention')").join(hint(entry.select("first", "e_id")), "first", "left")
            .withColumn("id", F.coalesce("id", "e_id")).filter("id IS NOT NULL").select(*p.columns))
    return posts.select(*p.columns).unionByName(refs)


def _month_of(f):
    """``month_<label>`` of the file's own name, else its ``year_month=`` folder, else the name's stem."""
    stem = F.regexp_replace(F.regexp_extract(f, r"([^/]+)$", 1), r"(\.n3)?(\.gz)?$", "")
    folder = F.regexp_extract(f, r"/year_month=([^/]+)/", 1)
    return (F.when(stem.startswith("month_"), F.regexp_replace(stem, "^month_", ""))
            .when(folder != "", folder).otherwise(stem))


def _number_of_file():
    return F.xxhash64(F.col("_metadata.file_path")).alias("fid")


def read_dump_lines(spark: SparkSession, paths) -> DataFrame:
    """``(fid, block, line, value)``; ``line`` orders lines inside a split and is without gaps there.

    ``fid`` is a 64-bit hash of the path (cheap to ship to Python), ``block``
    the split's offset in the file.
    """
    # An unreadable file must fail its job, whatever the session says.
    return (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").text(paths)
            .select(_number_of_file(), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value"))


def dump_labels(spark: SparkSession, paths) -> DataFrame:
    """(fid, year_month, gzip, size): one row a file, from the listing; month labels come from the path."""
    f = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return cut_lineage(files.select(_number_of_file(), _month_of(f).alias("year_month"), f.endswith(".gz").alias("gzip"),
                                    F.col("length").alias("size")), "dump-labels")


def inflate(lines: DataFrame, per_file: int = INFLATED_LINES) -> DataFrame:
    """``lines`` as a table of many files: inflated once, then read by many tasks, also after a lost executor."""
    spark, path = lines.sparkSession, stage_path(lines.sparkSession, "dump-lines")
    (lines.write.option("compression", "zstd").option("maxRecordsPerFile", per_file)
     .option("parquet.enable.dictionary#value", "false").parquet(path))
    return spark.read.parquet(path)


def _shape(labels: DataFrame) -> tuple[bool, bool]:
    """(are there files that Spark cuts, does a gzip file hold more than a core's fair share)."""
    plain, largest, total = labels.agg(F.count_if(~F.col("gzip")), F.max(F.when(F.col("gzip"), F.col("size"))), F.sum("size")).first()
    return bool(plain), (largest or 0) * labels.sparkSession.sparkContext.defaultParallelism > (total or 0)


def parse_dump(spark: SparkSession, paths, spread: bool | None = None, staged: bool = False,
               inflated_lines: int = INFLATED_LINES) -> DataFrame:
    """Records of the dump at ``paths``, with their month; ``staged``: written once, however often they are read.

    ``spread`` inflates gzip files into a table first (None: where one holds
    more than a core's fair share); the records are the same.
    """
    labels = dump_labels(spark, paths)
    cut, uneven = _shape(labels)
    spread = uneven if spread is None else spread
    lines = read_dump_lines(spark, paths)
    p = _classify(inflate(lines, inflated_lines) if spread else lines).mapInArrow(_carry_forward(cut or spread), _RECORD_SCHEMA)
    if cut or spread:
        p = _with_entry_state(_stage_by_kind(p))
    elif staged:
        p = _stage_by_kind(p)
    month = labels.select("fid", "year_month")
    return p.join(F.broadcast(month) if labels.count() <= MOST_BROADCAST_SPLITS else month, "fid")


def _stage_by_kind(p: DataFrame) -> DataFrame:
    """Written once, a folder a kind, so that each table reads its own records only."""
    path = stage_path(p.sparkSession, "parsed-dump")
    p.write.partitionBy("kind").parquet(path)
    return p.sparkSession.read.schema(p.schema).parquet(path).select(*p.columns)


def rdf_to_tables(spark: SparkSession, path: str, spread: bool | None = None):
    """Q05: the dump at ``path`` -> (tweets, entities, mentions), each with ``year_month``."""
    return tables_from_parsed(parse_dump(spark, path, spread))


def _wall_clock(c: str):
    """``…Z`` (UTC) stamps -> TIMESTAMP_NTZ without a zone shift; other offsets via the session zone."""
    s = F.col(c)
    return F.when(s.endswith("Z"), F.to_timestamp_ntz(F.regexp_replace(s, "Z$", ""))) \
            .otherwise(F.to_timestamp(s).cast("timestamp_ntz"))


def tables_from_parsed(p: DataFrame):
    """Split parsed records into the three model tables (projections only, no shuffle)."""
    k = F.col("kind")
    tweets = p.filter(k == "post").select(
        F.col("id").alias("tweet_id"), _wall_clock("a").alias("created_at"), F.col("b").alias("user_id"),
        F.coalesce(F.col("like").cast("int"), F.lit(0)).alias("likes"),
        F.coalesce(F.col("share").cast("int"), F.lit(0)).alias("shares"),
        F.coalesce(F.col("pos").cast("float"), F.lit(0.0).cast("float")).alias("positive_emotion"),
        F.coalesce(F.col("neg").cast("float"), F.lit(0.0).cast("float")).alias("negative_emotion"),
        "year_month")
    entities = p.filter(k == "entity").select(
        F.col("id").alias("tweet_id"), F.col("a").alias("detected_as"),
        F.col("b").alias("matched_uri"), F.col("c").cast("float").alias("confidence"), "year_month")
    mentions = p.filter(k == "mention").select(
        F.col("id").alias("tweet_id"), F.col("a").alias("username"), "year_month")
    return tweets, entities, mentions


def write_tables(tweets: DataFrame, entities: DataFrame, mentions: DataFrame, out: str,
                 mode: str = "overwrite") -> None:
    """S3: three tables partitioned by month (dynamic overwrite = per-month replace)."""
    for name, df in (("tweets", tweets), ("entities", entities), ("mentions", mentions)):
        (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("year_month").parquet(f"{out.rstrip('/')}/{name}"))


TABLES = ("tweets", "entities", "mentions")


def dump_files(spark: SparkSession, src: str) -> DataFrame:
    """The dump's files: source, year_month, file, size, mtime."""
    return list_files(spark, src, "dump", _month_of)


def pending_dump_months(spark: SparkSession, src: str, out: str) -> list[str]:
    """Months whose files (names, sizes, times) are not those that were last converted."""
    return changed_months(dump_files(spark, src), read_manifest(spark, f"{out.rstrip('/')}/_manifest"))


def convert_dump(spark: SparkSession, src: str, out: str, skip_existing: bool = True) -> DataFrame:
    """Q05 end to end: parse pending months, write the three tables and the manifest.

    All pending months go in one job.  If that fails, each goes on its own, so
    that a file that cannot be read to its end costs its month only: the month
    is reported ``failed`` and keeps what it had.  A month without rows for a
    table gets an empty file there.  Returns (year_month, status, error):
    converted, skipped or failed, for every month of the dump.
    """
    out = out.rstrip("/")
    files = cut_lineage(dump_files(spark, src), "dump-files")
    months = sorted(r.year_month for r in files.select("year_month").distinct().collect())   # calendar-sized
    pending = changed_months(files, read_manifest(spark, f"{out}/_manifest")) if skip_existing else months

    def convert(some: list[str]) -> None:
        mine = files.filter(F.col("year_month").isin(some))
        paths = [r.file for r in mine.select("file").collect()]
        tables = tables_from_parsed(parse_dump(spark, paths, staged=True))
        write_tables(*tables, out)
        for table, df in zip(TABLES, tables):
            have = {r.year_month for r in df.select("year_month").distinct().collect()}      # one column; calendar-sized
            for m in some:
                if m not in have:
                    df.limit(0).drop("year_month").coalesce(1).write.mode("overwrite").parquet(f"{out}/{table}/year_month={m}")
        write_manifest(mine, f"{out}/_manifest")

    failed = run_isolated(pending, convert)
    rows = [(m, "failed" if m in failed else "converted" if m in pending else "skipped", failed.get(m)) for m in months]
    return spark.createDataFrame(rows, "year_month string, status string, error string")


# Rendering
FILE_RECORDS = 500_000              # posts and mentions in a rendered file, about
TURN_RECORDS = 8_000_000            # and in the files that are there at once, where a dump is used in turns
MOST_TURNS = 24                     # or so: a turn costs its jobs, however small
_POST = ["tweet_id", "created_at", "user_id", "likes", "shares", "positive_emotion", "negative_emotion"]


def render_dump(tweets: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """What a dump of the model tables holds, a row a post or mention: ``(year_month, k0, k1)`` and its fields.

    Used to build parser inputs from the driver's tables.  ``write_dump``
    orders the rows and spells them as lines only then, so that
    fields are shuffled and not the lines, which are several times longer.
    """
    k0 = F.col("tweet_id").cast("long").alias("k0")
    p = tweets.select("year_month", k0, F.lit(0).alias("k1"), *_POST)
    e = entities.select("year_month", k0, F.lit(1).alias("k1"), "tweet_id", "detected_as", "matched_uri", "confidence")
    m = mentions.select("year_month", k0, F.lit(2).alias("k1"), "tweet_id", "username")
    return p.unionByName(e, allowMissingColumns=True).unionByName(m, allowMissingColumns=True)


def _lines():
    """A rendered row as one text: line ``k3`` of a post, both lines of an entity.  Blank nodes are numbered by the post id, so header id and link id agree."""
    def text(pattern, *cols):               # as format_string, which spells a null so too, but without a formatter a row
        parts = pattern.split("%s")
        fields = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in cols]
        return F.concat(F.lit(parts[0]), *[x for pair in zip(fields, map(F.lit, parts[1:])) for x in pair])

    q = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    hdr = text(
        '_:t%s rdf:type sioc:Post ; dc:created "%s"^^xsd:dateTime ; sioc:id "%s" ; '
        'sioc:has_creator _:u%s ;', "tweet_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "tweet_id", "user_id")
    at = F.col("k3")
    post_line = (
        F.when(at == 0, hdr)
        .when(at == 1, text('schema:interactionType schema:LikeAction ; '
                            'schema:userInteractionCount "%s"^^xsd:integer .', q("likes")))
        .when(at == 2, text('schema:interactionType schema:ShareAction ; '
                            'schema:userInteractionCount "%s"^^xsd:integer .', q("shares")))
        .when(at == 3, text('onyx:hasEmotionCategory wna:positive-emotion ; '
                            'onyx:hasEmotionIntensity "%s"^^xsd:double .', q("positive_emotion")))
        .otherwise(text('onyx:hasEmotionCategory wna:negative-emotion ; '
                        'onyx:hasEmotionIntensity "%s"^^xsd:double .', q("negative_emotion"))))
    node = F.concat(F.lit("e"), F.regexp_extract("matched_uri", r"(\d+)$", 1))
    ent_lines = F.concat_ws(
        "\n",
        text("_:t%s schema:mentions _:%s .", "tweet_id", node),
        text('%s rdf:type nee:Entity ; nee:detectedAs "%s" ; nee:hasMatchedURI <%s> ; '
             'nee:confidence "%s"^^xsd:double .',
             F.concat(F.lit("_:"), node), "detected_as", "matched_uri",
             F.col("confidence").cast("string")))
    user = text('_:m%s rdf:type sioc:UserAccount ; sioc:name "%s" .', "tweet_id", "username")
    return F.when(F.col("k1") == 0, post_line).when(F.col("k1") == 1, ent_lines).otherwise(user)


def write_dump(rows: DataFrame, out: str, files_per_month: int = 2, compression: str = "gzip",
               file_records: int = FILE_RECORDS) -> None:
    """Write rendered rows as text, posts contiguous and in order per file.

    Each month is spread over ``files_per_month`` hash buckets of the post
    key, or over as many more as keep a file to about ``file_records`` rows:
    a file is a task's work, whatever the month holds, and a post never spans
    two files.
    """
    rows = cut_lineage(rows, "dump-rows")
    files = cut_lineage(rows.groupBy("year_month").agg(
        F.greatest(F.lit(max(1, files_per_month)), F.ceil(F.count(F.lit(1)) / file_records)).alias("files")), "dump-files-of")   # a row a month
    n_files = files.agg(F.sum("files")).first()[0] or 1
    of = F.broadcast(files.withColumnRenamed("year_month", "of_month"))
    k2 = F.when(F.col("k1") == 1, F.concat_ws("|", "matched_uri", F.col("confidence").cast("string"))).otherwise(F.col("username"))
    k3 = F.when(F.col("k1") == 0, F.sequence(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0)))    # of a repeated post all headers come first
    # A sorted row is written as one text: no step after the sort may ask for another.
    (rows.join(of, F.col("year_month").eqNullSafe(F.col("of_month")))
     .repartition(int(n_files), "year_month", F.pmod(F.xxhash64("k0"), "files")).drop("of_month", "files")
     .withColumns({"k2": k2, "k3": F.explode(k3)}).sortWithinPartitions("year_month", "k0", "k1", "k2", "k3")
     .select("year_month", _lines().alias("value"))
     .write.mode("overwrite").partitionBy("year_month").option("compression", compression).text(out))


def _turns(counts: list[tuple[str | None, int]], turn_records: int) -> list[list[tuple[str | None, int, int]]]:
    """Parts ``(month, i, of)`` of the months, in order, that each make about ``turn_records`` rows."""
    size = max(1, turn_records, -(-sum(n for _, n in counts) // MOST_TURNS))
    turns, room = [[]], size
    for month, n in counts:
        parts = -(-n // size)
        for i in range(parts):
            if turns[-1] and room < n / parts:
                turns.append([])
                room = size
            turns[-1].append((month, i, parts))
            room -= n / parts
    return turns


def use_in_turns(rows: DataFrame, out: str, use: Callable[[str, float], None], files_per_month: int = 2, compression: str = "gzip",
                 file_records: int = FILE_RECORDS, turn_records: int = TURN_RECORDS) -> None:
    """``write_dump`` for uses that take some files at a time: a dump has many times the bytes of its rows.

    The rows are written once, and of them ``turn_records`` or a
    ``MOST_TURNS``-th, whichever is more, as files below ``out``.  For each
    turn ``use`` gets the folder and which share of all rows it holds; both the
    files and what ``use`` stages are deleted then, so it must write what it
    keeps.  Every row is in one turn, and a post of a month never spans two.
    """
    spark, columns = rows.sparkSession, rows.columns
    with passing_stages(spark):
        path = stage_path(spark, "turn-rows")
        rows.write.option("compression", "zstd").partitionBy("year_month").parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path).select(*columns)
        counts = sorted(map(tuple, rows.groupBy("year_month").count().collect()), key=lambda c: (c[0] is not None, c[0]))    # calendar-sized
        total = sum(n for _, n in counts)
        for t, parts in enumerate(_turns(counts, turn_records)):
            of_month, of_turn = F.lit(False), F.lit(False)
            for month, i, of in parts:
                mine = F.col("year_month").eqNullSafe(F.lit(month))
                of_month = of_month | mine
                of_turn = of_turn | (mine & (F.pmod(F.xxhash64("k0", F.lit(of)), F.lit(of)) == i))
            held = sum(n / of for month, n in counts for m, _, of in parts if m == month)
            folder = f"{out.rstrip('/')}/turn-{t:04d}"
            with passing_stages(spark):
                write_dump(rows.filter(of_month).filter(of_turn), folder, files_per_month, compression, file_records)
                use(folder, held / total if total else 1.0)
            delete_folder(spark, folder)
