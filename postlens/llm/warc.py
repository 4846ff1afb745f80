"""WARC archives: writing, normalising monolithic gzip, reading by offset.

``write_archives`` writes pages as WARC records; Spark's text sink compresses
each file as one gzip stream, the monolithic form.  ``normalise`` inflates
such a file once, as a stream, rewrites every record as a gzip member of its
own, and writes beside it a sidecar index of offsets.  ``read_records`` then
seeks to single records.  Payloads of at least ``least`` bytes that occur more
than once are kept once: the row with the largest page_id is the response, the
others are revisit records that refer to it.

Files are opened by URI through pyarrow's file systems (local, HDFS, S3, GCS),
in the shared folder that the caller names; a file is written under a name of
its attempt and then moved, so a lost executor leaves no half-written archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import by_value, stage, stage_compressed

by_value(__name__)

LEAST = 1000                 # payload bytes from which copies become revisits
CHUNK = 1 << 20
READ_SPAN = 4 << 20          # archive bytes one reading task takes at a time
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


# Records
def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) + payload, digest (hex), record id, refers (the response's id, for revisits).

    The response of equal payloads is the row of the largest page_id (null
    last; rows that tie in it by row number).  Only digests that repeat are
    joined back; rows that cannot repeat join on a key of their own.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("string").alias("payload"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha1(F.col("payload").cast("binary")),
                             "bytes": F.octet_length("payload")})
    rows = stage_compressed(rows, "warc-rows")          # fixes the row numbers
    order = F.struct(F.col("page_id").isNotNull().alias("a"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    winners = (rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("same"))
               .agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
               .select("same", F.col("w.id").alias("to_id"), F.col("w.row").alias("to_row")))
    winners = stage(winners, "warc-responses")
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("row"), F.col("row").cast("string")))
    rows = rows.withColumn("same", key).join(winners, "same", "left")
    refers = F.when(F.col("to_row").isNotNull() & (F.col("to_row") != F.col("row")), _record_id("to_id", "to_row"))
    return rows.select("page_id", "url", "payload", "digest", "bytes", _record_id("page_id", "row").alias("record_id"),
                       refers.alias("refers"))


def _record_id(page: str, row: str):
    return _text("urn:page:", F.coalesce(F.col(page).cast("string"), F.lit("none")), ":", F.col(row).cast("string"))


def write_archives(decided: DataFrame, path: str, records_a_file: int = 50_000) -> None:
    """One gzip stream a file, of at most ``records_a_file`` records."""
    revisit = F.col("refers").isNotNull()
    http = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ",
                 F.col("bytes").cast("string"), "\r\n\r\n")
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = _text("WARC/1.0\r\nWARC-Type: ", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
                 "\r\nWARC-Record-ID: <", F.col("record_id"), ">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: ", uri,
                 "\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
                 F.when(revisit, _text("\r\nWARC-Refers-To: <", F.col("refers"),
                                       ">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
                 .otherwise(F.lit("")),
                 "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
                 F.octet_length(block).cast("string"), "\r\n\r\n")
    # The sink's line end is the last byte of the record's closing CR LF CR LF.
    (decided.select(_text(head, block, "\r\n\r").alias("value")).write.mode("overwrite")
     .option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).text(path))


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def split_records(stream, name: str = ""):
    """(headers, whole record) of every record of a gzip WARC stream (one or many members), inflated once.

    Holds one record and one chunk.  A stream that ends inside a record or a
    member raises ValueError.
    """
    inflate, raw, data, over = zlib.decompressobj(31), b"", bytearray(), False
    fresh = True                                        # no byte of the current member seen

    def more():
        nonlocal inflate, raw, over, fresh
        while not over:
            if inflate.eof:
                raw, inflate, fresh = inflate.unused_data.lstrip(b"\0"), zlib.decompressobj(31), True
            if not raw:
                raw = stream.read(CHUNK)
                if fresh:
                    ended, raw = not raw, raw.lstrip(b"\0")       # padding between or after members
                    if ended:
                        over = True
                        return False
                    if not raw:
                        continue
                elif not raw:
                    got = inflate.decompress(b"", CHUNK)          # what it still holds back
                    if got:
                        data.extend(got)
                        return True
                    if inflate.eof:
                        continue
                    raise ValueError(f"{name}: the gzip stream is cut")
            fresh = False
            try:
                got = inflate.decompress(raw, CHUNK)
            except zlib.error as e:
                raise ValueError(f"{name}: {e}") from e
            raw = inflate.unconsumed_tail
            if got:
                data.extend(got)
                return True
        return False

    seen = 0
    while True:
        while (at := data.find(END, max(0, seen - 3))) < 0:
            seen = len(data)
            if not more():
                if bytes(data).strip():
                    raise ValueError(f"{name}: the last record is cut")
                return
        headers = parse_headers(bytes(data[:at]))
        if not data.startswith(b"WARC/") or "content-length" not in headers:
            raise ValueError(f"{name}: not a WARC record")
        size = at + 4 + int(headers["content-length"]) + 4
        while len(data) < size:
            if not more():
                raise ValueError(f"{name}: the last record is cut")
        yield headers, bytes(data[:size])
        del data[:size]
        seen = 0


# Normaliser
def open_fs(uri: str):
    """(file system, path) of a URI or plain path; ``file:/x`` as Hadoop writes it too."""
    import re

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string"


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every ``*.gz`` WARC file of ``source`` under ``target`` with one member a record.

    Returns the index (archive, offset, length, record_id, record_type,
    target_uri) and writes each archive's part of it beside the archive, as
    ``<archive>.idx``: offset, length, id, type and uri by tabs.  One task
    takes one file; files can be of any length, as they are streamed.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path"))
    n = max(1, files.count())
    files = files.repartitionByRange(min(n, 10_000), "path")

    def run(batches):
        import posixpath
        import uuid

        from pyspark import TaskContext

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs_in, p = open_fs(path)
                base = posixpath.basename(p)
                for end in (".gz", ".txt", ".warc"):
                    base = base.removesuffix(end)
                fs_out, folder = open_fs(target)
                fs_out.create_dir(folder, recursive=True)
                final = f"{folder}/{base}.warc.gz"
                attempt = f"{folder}/_attempt-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                rows, at = [], 0
                with fs_in.open_input_stream(p, compression=None) as src, \
                        fs_out.open_output_stream(attempt, compression=None) as out, \
                        fs_out.open_output_stream(attempt + ".idx", compression=None) as side:
                    for headers, record in split_records(src, path):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        row = (at, len(member), headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type", ""),
                               headers.get("warc-target-uri", ""))
                        side.write(("\t".join(map(str, row)) + "\n").encode())
                        rows.append(row)
                        at += len(member)
                        if len(rows) >= 20_000:
                            yield index_rows(target, base, rows)
                            rows = []
                publish(fs_out, attempt, final)
                publish(fs_out, attempt + ".idx", final + ".idx")
                if rows:
                    yield index_rows(target, base, rows)

    def publish(fs, attempt, final):
        try:
            fs.move(attempt, final)
        except OSError:
            # Some file systems do not move onto a file: then another attempt has written the same bytes.
            if fs.get_file_info(final).size != fs.get_file_info(attempt).size:
                raise
            fs.delete_file(attempt)

    def index_rows(folder, base, rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{folder.rstrip('/')}/{base}.warc.gz"] * len(rows)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             *(pa.array(c, pa.string()) for c in cols[2:])],
            ["archive", "offset", "length", "record_id", "record_type", "target_uri"])

    return stage(files.mapInArrow(run, INDEX), "warc-index")


# Reader
RECORD = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
          "payload_digest string, payload binary")


def _digest_hex(value: str) -> str:
    """Hex of a ``sha1:`` digest written in hex or base32."""
    value = value.partition(":")[2] or value
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_records(index: DataFrame) -> DataFrame:
    """Every indexed record, by seeking to its member.

    A response's size and digest are those of the payload read; a revisit, which
    carries none, states its payload's in its headers.
    """
    spark = index.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = (index.select("archive", "offset", "length").withColumn("span", F.floor(F.col("offset") / READ_SPAN))
             .repartition(tasks, "archive", "span").sortWithinPartitions("archive", "offset"))

    def run(batches):
        name, file = None, None
        for batch in batches:
            out, held = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if file is not None:
                        file.close()
                    fs, path = open_fs(archive)
                    name, file = archive, fs.open_input_file(path)
                file.seek(offset)
                data = zlib.decompress(file.read(length), 31)
                at = data.index(END)
                h = parse_headers(data[:at])
                block = data[at + 4:at + 4 + int(h["content-length"])]
                http_end = block.find(END)
                http = parse_headers(block[:http_end])
                if h["warc-type"] == "revisit":
                    payload, size, digest = None, int(http["content-length"]), _digest_hex(h["warc-payload-digest"])
                else:
                    payload = block[http_end + 4:]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != _digest_hex(h["warc-payload-digest"]):
                        raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                out.append((h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"),
                            h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, size, digest, payload))
                held += len(payload or b"")
                if held > 8 << 20 or len(out) >= 5000:
                    yield as_batch(out)
                    out, held = [], 0
            if out:
                yield as_batch(out)
        if file is not None:
            file.close()

    def as_batch(rows):
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes",
                                           "payload_digest", "payload"])

    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write pages as monolithic archives under ``folder``, normalise them, and read every record back.

    Columns of ``read_records`` + page_id and refers_to_page.  A null html is
    an empty payload, a null url an empty target; control characters and
    blanks in a url become %20; a null page_id comes back null.  Repeated
    rows are records of their own.  An empty table gives an empty result;
    other columns are not read.
    """
    spark = pages.sparkSession
    write_archives(decide(pages, least), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", f"{folder}/normalised")

    def page(c):
        return F.get(F.split(c, ":"), F.lit(2)).try_cast("long")

    records = read_records(index)
    return records.withColumns({"page_id": page(F.col("record_id")), "refers_to_page": page(F.col("refers_to"))})
