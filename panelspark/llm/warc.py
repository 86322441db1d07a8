"""WARC archives: written as one gzip stream per file, normalised to a member per record with an index.

1. write_archives: one record per page, many records in one gzip stream, as Spark's text writer makes
   them. Pages with equal payloads share one response; the others are revisit records without a payload.
2. normalise: every file is inflated once, as a stream; each record becomes a gzip member of its own, and
   a sidecar lists offset and length of every member. A file is the unit of work and holds at most
   FILE_RECORDS records; memory holds one record. Output is renamed into place when complete, so that a
   repeated or speculative task leaves the same files.
3. read_archives: members are read through the sidecars, by offset.

All folders are opened through Spark or pyarrow's file systems by URI, none by a local path.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import whole
from panelspark.session import cut_lineage, scratch_folder

MIN_SHARED_BYTES = 0        # smaller payloads are never replaced by revisits
FILE_RECORDS = 5_000        # records of an archive
WARC_DATE = "2020-01-01T00:00:00Z"
BROADCAST_ROWS = 2_000_000  # more payloads than this are joined by shuffle
_CHUNK = 1 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BREAK = "\r\n"
_INDEX = "archive string, offset long, length long, page_id long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a 160-bit digest in hexadecimal: five digits at a time make four letters."""
    def letters(start: int) -> list[Column]:
        bits = F.conv(F.substring(digest, start, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[x for start in range(1, 41, 5) for x in letters(start)])


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """The text of one WARC record per page.

    Of pages with equal payloads those with the largest page_id are responses, the others revisit it. A
    null payload is empty; pages without an id are responses when no equal payload has one.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    given = given.withColumns({"_bytes": F.octet_length("html").cast("long"), "_digest": F.sha1(F.col("html").cast("binary"))})
    # only payloads of several pages are looked up
    first = cut_lineage(given.where(F.col("_bytes") >= MIN_SHARED_BYTES).groupBy("_digest").agg(
        F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    full = given.join(first, "_digest", "left")
    revisit = F.coalesce((F.col("_bytes") >= MIN_SHARED_BYTES) & F.col("_first").isNotNull()
                         & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("_bytes").cast("string"), F.lit(_BREAK * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_BREAK))

    nothing = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1" + _BREAK), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(WARC_DATE)),
        F.coalesce(line("WARC-Target-URI", uri), nothing), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_digest")))),
        F.coalesce(F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("_first"))), line("X-Refers-To-Page", F.col("_first")))), nothing),
        F.coalesce(line("X-Page-Id", F.col("page_id")), nothing),
        F.coalesce(line("X-Page-Url", F.hex(F.encode("url", "UTF-8"))), nothing), line("X-Payload-Length", F.col("_bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body)), F.lit(_BREAK))
    return full.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Monolithic gzip files under the folder. A record ends with two line breaks, as the format asks."""
    (records(pages).write.option("lineSep", _BREAK * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def _open(uri: str):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in pieces of bounded size."""
    machine = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield machine.decompress(data, _CHUNK)
            data = machine.unconsumed_tail or machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, header block and content, of an inflated archive."""
    held, need, seek = bytearray(), None, 0
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", max(0, seek - 3))
                if end < 0:
                    seek = len(held)
                    break
                size = re.search(rb"\r\nContent-Length: *(\d+)", bytes(held[:end]), re.I)
                if not held.startswith(b"WARC/") or not size:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(size[1])
            if len(held) < need + 4:
                break
            yield bytes(held[:need])
            del held[:need + 4]
            need, seek = None, 0
    if bytes(held).strip():
        raise ValueError("the archive ends inside a record")


def _headers(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, content = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(_BREAK)[1:]
    return dict(line.split(": ", 1) for line in lines), content


def _normalise_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, target in zip(batch.path, batch.target):
            source, source_path = _open(path)
            sink, base = _open(target)
            name, trial = path.rsplit("/", 1)[1].split(".")[0], uuid.uuid4().hex
            archive, index = f"{base}/{name}.warc.gz", f"{base}/{name}.idx"
            offset = count = 0
            with (source.open_input_stream(source_path, compression=None) as stream,
                  sink.open_output_stream(f"{base}/_{trial}.gz", compression=None) as out,
                  sink.open_output_stream(f"{base}/_{trial}.idx", compression=None) as idx):
                for record in split_records(inflate(stream)):
                    member = gzip.compress(record + b"\r\n\r\n", 6, mtime=0)
                    out.write(member)
                    page = _headers(record)[0].get("X-Page-Id", "")
                    idx.write(f"{target}/{name}.warc.gz\t{offset}\t{len(member)}\t{page}\n".encode())
                    offset, count = offset + len(member), count + 1
            sink.move(f"{base}/_{trial}.gz", archive)
            sink.move(f"{base}/_{trial}.idx", index)
            yield pd.DataFrame({"archive": [f"{target}/{name}.warc.gz"], "records": [count]})


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """(archive, records) of every file of the folder, rewritten under target with its sidecar."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select(
        "path", F.lit(target).alias("target"))
    fs_, path = _open(target)
    fs_.create_dir(path, recursive=True)
    files = files.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return cut_lineage(files.mapInPandas(_normalise_files, "archive string, records long"))


def index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecars: archive, offset, length and page_id of every record."""
    return spark.read.schema(_INDEX).option("sep", "\t").option("pathGlobFilter", "*.idx").csv(target)


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for archive, part in batch.groupby("archive", sort=False):
            system, path = _open(archive)
            with system.open_input_file(path) as file:
                for offset, length in zip(part.offset, part.length):
                    file.seek(int(offset))
                    head, content = _headers(gzip.decompress(file.read(int(length)))[:-4])
                    digest, size = head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = content.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload does not match its digest in {archive} at {offset}")
                    url = head.get("X-Page-Url")
                    rows.append((head.get("X-Page-Id"), bytes.fromhex(url).decode() if url is not None else None,
                                 size, digest, head["WARC-Type"], head.get("X-Refers-To-Page")))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORD.split(", ")])
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        yield out


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, by its offset."""
    return index(spark, target).mapInPandas(_read_members, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of the pages under the shared folder, normalised, then read back.

    Defined results: a null html is an empty payload, null urls and ids come back as null; repeated rows
    each have a record; an empty table gives no record; other columns are not read. The folder goes with the
    intermediate_tables() block around the call.
    """
    spark = pages.sparkSession
    folder = scratch_folder(spark)
    write_archives(pages, f"{folder}/raw")
    normalise(spark, f"{folder}/raw", f"{folder}/members")
    return read_archives(spark, f"{folder}/members")
