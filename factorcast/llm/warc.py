"""Operator 2: legacy ARC archives converted to WARC, written and read back.

``to_arc`` packs rows into ARC archives (version 1 or 2), ``arc_records``
parses archives by the field names their own version block declares and by
each header line's declared length, and synthesises what WARC needs: a
record identifier (name-based UUID of archive, offset, URL, date and payload
digest, so rows that repeat get one each), an ISO timestamp from the 4 to 14
digit ARC date, the record type and base32 SHA-1 digests of block and
payload.  A row's id travels as an own header (``X-Page-Id``), the URL as it
is.  ``write_warc`` makes revisit records of repeated payloads, which name
the original by its record identifier, URL and date, compresses record by
record (one gzip member each, so readers can seek) and writes archives of at
most some FILE_CHUNKS * CHUNK_BYTES with Spark's own text writer and commit
protocol, so they go to any file system Spark knows; ``read_warc`` parses
them back by their declared lengths.

Scale: the archives are parsed once, into a table in the checkpoint folder;
duplicates are found on its digests alone, a digest that holds a third of all
rows being joined by broadcast (:func:`factorcast.llm.common.lookup`).
Payloads then meet their decisions by record identifier, which is unique.

Defined results: null html is the empty payload; null or blank URLs become
``urn:page:<id>``, characters that a header line cannot hold are percent-coded;
rows repeated with the same id and payload give repeated records of the same
type, each with its own identifier; a null id never is a response if its
payload has a row with an id, and if it has none the earliest record is; an empty table gives archives without records;
further columns are ignored, whatever their names.  A malformed header line
or a declared length beyond the archive's end raises ValueError; no record
is skipped.  One record must fit a Spark value (2 GiB), however many do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorcast.llm.common import lookup, materialize, scratch_path

ARC_BYTES = 4 << 20        # an in-flight ARC archive closes at this size
BATCH_BYTES = 8 << 20      # parsed records leave in batches of this size
CHUNK_BYTES = 4 << 20      # compressed records are handed to the writer in pieces of this size
FILE_CHUNKS = 16           # pieces of one WARC file

# Field names of the two ARC versions, as their version blocks declare them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
PAGE_HEADER = "X-Page-Id"
REFERS_HEADER = "X-Refers-To-Page-Id"
# What stands between two pieces of a WARC file: a gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_RECORD = ("page_id long, uri string, ip string, warc_date string, record_id string, "
              "warc_type string, head_bytes long, payload_bytes long, payload_digest string, "
              "block_digest string, block binary")
WARC_RECORD = ("page_id long, record_type string, record_id string, uri string, "
               "warc_date string, payload_bytes long, payload_digest string, "
               "refers_to_uri string, refers_to_id string, refers_to_date string, "
               "refers_to long, block binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id: int | None, url: str | None) -> str:
    """The URL made safe for a space-separated header line."""
    clean = quote((url or "").strip(), safe="%/:=&?~#+!$,;'@()*[]")
    return clean or f"urn:page:{'' if page_id is None else page_id}"


def page_of(block: bytes) -> int | None:
    """The page id among the HTTP headers (a block's part before the payload)."""
    found = re.search(rb"\r\n" + PAGE_HEADER.encode() + rb": (-?\d+)\r\n", block)
    return int(found[1]) if found else None


def _arc_head(version: int, date: str, name: str) -> bytes:
    body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n\n".encode()
    tail = " 200 - - 0 archive" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode() + body


def to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html", date: str = "20240101000000",
           versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(arc binary): the rows as ARC archives of about ARC_BYTES, in turn of each version."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts, size = 0, [], 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                version = versions[made % len(versions)]
                if not parts:
                    parts = [_arc_head(version, date, f"part-{task:05d}-{made:05d}.arc"), b"\n"]
                own = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
                block = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         f"{own}\r\n{html or ''}").encode("utf-8")
                extra = " 200 - - 0 archive" if version == 2 else ""
                parts += [f"{page_uri(page_id, url)} 0.0.0.0 {date} text/html{extra} "
                          f"{len(block)}\n".encode(), block, b"\n"]
                size += len(block)
                if size >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())],
                                                     ["arc"])
                    made, parts, size = made + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["arc"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"),
                        F.col(html_col).cast("string"))
    return rows.mapInArrow(pack, "arc binary")


def iso_date(digits: str) -> str:
    """ISO time of a 4 to 14 digit ARC date; missing parts take their first value."""
    if not re.fullmatch(r"\d{4,14}", digits):
        raise ValueError(f"ARC date {digits!r}")
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _opened(data: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if data[:2] == b"\x1f\x8b" else raw


def _exactly(source: io.BufferedIOBase, n: int) -> bytes:
    data = source.read(n)
    if len(data) < n:
        raise ValueError(f"declared length {n}, but only {len(data)} bytes are left")
    return data


def parse_arc(data: bytes) -> Iterator[tuple]:
    """The ARC_RECORD tuples of one archive."""
    source, names, archive = _opened(data), None, ""
    while (at := source.tell(), line := source.readline())[1]:
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8").rstrip("\r\n").split(" ")
        if names is None:
            if not fields[0].startswith("filedesc:"):
                raise ValueError("an ARC archive starts with its version block")
            block = _exactly(source, int(fields[-1]))
            declared = block.decode("utf-8").split("\n")
            if declared[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"ARC version {declared[0]!r}")
            names, archive = declared[1].strip().split(" "), fields[0]
            continue
        if len(fields) != len(names):
            raise ValueError(f"ARC header line of {len(fields)} fields, declared {len(names)}")
        head = dict(zip(names, fields))
        block = _exactly(source, int(head["Archive-length"]))
        http = not head["URL"].startswith("dns:") and block.startswith(b"HTTP/")
        split = block.find(b"\r\n\r\n") + 4 if http and b"\r\n\r\n" in block else 0
        payload = block[split:]
        digest, date = sha1_base32(payload), iso_date(head["Archive-date"])
        record = uuid.uuid5(uuid.NAMESPACE_URL,
                            f"{archive} {at} {head['URL']} {date} {digest}")
        yield (page_of(block[:split]), head["URL"], head["IP-address"], date,
               f"<urn:uuid:{record}>", "response" if split else "resource", split,
               len(payload), digest, sha1_base32(block), block)


def _batches(tuples: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in tuples:
        rows.append(row)
        size += 500 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def arc_records(archives: DataFrame, arc_col: str = "arc", with_block: bool = True) -> DataFrame:
    """The records of ARC archives (a binary column, gzipped or not) as ARC_RECORD rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for batch in batches:
                for data in batch.column(0):
                    for row in parse_arc(data.as_py() or b""):
                        yield row if with_block else (*row[:-1], None)
        yield from _batches(tuples(), _schema(ARC_RECORD))

    return archives.select(arc_col).mapInArrow(parse, ARC_RECORD)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files (gzipped or not) below ``path``."""
    return arc_records(spark.read.format("binaryFile").load(path), "content")


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record_id, original): the records that repeat the payload, of at least
    ``min_bytes``, of an original: the record with the largest page id or, where
    none has one (foreign archives), the earliest.  ``original`` holds its page_id,
    record_id, uri and warc_date (of rows that repeat it, the least)."""
    index = index.where(F.col("payload_bytes") >= min_bytes).select(
        "page_id", "payload_digest", "record_id", "uri", "warc_date")
    best = materialize(index.groupBy("payload_digest").agg(
        F.max("page_id").alias("_page"), F.min(F.struct("warc_date", "record_id")).alias("_first"),
        F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = max(1, index.count())
    found = materialize(
        lookup(index, best, "payload_digest", "record_id", "n", total)
        .where("_first is not null").withColumn("_is_original", F.when(
            F.col("_page").isNull(), F.col("record_id") == F.col("_first.record_id")
        ).otherwise(F.col("page_id").eqNullSafe(F.col("_page")))))
    first = materialize(found.where("_is_original").groupBy("payload_digest").agg(
        F.min(F.struct("page_id", "record_id", "uri", "warc_date")).alias("original")
    ).join(best.select("payload_digest", "n"), "payload_digest"))
    again = found.where("not _is_original").select("record_id", "payload_digest")
    return lookup(again, first, "payload_digest", "record_id", "n", total).select(
        "record_id", "original")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records, each a gzip member, joined to pieces of about CHUNK_BYTES."""
    parts, size = [], 0
    for batch in batches:
        for at in range(batch.num_rows):       # one record as Python objects at a time
            row = batch.slice(at, 1).to_pylist()[0]
            original, block = row["original"], row["block"]
            revisit = original is not None and row["warc_type"] == "response"
            head = [("WARC-Type", "revisit" if revisit else row["warc_type"]),
                    ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]),
                    ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]),
                    ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
            if row["page_id"] is not None:
                head.append((PAGE_HEADER, row["page_id"]))
            if revisit:
                block = block[:row["head_bytes"]]
                head += [("WARC-Profile", REVISIT_PROFILE),
                         ("WARC-Refers-To", original["record_id"]),
                         ("WARC-Refers-To-Target-URI", original["uri"]),
                         ("WARC-Refers-To-Date", original["warc_date"]),
                         ("WARC-Payload-Length", row["payload_bytes"])]
                if original["page_id"] is not None:
                    head.append((REFERS_HEADER, original["page_id"]))
            else:
                head.append(("WARC-Block-Digest", f"sha1:{row['block_digest']}"))
            head += [("Content-Type", "application/http; msgtype=response"
                      if row["warc_type"] == "response" else "text/html"),
                     ("Content-Length", len(block))]
            lines = "".join(f"{name}: {value}\r\n" for name, value in head)
            parts.append(gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block
                                       + b"\r\n\r\n", 6, mtime=0))
            size += len(parts[-1])
            if size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())],
                                                 ["value"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])


def write_warc(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes ARC_RECORD rows (the same at each reading) as WARC archives below ``path``."""
    joined = records.join(revisits(records, min_bytes), "record_id", "left")
    # bytes pass the text writer as they are; its line separator is a member without content
    joined.mapInArrow(_members, "value binary").select(F.col("value").cast("string")).write.option(
        "encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option(
        "maxRecordsPerFile", FILE_CHUNKS).text(path)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """The WARC_RECORD tuples of one archive."""
    source = _opened(data)
    while line := source.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record starts with its version, not {line[:40]!r}")
        head = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        block = _exactly(source, int(head["content-length"]))
        kind = head["warc-type"]
        if kind == "revisit":
            size = int(head["warc-payload-length"])
            digest = head["warc-payload-digest"].partition(":")[2]
        else:
            at = block.find(b"\r\n\r\n") + 4 if kind == "response" else 0
            size, digest = len(block) - at, sha1_base32(block[at:])
            if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        page, refers = head.get(PAGE_HEADER.lower()), head.get(REFERS_HEADER.lower())
        yield (page and int(page), kind, head["warc-record-id"], head.get("warc-target-uri", ""),
               head["warc-date"], size, digest, head.get("warc-refers-to-target-uri"),
               head.get("warc-refers-to"), head.get("warc-refers-to-date"),
               refers and int(refers), block)


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of the archives below ``path`` as WARC_RECORD rows (with
    ``with_block`` false the block is read and checked, but left out)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for batch in batches:
                for data in batch.column(0):
                    for row in parse_warc(data.as_py()):
                        yield row if with_block else (*row[:-1], None)
        yield from _batches(tuples(), _schema(WARC_RECORD))

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(parse, WARC_RECORD)


def convert_arcs(archives: DataFrame, path: str, arc_col: str = "arc",
                 min_bytes: int = 0) -> None:
    """ARC archives (a binary column) -> WARC archives below ``path``; parsed once."""
    spark = archives.sparkSession
    parsed = scratch_path(spark, "arc")
    arc_records(archives, arc_col).write.option("compression", "zstd").parquet(parsed)
    write_warc(spark.read.parquet(parsed), path, min_bytes)


def convert(pages: DataFrame, path: str | None = None, min_bytes: int = 0,
            id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows -> ARC -> WARC archives below ``path`` -> records read back (without blocks)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    convert_arcs(to_arc(pages, id_col, url_col, html_col), path, min_bytes=min_bytes)
    return read_warc(spark, path, with_block=False)
