"""Legacy ARC archives, and their conversion to WARC.

An ARC file opens with a version block, whose first line is ``filedesc://`` and whose second
names the version; then come records, each a header line, as many bytes as the line declares,
and a line feed. The line has five fields in version 1 and ten in version 2; it is read
from its end, as old addresses may hold blanks. Files may be gzipped, in one member or many,
and may follow one another in a file; a version holds up to the next version block.

``to_warc`` makes of each record what it lacks: an identifier (a name-based UUID of the file
and offset), a timestamp from the archive date, a type and digests. A version block becomes
``warcinfo``; a document that opens with ``HTTP/`` becomes a ``response``, or, where its
payload is equal to that of a response with a larger key, a ``revisit`` that holds the HTTP
headers only; any other document becomes a ``resource``.

Files are written by Spark's text writer, which ends a record with what the format
asks for, and read as whole binary files; a file is as large as a task's part. Reading
follows declared lengths, holds one record at a time, and checks digests: a truncated or
altered archive is an error.

* A null document is an empty payload. A null address becomes ``-``; blanks and control
  characters in addresses are percent-encoded. A null key is less than any other.
* Rows that agree are archived one by one; among equal keys the largest identifier counts.
* Extra columns, whatever their names, are ignored. An empty table gives no records.
* A document of any length up to the 2 GB of a cell is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagauge.llm.joins import join_unique
from schemagauge.llm.storage import stored

KEY_HEADER = "X-Page-Id"
#: Bytes of records handed on at once.
BATCH = 4_000_000

#: The version blocks of ARC files, and the field names of their header lines.
_ORIGIN = b"InternetArchive"
_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisits that share a payload.
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_EPOCH = "19700101000000"


def _escaped(url: str | None) -> bytes:
    found = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "-")
    return found.encode()


def digest(data: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 %s\n%s\n" % (version, _ORIGIN, _FIELDS[version])
    line = b"filedesc://%s 0.0.0.0 %s text/plain" % (name, date)
    return _record(version, line, b"200", name, 0, body)


def _record(version: int, line: bytes, status: bytes, name: bytes, offset: int, body: bytes) -> bytes:
    more = b" %s - - %d %s" % (status, offset, name) if version == 2 else b""
    return b"%s%s %d\n%s" % (line, more, len(body), body)


def _archived(batches, version, date, key_header):
    task = TaskContext.get().partitionId()
    version = version or 1 + task % 2
    name, date, offset = b"part-%05d.arc" % task, date.encode(), 0
    out = [version_block(version, name, date)]
    size = offset = len(out[0]) + 1
    for batch in batches:
        for url, body, key in zip(*[batch.column(c) for c in ("url", "body", "key")]):
            body, key = body.as_py(), key.as_py()
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(body)
            if key is not None:
                head += b"%s: %d\r\n" % (key_header.encode(), key)
            line = b"%s 0.0.0.0 %s text/html" % (_escaped(url.as_py()), date)
            out.append(_record(version, line, b"200", name, offset, head + b"\r\n" + body))
            offset += len(out[-1]) + 1
            size += len(out[-1])
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _write(records: Column, df: DataFrame, folder: str, end: str) -> None:
    text = df.select(records.cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").text(folder)


def write_arc(
    pages: DataFrame,
    folder: str,
    version: int | None = None,
    date: str = "20000101000000",
    key_header: str = KEY_HEADER,
    key_column: str = "page_id",
    url_column: str = "url",
    body_column: str = "html",
) -> None:
    """Archive documents with their addresses and keys as ARC files of a version, or of both in turn."""
    rows = pages.select(
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(body_column).cast("binary"), F.lit(b"")).alias("body"),
        F.col(key_column).cast("long").alias("key"),
    )
    made = rows.mapInArrow(lambda x: _archived(x, version, date, key_header), "record binary")
    _write(F.col("record"), made, folder, "\n")


def _stream(data) -> io.BufferedIOBase:
    raw = pa.BufferReader(data)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18)


def _exactly(stream, n: int, where: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"{where} ends within a record")
    return data


def arc_records(stream, where: str) -> Iterator[tuple]:
    """(offset, version, url, ip, date, type, block) of each record of an ARC stream."""
    version, at = None, 0
    while line := stream.readline():
        offset, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if line.startswith(b"filedesc://"):
            n = int(line.rsplit(b" ", 1)[1])
            block = _exactly(stream, n, where)
            version = int(block.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"{where} has the unknown version {version}")
        elif version is None:
            raise ValueError(f"{where} has no version block")
        n_fields = _FIELDS[version].count(b" ")
        fields = line.rsplit(b" ", n_fields)
        if line.startswith(b"filedesc://"):
            fields = line.split(b" ")  # writers differ in what follows the fourth field
        elif len(fields) <= n_fields or not fields[-1].isdigit():
            raise ValueError(f"{where} has a broken header line at {offset}: {line[:200]!r}")
        else:
            block = _exactly(stream, int(fields[-1]), where)
        at += len(block)
        url, ip, date, kind = [x.decode(errors="replace") for x in fields[:4]]
        yield offset, version, url, ip, date, kind, block


def _timestamp(date: str) -> str:
    """An archive date of up to 14 digits in the form of a WARC; what is lacking is that of the epoch."""
    d = date if date.isdigit() and len(date) in (4, 6, 8, 10, 12, 14) else _EPOCH
    d += _EPOCH[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _identifier(*parts) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, "#".join(map(str, parts))).urn


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the empty line after them, and the payload."""
    ends = [block.find(x) + len(x) for x in (b"\r\n\r\n", b"\n\n") if x in block]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


def _key(head: bytes, key_header: bytes) -> int | None:
    found = re.search(rb"(?im)^" + re.escape(key_header) + rb":[ \t]*(-?\d{1,19})[ \t\r]*$", head)
    return int(found[1]) if found else None


_SYNTHESISED = pa.schema(
    [
        ("record_id", pa.string()),
        ("info_id", pa.string()),
        ("type", pa.string()),
        ("date", pa.string()),
        ("target", pa.string()),
        ("ip", pa.string()),
        ("content_type", pa.string()),
        ("key", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("block_digest", pa.string()),
        ("head_digest", pa.string()),
        ("head", pa.binary()),
        ("payload", pa.binary()),
    ]
)
_SLIM = ("record_id", "key", "payload_bytes", "payload_digest")
_DDL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += weigh(row) + 200
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _files(batches) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            yield path, _stream(content.as_buffer())


def _converted(batches, key_header):
    for path, stream in _files(batches):
        name, info = path.rsplit("/", 1)[-1], None
        for offset, _, url, ip, date, kind, block in arc_records(stream, path):
            made, head, payload, key = _identifier(name, offset), b"", block, None
            content_type, of_block = kind, digest(block)
            of_payload = of_block
            if url.startswith("filedesc://"):
                info, what, content_type = made, "warcinfo", "text/plain"
            elif block.startswith(b"HTTP/"):
                what, content_type = "response", "application/http; msgtype=response"
                head, payload = _split_http(block)
                key, of_payload = _key(head, key_header), digest(payload)
            else:
                what = "resource"
            yield (
                made, info, what, _timestamp(date), url, None if ip in ("-", "0.0.0.0") else ip, content_type, key,
                len(payload), of_payload, of_block, digest(head), head, payload,
            )


def arc_table(spark: SparkSession, folder: str, key_header: str = KEY_HEADER, whole: bool = True) -> DataFrame:
    """What is to be a WARC record, a row per ARC record of the files in a folder.

    Without ``whole`` only the responses, and the columns that tell which payloads are equal.
    """
    key_header = key_header.encode()
    schema = _SYNTHESISED if whole else pa.schema([_SYNTHESISED.field(c) for c in _SLIM])
    places = [_SYNTHESISED.get_field_index(c) for c in schema.names]

    def of_files(batches):
        rows = _converted(batches, key_header)
        if not whole:
            rows = (tuple(r[i] for i in places) for r in rows if r[2] == "response")
        return _batched(rows, schema, lambda r: len(r[-1]) if whole else 0)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(of_files, _ddl(schema))


def to_warc(spark: SparkSession, folder: str, least: int = 0, key_header: str = KEY_HEADER) -> DataFrame:
    """The records of ARC files as WARC records, with ``refers_to`` where one is a revisit.

    Of responses whose payloads are equal and of ``least`` bytes or more, that with the
    largest key holds the payload, and the others revisit it.
    """
    slim = stored(arc_table(spark, folder, key_header, whole=False), "payloads")
    same = ["payload_digest", "payload_bytes"]
    leaders = slim.filter(F.col("payload_bytes") >= least).groupBy(*same)
    leaders = leaders.agg(F.count("*").alias("n"), F.max(F.struct("key", "record_id")).alias("leader"))
    revisits = join_unique(
        slim, leaders.filter("n > 1").select(*same, F.col("leader.record_id").alias("refers_to")), same, F.col("record_id")
    )
    revisits = revisits.filter("record_id <> refers_to").select("record_id", "refers_to")
    # Identifiers are unique on both sides: no key is hot where payloads are moved.
    found = arc_table(spark, folder, key_header).join(revisits, "record_id", "left")
    again = F.col("refers_to").isNotNull()
    return found.select(
        *[c for c in found.columns if c not in ("type", "block_digest", "head_digest", "payload", "refers_to")],
        F.when(again, "revisit").otherwise(F.col("type")).alias("type"),
        F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")).alias("block_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
        "refers_to",
    )


def write_warc(records: DataFrame, folder: str) -> None:
    """Write rows of :func:`to_warc` as gzipped WARC files."""

    def field(name, value):
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    urn = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    block = F.concat("head", F.coalesce("payload", F.lit(b"")))
    no_info = F.when(F.col("type") != "warcinfo", urn("info_id"))
    http = F.col("type").isin("response", "revisit")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", F.col("type")),
        field("WARC-Record-ID", urn("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("target"))),
        field("WARC-Filename", F.when(F.col("type") == "warcinfo", F.col("target"))),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Warcinfo-ID", no_info),
        field("WARC-Payload-Digest", F.when(http, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest"))),
        field("WARC-Refers-To", urn("refers_to")),
        field("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(_PROFILE))),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    _write(F.concat(head.cast("binary"), block), records, folder, "\r\n\r\n")


def warc_records(stream, where: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, by names in lower case, and the block of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where} has no record where one must begin: {line[:200]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode(errors="replace")
        yield fields, _exactly(stream, int(fields["content-length"]), where)


_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("date", pa.string()),
        ("target", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("key", pa.int64()),
        ("head", pa.binary()),
        ("payload", pa.binary()),
    ]
)


def _read(batches, key_header, payloads):
    for path, stream in _files(batches):
        for fields, block in warc_records(stream, path):
            what, declared = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
            head, payload = b"", block
            if what in ("response", "revisit"):
                head, payload = _split_http(block)
            checks = [(fields.get("warc-block-digest"), block)]
            if what == "revisit":
                payload = None
            elif declared:
                checks.append((declared, payload))
            for wanted, data in checks:
                if wanted and digest(data) != wanted.removeprefix("sha1:"):
                    raise ValueError(f"{path} has an altered record {fields['warc-record-id']}")
            refers_to = fields.get("warc-refers-to")
            yield (
                fields["warc-record-id"].strip("<>"), what, fields["warc-date"], fields.get("warc-target-uri"),
                refers_to and refers_to.strip("<>"), declared or None, None if payload is None else len(payload),
                _key(head, key_header), head, payload if payloads else None,
            )


def read_warc(
    spark: SparkSession, folder: str, key_header: str = KEY_HEADER, payloads: bool = True
) -> DataFrame:
    """A row per record of the WARC files in a folder; digests are checked."""
    key_header = key_header.encode()
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(
        lambda x: _batched(_read(x, key_header, payloads), _READ, lambda r: len(r[-1] or b"")), _ddl(_READ)
    )


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits of :func:`read_warc`; a revisit has the length of what it revisits.

    ``refers_key`` is the key of that response.
    """
    slim = stored(records.drop("head", "payload").filter(F.col("type").isin("response", "revisit")), "records")
    whole = slim.filter("refers_to is null").withColumn("refers_key", F.lit(None).cast("long"))
    held = slim.filter("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("refers_key"), F.col("payload_bytes").alias("held")
    )
    again = join_unique(slim.filter("refers_to is not null"), held, ["refers_to"], F.col("record_id"), "left")
    again = again.withColumn("payload_bytes", F.col("held")).drop("held")
    return whole.unionByName(again)
