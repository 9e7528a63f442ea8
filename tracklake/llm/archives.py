"""Legacy web archives (ARC 1 and 2) to WARC 1.0.

An ARC file starts with a version block, whose second line tells the version and so the fields of the header lines; each record is a
header line and as many bytes as the line's last field declares. The converter walks these lengths, never searching in content, and
makes for each record what WARC asks for: a record id, a date, a type, payload and block digests. Of records with equal payloads of at
least ``LEAST_REVISIT`` bytes the one with the largest number (header X-Page-Id) is a response and the others become revisits of it, without payload.

Archives are files of about ``FILE_BYTES`` before compression, each one a row while it is written or read, so memory follows that size
(or the longest record). They are written and read by Spark's own text and binary-file formats, and so lie in any store that Spark reaches. Which payloads repeat is found
from digests alone, in a first pass; only that small table meets the records of the second.

Defined cases: a null page is an empty payload; a null url is ``urn:null``, spaces and control bytes in a url are percent-encoded; a null id has no number and is
smaller than others; a page repeated in whole makes a record each, and equal numbers are ordered by record id; a file cut off within a record gives the records before; an empty table gives no archive; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_path, drop_written, new_path, written

FILE_BYTES = 8 << 20
LEAST_REVISIT = 1000
ADDRESS, DATE = "0.0.0.0", "20240101000000"
#: Fields of the header lines of either version, fixed by the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "record_id string, type string, url string, ip string, date string, kind string, head binary, payload binary, sha1 string, number long, refers_to string"


def arc_header(version: int, name: str) -> bytes:
    block = f"{version} 0 tracklake\n{' '.join(FIELDS[version])}\n".encode()
    if version == 1:
        return f"filedesc://{name} {ADDRESS} {DATE} text/plain {len(block)}\n".encode() + block
    return f"filedesc://{name} {ADDRESS} {DATE} text/plain 200 - - 0 {name} {len(block)}\n".encode() + block


def arc_record(version: int, url: str, content: bytes, name: str, offset: int) -> bytes:
    if version == 1:
        line = f"{url} {ADDRESS} {DATE} text/html {len(content)}"
    else:
        line = f"{url} {ADDRESS} {DATE} text/html 200 {hashlib.sha1(content).hexdigest()} - {offset} {name} {len(content)}"
    return b"\n" + line.encode() + b"\n" + content


def clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:null"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, content, offset) of the records of an ARC file, without the version block."""
    end = data.find(b"\n")
    block = int(data[:end].rpartition(b" ")[2])
    version = int(data[end + 1 : end + 1 + block].split(None, 1)[0])
    names = FIELDS[version]
    at = end + 1 + block
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        values = data[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)  # old urls may hold spaces
        if len(values) < len(names) or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(data):
            return
        size = int(values[-1])
        yield dict(zip(names, values, strict=True)), data[end + 1 : end + 1 + size], at
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP message; a content without head is all payload."""
    if content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", content


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def warc_date(date: str) -> str:
    date = (date + "00000101000000"[len(date) :])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            return
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def opened(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _files(parts: Iterator[tuple[bytes, bytes]], schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Join pieces into file rows of about FILE_BYTES; a piece comes with the head of a file it would start."""
    held, size = [], 0
    for head, part in parts:
        if not held:
            held, size = [head], len(head)
        held.append(part)
        size += len(part)
        if size >= FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(held)], pa.binary())], names=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(held)], pa.binary())], names=schema)


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[bytes, bytes]]:
        at = 0
        version, name, head = 1, "", b""
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                number = f"X-Page-Id: {page}\r\n" if page is not None else ""
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                if not at:
                    name = f"{uuid.uuid4().hex}.arc"
                    head = arc_header(version, name)
                    at = len(head)
                record = arc_record(version, clean_url(url), content, name, at + 1)
                at += len(record)
                yield head, record
                if at >= FILE_BYTES:
                    at, version = 0, 3 - version  # both versions are written in turn

    yield from _files(parts(), ["file", "data"])


def _write(files: DataFrame, path: str) -> None:
    rows = files.select("file", F.col("data").cast("string").alias("value"))
    rows.write.partitionBy("file").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(path)


def write_arcs(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write pages as ARC files, of either version."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("body"))
    _write(rows.mapInArrow(_arcs, "file string, data binary"), path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _arc_rows(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.binary() if n in ("head", "payload") else pa.int64() if n == "number" else pa.string()) for n in ("record_id", "type", "url", "ip", "date", "kind", "head", "payload", "sha1", "number", "refers_to")])
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, size = [], 0
            for fields, content, offset in parse_arc(opened(data.as_py())):
                head, payload = split_http(content)
                number = header_value(head, "X-Page-Id")
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path.rpartition('/')[2]} {offset} {fields['URL']} {fields['Archive-date']}")
                rows.append((f"<urn:uuid:{name}>", "response" if head else "resource", fields["URL"], fields["IP-address"], warc_date(fields["Archive-date"]), fields["Content-type"], head, payload if with_payload else None, hashlib.sha1(payload).hexdigest(), int(number) if number and re.fullmatch(r"-?\d+", number) else None, str(len(payload))))
                size += len(payload)
                if size >= FILE_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def arc_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of ARC files with what WARC needs of them; ``size`` is the payload's."""
    rows = _read(spark, path).mapInArrow(lambda b: _arc_rows(b, with_payload), RECORD)
    return rows.withColumn("size", F.col("refers_to").cast("long")).drop("refers_to")


def _warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[bytes, bytes]]:
        info = b"software: tracklake\r\nformat: WARC File Format 1.0\r\n"
        for batch in batches:
            for r in batch.to_pylist():
                head = warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")], info)
                revisit = r["refers_to"] is not None
                block = r["head"] if revisit else r["head"] + r["payload"]
                fields = [("WARC-Type", "revisit" if revisit else r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"])]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["refers_to"])]
                digest = "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                fields += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", base32_sha1(block)), ("Content-Type", "application/http; msgtype=response" if r["head"] else r["kind"])]
                yield head, warc_bytes(fields, block)

    yield from _files(parts(), ["file", "data"])


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """Convert all ARC files under one folder to WARC files under another."""
    short = arc_records(spark, arcs, with_payload=False).where(f"size >= {LEAST_REVISIT} and type = 'response'")
    place = F.struct(F.col("number"), F.col("record_id"))
    groups = short.groupBy("sha1").agg(F.max(place).alias("top"), F.min(place).alias("low")).where("not top <=> low")
    groups = written(groups.select("sha1", F.col("top.record_id").alias("kept")), "payloads")
    rows = arc_records(spark, arcs).join(groups, "sha1", "left")
    again = F.expr(f"case when size >= {LEAST_REVISIT} and type = 'response' and kept != record_id then kept end")
    rows = rows.withColumn("refers_to", again).withColumn("payload", F.when(again.isNull(), F.col("payload"))).drop("kept", "size")
    _write(rows.mapInArrow(_warcs, "file string, data binary"), warcs)
    drop_written(groups)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(1):
            rows = []
            for fields, block in parse_warc(opened(data.as_py())):
                if fields["warc-type"] == "warcinfo":
                    continue
                head, payload = split_http(block)
                stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                revisit = fields["warc-type"] == "revisit"
                if base32_sha1(block) != fields["warc-block-digest"] or not revisit and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"digest of {fields['warc-record-id']} does not match")
                number = header_value(head, "X-Page-Id")
                rows.append((fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"], fields["warc-date"], int(number) if number else None, None if revisit else len(payload), stated, fields.get("warc-refers-to")))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "type", "url", "date", "number", "size", "sha1", "refers"])


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, digests checked; a revisit has the payload size and number of what it refers to."""
    rows = _read(spark, path).mapInArrow(_warc_rows, "record_id string, type string, url string, date string, number long, size long, sha1 string, refers string")
    first = rows.where("type = 'response'").select(F.col("record_id").alias("refers"), F.col("size").alias("full"), F.col("number").alias("refers_to"))
    plain = rows.where("refers is null").withColumns({"full": F.col("size"), "refers_to": F.lit(None).cast("long")})
    again = rows.where("refers is not null").join(first, "refers", "left")
    return plain.unionByName(again).withColumn("size", F.col("full")).drop("full")


def op4_warc(spark, sf_dir):
    """All pages written as ARC, converted to WARC, and read back."""
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs)
    convert(spark, arcs, warcs)
    delete_path(spark, arcs)
    out = warc_records(spark, warcs)
    return out.select(F.col("number").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op4_warc": op4_warc}
SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE strlen(html) >= {LEAST_REVISIT} GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(top, page_id) AS refers_to
FROM p LEFT JOIN g ON p.html = g.html"""
}
