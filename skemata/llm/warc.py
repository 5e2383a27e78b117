"""WARC archives: a writer, and a salvage reader for damaged ones.

The writer turns rows into WARC/1.1 records in Spark tasks, one gzip member per
record or plain, and lets Spark's own file writer store them, so archives go to
any file system Spark knows and a repeated task replaces its file.  Of the
records with equal payloads of at least ``revisit_bytes`` bytes, the one with the
smallest id is a response and the others are revisits that refer to it.

The salvage reader checks every record: gzip checksum, version line, header
syntax, length, end mark, block and payload digest.  After a failed check it
searches for the next member (gzip magic) or version line, tries again from
there, and goes on; the bytes in between become a quarantined gap with the reason.
Nothing behind a damaged place is lost, also when the damage is in a length.

An archive is read whole by one task; ``records_per_file`` keeps it bounded.

Defined cases: a null payload is empty; a null url becomes a name made of the id;
repeated ids are records of their own, and one with the response's own id is stored
in full; a null id is never the response of others; an empty table gives no record;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemata.llm.common import written
from skemata.session import work_folder

VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
MEMBER = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"
RECORDS = (
    "archive string, offset long, length long, kind string, reason string, id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One response or revisit record.  A revisit has the head of the response, the full
    payload's digest and size, and no payload."""
    name = f"{NAME}{'' if page_id is None else page_id}"
    target = (url or name).replace("\r", "%0D").replace("\n", "%0A")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{NAME}{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str, payload: str, revisit_bytes: int) -> DataFrame:
    """(digest, refers_to) of the payloads that more than one record has."""
    big = pages.filter(F.octet_length(payload) >= revisit_bytes)
    return (
        big.groupBy(F.sha2(payload, 256).alias("digest"))
        .agg(F.min(id_col).alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and refers_to is not null")
        .select("digest", "refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_bytes: int = 100,
    compress: bool = True,
    records_per_file: int = 2000,
) -> None:
    """Archives of all rows in ``folder``."""
    slim = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    # only payloads with copies are listed; as a written table the list has a known
    # size, and Spark broadcasts it while that is small
    shared = written(revisits(slim, "id", "payload", revisit_bytes), "revisits")
    hashed = slim.withColumn("digest", F.sha2("payload", 256)).join(shared, "digest", "left")
    # a record that repeats the response's id is stored in full
    hashed = hashed.withColumn(
        "refers_to", F.when(~F.col("id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                out = []
                rows = batch.slice(begin, 100)
                columns = [c.to_pylist() for c in rows.columns[:2]]
                payloads = rows.column(2).cast(pa.large_binary()).to_pylist()
                digests, refers = (rows.column(c).to_pylist() for c in (3, 4))
                for i, data in enumerate(payloads):
                    record = record_bytes(columns[0][i], columns[1][i], data, digests[i], refers[i])
                    if compress:
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        record = packer.compress(record) + packer.flush()
                    out.append(record)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = hashed.select("id", "url", "payload", "digest", "refers_to").mapInArrow(
        records, "record binary"
    )
    # The text writer stores the bytes as they are and ends each row with a separator.
    # A plain record ends with a line feed, which the separator supplies.  A member ends
    # with its size's highest byte, 0 below 16 MB, which the separator supplies likewise;
    # after a larger member the extra 0 is the padding that gzip allows.
    end = b"\x00" if compress else b"\n"
    trimmed = F.when(
        F.substring("record", -1, 1) == F.lit(end),
        F.expr("substring(record, 1, octet_length(record) - 1)"),
    ).otherwise(F.col("record"))
    (
        made.select(trimmed.cast("string").alias("value"))
        .write.option("maxRecordsPerFile", records_per_file)
        .text(folder, lineSep=end.decode())
    )


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    end: int  # where the next record begins, in the bytes that were parsed


class Damage(Exception):
    pass


def parse_record(data: bytes | memoryview, begin: int) -> Record:
    """The plain record at ``begin``; raises Damage where a check fails."""
    head_end = data.find(b"\r\n\r\n", begin)
    if not data.startswith(b"WARC/1.", begin):
        raise Damage("no version line")
    if head_end < 0:
        raise Damage("headers do not end")
    lines = data[begin:head_end].split(b"\r\n")
    if lines[0] not in VERSIONS:
        raise Damage("bad version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("bad header line")
        try:
            headers[name.strip().lower().decode()] = value.strip().decode()
        except UnicodeDecodeError:
            raise Damage("bad header text") from None
    missing = [name for name in MANDATORY if name not in headers]
    if missing:
        raise Damage(f"no {missing[0]}")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Damage("bad content-length")
    start = head_end + 4
    end = start + int(length)
    if end > len(data):
        raise Damage("record is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("no end mark")
    block = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damage("block digest differs")
    return Record(headers, block, end + 4)


def _member(content: bytes, begin: int) -> tuple[bytes, int]:
    """The gzip member at ``begin`` and where it ends."""
    unpack = zlib.decompressobj(31)
    out = []
    view = memoryview(content)
    at = begin
    while not unpack.eof:
        if at >= len(content):
            raise Damage("member is cut off")
        try:
            out.append(unpack.decompress(view[at : at + 65536]))
        except zlib.error as e:
            raise Damage(f"gzip: {str(e).split(':')[-1].strip()}") from None
        at += 65536
    return b"".join(out), min(at, len(content)) - len(unpack.unused_data)


def salvage(content: bytes) -> Iterator[tuple]:
    """(offset, length, Record or None, reason) of an archive: its records, and the gaps
    between them with the reason of the first failed check."""
    at, gap, reason = 0, None, None
    size = len(content)
    while at < size:
        packed = content.startswith(MEMBER, at)
        try:
            if packed:
                plain, end = _member(content, at)
                record = parse_record(plain, 0)
                if record.end != len(plain):
                    raise Damage("more than one record in a member")
            else:
                record = parse_record(content, at)
                end = record.end
        except Damage as damage:
            if gap is None:
                gap, reason = at, str(damage)
            found = [p for p in (content.find(MEMBER, at + 1), content.find(b"WARC/1.", at + 1)) if p >= 0]
            at = min(found, default=size)
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        yield at, end - at, record, None
        at = end
        while at < size and content[at] == 0:  # padding after a member
            at += 1
    if gap is not None:
        yield gap, size - gap, None, reason


def _number(name: str) -> int | None:
    digits = name.strip("<>").removeprefix(NAME)
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Columns RECORDS: records of kind response or revisit with their payload, and
    rows of kind gap with the bytes that no record could be read from."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [
            pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
            pa.int64(), pa.string(), pa.int64(), pa.binary(),
        ]

        def table(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                names=names,
            )

        for batch in batches:
            for i in range(batch.num_rows):
                archive, content = (batch.column(c)[i].as_py() for c in (0, 1))
                out, held = [], 0
                for offset, length, record, reason in salvage(content):
                    if record is None:
                        out.append((archive, offset, length, "gap", reason, *[None] * 6))
                    else:
                        row = _row(record)
                        out.append((archive, offset, length, *row))
                        held += len(record.block)
                    if held > 4 << 20:
                        yield table(out)
                        out, held = [], 0
                if out:
                    yield table(out)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(rows, RECORDS)


def _row(record: Record) -> tuple:
    """kind, reason, id, url, payload size, digest, refers_to, payload."""
    headers = record.headers
    kind = headers.get("warc-type", "")
    head, mark, payload = record.block.partition(b"\r\n\r\n")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    reason = None
    if kind == "revisit":
        sizes = [
            line.partition(b":")[2].strip()
            for line in head.split(b"\r\n")
            if line.lower().startswith(b"content-length:")
        ]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
        payload = None
    else:
        size = len(payload)
        actual = hashlib.sha256(payload).hexdigest()
        if digest and actual != digest:
            kind, reason = "gap", "payload digest differs"
        digest = actual
    return (
        kind, reason, _number(headers.get("warc-record-id", "")), headers.get("warc-target-uri"),
        size, digest, _number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
        payload,
    )


def round_trip(pages: DataFrame, name: str = "warc", **options) -> DataFrame:
    """Writes all rows to archives in the shared folder and reads the archives back."""
    spark = pages.sparkSession
    folder = work_folder(spark, name)
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
