"""WARC archives of pages: a deduplicating writer and a salvage reader.

Of pages with equal payloads the one with the largest id is written as a response,
the others as revisits that refer to it; they hold HTTP headers alone. Each record is
a gzip member of its own.

The reader walks an archive record by record. Where a check fails (gzip's checksum,
the version line, the length, the block digest) it logs a quarantined gap and
searches on for the next gzip member that inflates to a version line, or for the
next plain version line, so that later records are recovered. In a member of several
records only the failing ones go, and of a damaged or cut one what stands before the damage is kept. It reads forward in
bounded pieces and holds one record at a time (and records without a digest up to the end of their member).

Archives have names of their own for each attempt at a task, since the order of rows
behind a shuffle differs between attempts; a list names the archives of the attempts
that counted, and only these are read. A folder without a list is read whole.

Control characters of a url are percent-encoded. Null html is an empty payload. Rows
that repeat both id and payload are all responses if theirs is the largest id; a null
id counts as the smallest and refers to the others' largest. An empty table leaves an
empty folder, which reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.llm._arrow import slices
from quadloom.llm._shared import cut, open_fs, put, work_dir, write_file

#: Size at which a task starts its next archive.
ARCHIVE = 64 << 20
LEVEL = 5
PIECE = 256 << 10
#: First bytes in which a header's end is looked for, and longest record that is read: a cell holds no more.
HEAD, RECORD = 64 << 10, (2 << 30) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: File that names the archives that count.
LIST = "archives.txt"
GZIP = b"\x1f\x8b\x08"
#: Fields that every record has, and bytes that no header has.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f]")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Lengths of up to 18 digits; longer ones are no lengths.
LENGTH = re.compile(r"[0-9]{1,18}")


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    """Quarantined bytes [offset, end)."""

    offset: int
    end: int
    reason: str


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# writing


def decisions(pages: DataFrame, id_col: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """pages with columns __sha1, __bytes and __first: the id of the response that a revisit refers to, else null.

    The largest id of each digest that repeats is found by partial aggregation. Digests of more
    than a task's share of the pages, fewer than tasks, are looked up in a broadcast table; the others
    join by shuffle.
    """
    data = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("__sha1", F.sha1(data.cast("binary"))).withColumn("__bytes", F.octet_length(data).cast("long"))
    slots = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = cut(rows.where(F.col("__bytes") >= least).groupBy("__sha1").agg(F.max(id_col).alias("__largest"), F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    share = max(1, pages.count() // slots)
    hot, rest = F.broadcast(shared.where(F.col("__n") > share).drop("__n")), shared.where(F.col("__n") <= share).drop("__n")
    joined = rows.join(hot, "__sha1").unionByName(rows.join(hot, "__sha1", "left_anti").join(rest, "__sha1", "left"))
    return joined.withColumn("__first", F.when(~F.col("__largest").eqNullSafe(F.col(id_col)), F.col("__largest"))).drop("__largest")


def record(page_id: int | None, url: str | None, html: str | None, sha1: str, size: int, first: int | None) -> bytes:
    digest, data = f"sha1:{base32(sha1)}", (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + data if first is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        *([] if first is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]),
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, uri: str) -> DataFrame:
    """rows: id, url, payload, sha1, bytes, first. A row (archive, records) for each archive that a task writes; see list_archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(uri)
        part, number, out, records, draft = TaskContext.get().partitionId(), 0, None, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{part:06d}-{number:03d}-{uuid.uuid4().hex}.warc.gz"
            put(store, draft, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records]})

        for batch in slices(batches, 2):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    draft = f"{folder}/_{part:06d}-{number:03d}-{uuid.uuid4().hex}.tmp"
                    out, records = store.open_output_stream(draft), 0
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(squeeze.compress(record(*row)) + squeeze.flush())
                records += 1
                if out.tell() >= ARCHIVE:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "archive string, records long")


def list_archives(written: DataFrame, uri: str) -> None:
    """Writes down which archives of the folder count: a name for each ARCHIVE bytes passes the driver."""
    names = sorted(r["archive"] for r in written.select("archive").collect())
    write_file(f"{uri}/{LIST}", ["\n".join(names).encode()])


# reading


class Bad(NamedTuple):
    """Why nothing more can be read at a place."""

    reason: str


def walk(read: Callable[[int, int], bytes], size: int) -> Iterator[Record | Gap]:
    """Records and gaps of an archive of size bytes; read(offset, n) gives bytes of it."""
    at = 0
    while at < size:
        for found in items_at(read, at, size):
            if isinstance(found, Bad):
                end = at + 1
                while end < size:
                    end = _candidate(read, end, size)
                    if end < size and not isinstance(next(items_at(read, end, size)), Bad):
                        break
                    end += 1
                end = min(end, size)
                yield Gap(at, end, found.reason)
                at = end
            elif isinstance(found, int):
                at = found
            else:
                yield found


def _candidate(read: Callable[[int, int], bytes], at: int, size: int) -> int:
    """The next offset where a gzip member or a version line may begin, or size."""
    while at < size:
        piece = read(at, PIECE + 16)
        places = [p for p in (piece.find(GZIP), *(m.start() for m in [VERSION.search(piece)] if m)) if p >= 0]
        if places and min(places) < PIECE:
            return at + min(places)
        at += PIECE
    return size


def items_at(read: Callable[[int, int], bytes], at: int, size: int) -> Iterator[Record | Gap | int | Bad]:
    """What stands at offset at: its records, its inner gaps, and the offset behind it, or what is wrong with the rest of it."""
    head = read(at, 16)
    if head.startswith(GZIP):
        yield from _member(read, at)
        return
    if not VERSION.match(head):
        yield Bad("no gzip member or version line")
        return
    buffer = read(at, min(HEAD, size - at))
    while b"\r\n\r\n" not in buffer and len(buffer) < min(RECORD, size - at) and not CONTROL.search(buffer):
        more = read(at + len(buffer), min(len(buffer), size - at - len(buffer)))
        if not more:
            break
        buffer += more
    headers, begin = _headers(buffer)
    if headers is None:
        yield Bad("damaged headers")
        return
    length = int(headers["content-length"])
    if length > RECORD or at + begin + length > size:
        yield Bad("record is cut off")
        return
    block = read(at + begin, length)
    if reason := _wrong(headers, block):
        yield Bad(reason)
        return
    end = at + begin + length
    yield Record(at, headers, block)
    yield end + (4 if read(end, 4) == b"\r\n\r\n" else 0)


def _member(read: Callable[[int, int], bytes], at: int) -> Iterator[Record | Gap | int | Bad]:
    """A gzip member's records, inflated piece by piece.

    A record that fails a check is skipped up to the next version line that begins a whole
    record, and noted as a gap of the member that names the inflated bytes. Where the member is damaged or cut off, the
    records before that are kept: after damage those with a block digest, which vouches for
    them; others might be wrong bytes that inflated all the same.
    """
    inflate, place, failed = zlib.decompressobj(31), at, ""
    buffer, behind, skipped = bytearray(), 0, None  # behind: inflated bytes before the buffer; skipped: start and reason of an inner gap
    inner: list[str] = []
    unsure: list[Record] = []
    begun = False
    while not inflate.eof and not failed:
        piece = read(place, PIECE)
        if not piece:
            failed = "gzip member is cut off"
        place += len(piece)
        more, error = _inflated(inflate, piece)
        buffer += more
        failed = failed or (error and f"gzip member is damaged: {error}")
        if not begun:
            if not VERSION.match(buffer[:16]):
                yield Bad(failed or "gzip member without version line")
                return
            begun = True
        begin, last = 0, bool(inflate.eof or failed)
        while begin < len(buffer):
            found = _record(buffer, begin, at, last)
            if isinstance(found, tuple):
                if skipped:
                    inner.append(f"inflated bytes {skipped[0]} to {behind + begin}: {skipped[1]}")
                    skipped = None
                record, begin = found
                if "warc-block-digest" in record.headers:
                    yield record
                else:
                    unsure.append(record)
                continue
            if found is None:  # the rest of the record is still to come
                break
            skipped = skipped or (behind + begin, found)
            ahead = VERSION.search(buffer, begin + 1)
            begin = ahead.start() if ahead else len(buffer) if last else max(begin + 1, len(buffer) - 16)
            if not ahead and not last:
                break
        behind += begin
        del buffer[:begin]
    if not failed or failed == "gzip member is cut off":
        yield from unsure
    if failed:
        yield Bad(failed)
        return
    place -= len(inflate.unused_data)
    if skipped:
        inner.append(f"inflated bytes {skipped[0]} to {behind + len(buffer)}: {skipped[1]}")
    for reason in inner:
        yield Gap(at, place, reason)
    yield place


def _inflated(inflate, piece: bytes) -> tuple[bytes, str]:
    """What piece inflates to, up to where it is damaged, and the damage."""
    before = inflate.copy()
    try:
        return inflate.decompress(piece), ""
    except zlib.error as e:
        out, error, step = bytearray(), str(e), 4096
        for k in range(0, len(piece), step):
            held = before.copy()
            try:
                out += before.decompress(piece[k : k + step])
            except zlib.error:
                before = held
                for j in range(k, min(k + step, len(piece))):
                    try:
                        out += before.decompress(piece[j : j + 1])
                    except zlib.error:
                        break
                break
        return bytes(out), error


def _record(buffer: bytearray, begin: int, at: int, last: bool) -> tuple[Record, int] | str | None:
    """The record at begin and where it ends, or what is wrong; None if more must be inflated first."""
    head = buffer[begin : begin + 16]
    if not VERSION.match(head):
        return None if len(head) < 16 and not last else "no version line"
    if buffer.find(b"\r\n\r\n", begin) < 0 and not last and len(buffer) - begin < RECORD and not CONTROL.search(buffer, begin):
        return None
    headers, start = _headers(buffer, begin)
    if headers is None:
        return "damaged headers"
    length = int(headers["content-length"])
    if length > RECORD:
        return "record is too long"
    if start + length + 4 > len(buffer) and not last:
        return None
    block = bytes(buffer[start : start + length])
    if reason := _wrong(headers, block):
        return reason
    end = start + length
    return Record(at, headers, block), end + (4 if buffer[end : end + 4] == b"\r\n\r\n" else 0)


def _headers(buffer: bytes | bytearray, begin: int = 0) -> tuple[dict[str, str] | None, int]:
    """The headers of the record at begin, and where its block begins."""
    end = buffer.find(b"\r\n\r\n", begin)
    if end < 0:
        return None, 0
    try:
        lines = buffer[begin:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        return None, 0
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    whole = all(headers.get(k) for k in MANDATORY) and LENGTH.fullmatch(headers["content-length"]) and not CONTROL.search(buffer[begin:end])
    return (headers, end + 4) if whole else (None, 0)


def _wrong(headers: dict[str, str], block: bytes) -> str | None:
    """What the block fails; a SHA-1 digest may be in base 32 or hexadecimal, in any case."""
    if len(block) != int(headers["content-length"]):
        return "block is cut off"
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    have = hashlib.sha1(block).hexdigest()
    if kind.strip().lower() == "sha1" and want.strip().upper().rstrip("=") not in (base32(have), have.upper()):
        return "block digest differs"
    return None


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def partitions(self) -> list[InputPartition]:
        store, folder = open_fs(self.uri)
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith((".warc.gz", ".warc"))]
        if store.get_file_info(f"{folder}/{LIST}").type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/{LIST}") as source:
                listed = set(source.read().decode().split("\n"))
            files = [f for f in files if f.path.rsplit("/", 1)[-1] in listed]
        return [Archive(f.path) for f in sorted(files, key=lambda f: (-f.size, f.path))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_fs(self.uri)
        held, size = [], 0
        with store.open_input_file(partition.path) as file:
            for x in walk(lambda at, n: file.read_at(n, at), file.size()):
                name = partition.path.rsplit("/", 1)[-1]
                held.append((name, x.offset, None, None, x.end, x.reason) if isinstance(x, Gap) else (name, x.offset, x.headers, x.block, None, None))
                size += 0 if isinstance(x, Gap) else len(x.block)
                if size >= 4 << 20 or len(held) >= 4096:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


class WarcSource(DataSource):
    """spark.read.format("quadloom_warc").load(folder): records, and gaps (those with gap_end) of the folder's archives."""

    @classmethod
    def name(cls) -> str:
        return "quadloom_warc"

    def schema(self) -> str:
        return "archive string, offset long, headers map<string,string>, block binary, gap_end long, gap_reason string"

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    archive, offset, headers, block, end, reason = zip(*held, strict=True)
    maps = pa.array([None if h is None else list(h.items()) for h in headers], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(offset, pa.int64()), maps, pa.array(block, pa.binary()), pa.array(end, pa.int64()), pa.array(reason, pa.string())], ["archive", "offset", "headers", "block", "gap_end", "gap_reason"])


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("quadloom_warc").load(uri)


def gaps(archives: DataFrame) -> DataFrame:
    """Quarantined bytes: archive, offset, gap_end, gap_reason."""
    return archives.where("gap_end is not null").select("archive", "offset", "gap_end", "gap_reason")


def pages_of(archives: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to. With whole a gap is an error."""
    head = lambda name: F.col("headers")[name]
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    http = F.substring(F.col("block"), 1, 256).cast("string")
    said = F.concat_ws(" ", F.lit("gap in"), "archive", F.lit("at"), "offset", "gap_reason")
    # one condition: a second one, that there is no gap, would be tested first
    record = F.when(F.col("gap_end").isNull(), True).otherwise(F.raise_error(said).cast("boolean") if whole else False)
    return archives.where(record).select(
        number(head("warc-record-id")).alias("page_id"),
        F.regexp_extract(http, r"(?i)\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("payload_bytes"),
        F.substring(head("warc-payload-digest"), 6, 32).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        number(F.coalesce(head("warc-refers-to"), F.lit(""))).alias("refers_to"),
    )


def store_and_read(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes pages to archives in a new shared folder and reads their records back; a gap in them is an error."""
    uri = work_dir(pages.sparkSession, "warc")
    rows = decisions(pages.select(id_col, url, payload), id_col, payload, least)
    list_archives(write_archives(rows.select(F.col(id_col).cast("long"), url, payload, "__sha1", "__bytes", F.col("__first").cast("long")), uri), uri)
    return pages_of(read_archives(pages.sparkSession, uri), whole=True)


#: The rows of store_and_read over pages, in DuckDB's SQL.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i // 4)::INT * 5, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END::BIGINT AS refers_to
FROM d
"""
