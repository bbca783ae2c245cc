"""WARC: archives of gzip members, revisit records for equal payloads, and a salvage reader.

Archives are rows (archive, content) of bounded size. The reader takes such rows, whether
written here or by spark.read.format("binaryFile"). It checks every record (gzip checksum,
version line, headers, lengths, block and payload digests); after a failed check it searches for the next
member or version line that does pass, goes on there, and logs the bytes between as a gap.

Inside a member of many records it goes on likewise at the next version line of the unpacked bytes;
records and inner gaps have the member's offset and length, and an inner gap's reason names its
unpacked bytes. Of a member that is cut short or whose checksum or compressed data is wrong, the
records before the first that fails are kept (length: up to where unpacking ended) and the member
is a gap. Where its data is wrong but no record fails, nothing tells which header is hurt, and none is kept.

Defined cases for pages: a null html is an empty payload, a null url is written without a target
URI; among equal payloads the largest page_id is the response (repeated rows of it each), null
page_ids are smallest and are responses only where all are null; empty tables give no archives;
very long texts are written whole, each in a record and at most one over an archive's size; further columns are ignored. For archives: a null or empty content gives neither record nor gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from urllib.parse import quote

from tarnwick.llm.common import split_by_keys
from tarnwick.session import materialise

#: Bytes of compressed records after which an archive is closed.
ARCHIVE_BYTES = 2 << 20
#: Revisits are written for payloads of at least so many bytes.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that refers to `original` and has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(original))]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return _record(headers, http if revisit else http + payload)


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html with revisit and original, the page_id of the response among equal payloads.

    Payloads that come once are marked without a shuffle; those that come again are joined with the table of their
    keys, which is written, so that Spark can split a payload that a large share of all pages has.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("key"))
    first = keyed.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("key", "original"), "payloads")
    again, once = split_by_keys(keyed, first, "key")
    same = F.coalesce(F.col("page_id") == F.col("original"), F.col("original").isNull())
    again = again.join(first, "key", "left").select("page_id", "url", "html", F.coalesce("original", "page_id").alias("original"), (~same).alias("revisit"))
    return once.select("page_id", "url", "html", F.col("page_id").alias("original"), F.lit(False).alias("revisit")).unionByName(again)


def write_archives(decided: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): each task closes an archive when it has `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24] + ".warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"])

        info = member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        parts, size = [info], 0
        for batch in batches:
            for page_id, url, html, original, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(member(page_record(page_id, url, html.encode(), original, revisit)))
                size += len(parts[-1])
                if size >= most:
                    yield closed()
                    parts, size = [info], 0
        if len(parts) > 1:
            yield closed()

    return decided.select("page_id", "url", "html", "original", "revisit").mapInArrow(run, "archive string, content binary")


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the plain record at `at`; ValueError if a check fails."""
    line = VERSION.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    if not line or stop < 0:
        raise ValueError("no version line or no end of headers")
    headers = {}
    for row in data[line.end() : stop].split(b"\r\n"):
        key, sep, value = row.partition(b":")
        if not sep:
            raise ValueError("a header without a colon")
        headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = stop + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end of record where the length says")
    block = data[start:end]
    kind, _, said = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and said.upper() != digest(block):
        raise ValueError("the block digest differs")
    kind, _, said = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha1" and headers.get("warc-type") == "response" and said.upper() != digest(payload_of(headers, block)):
        raise ValueError("the payload digest differs")
    return end + 4, headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


#: Headers (None for a gap), block, and why it is a gap.
Part = tuple[dict[str, str] | None, bytes, str]


class Damaged(ValueError):
    """A member that is cut short or hurt, with the place where unpacking ended and the records kept of it."""

    def __init__(self, why: str, end: int, parts: list[Part]) -> None:
        super().__init__(why)
        self.end, self.parts = end, parts


def _partly(data: bytes, at: int) -> tuple[int, bytes]:
    """Where unpacking the member at `at` breaks off, and the bytes unpacked until there."""
    unpack, out, step = zlib.decompressobj(31), [], 4096
    while at < len(data):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            if step == 1:
                break
            unpack, step = before, 1
    return min(at, len(data)), b"".join(out)


def _inside(plain: bytes) -> list[Part]:
    """Records and gaps of a member's unpacked bytes."""
    parts, at, gap, why = [], 0, None, ""
    while at < len(plain):
        try:
            end, headers, block = _parse(plain, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            found = VERSION.search(plain, at + 1)
            at = found.start() if found else len(plain)
            continue
        if gap is not None:
            parts.append((None, b"", f"unpacked bytes {gap} to {at}: {why}"))
            gap = None
        parts.append((headers, block, ""))
        at = end
    if gap is not None:
        parts.append((None, b"", f"unpacked bytes {gap} to {len(plain)}: {why}"))
    return parts


def _before_damage(plain: bytes) -> tuple[list[Part], bool]:
    """The records up to the first that fails, and whether one does."""
    parts, at = [], 0
    while at < len(plain):
        try:
            at, headers, block = _parse(plain, at)
        except ValueError:
            return parts, True
        parts.append((headers, block, ""))
    return parts, False


def _next(data: bytes, at: int) -> tuple[int, list[Part]]:
    """End and records of the gzip member or plain record at `at`; ValueError if a check fails."""
    if data[at : at + 2] != b"\x1f\x8b":
        end, headers, block = _parse(data, at)
        return end, [(headers, block, "")]
    # Fed by growing pieces: what a member leaves of the last one is copied, not all that follows.
    unpack, out, until, step, view = zlib.decompressobj(31), [], at, 4096, memoryview(data)
    try:
        while until < len(data) and not unpack.eof:
            piece = view[until : until + step]
            out.append(unpack.decompress(piece))
            until, step = until + len(piece), min(2 * step, 1 << 20)
    except zlib.error as e:
        broke, plain = _partly(data, at)
        parts, located = _before_damage(plain)
        raise Damaged(str(e), broke, parts if located else []) from None
    plain = b"".join(out)
    if not unpack.eof:
        raise Damaged("the member is cut short", len(data), _before_damage(plain)[0])
    parts = _inside(plain)
    if not any(headers for headers, _, _ in parts):
        raise ValueError(parts[0][2] if parts else "an empty member")
    return until - len(unpack.unused_data), parts


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, length, headers, block, reason): a record, or with headers None a quarantined gap."""
    at, gap, why = 0, None, ""
    kept, until = [], 0  # of the last damaged member: its bytes can be stored as they are, and are searched again
    while at < len(data):
        try:
            end, parts = _next(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            if isinstance(e, Damaged):
                for headers, block, reason in e.parts:
                    yield at, e.end - at, headers, block, reason
                kept, until = (e.parts, e.end) if e.parts else (kept, until)
            found = STARTS.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if end <= until and data[at : at + 2] != b"\x1f\x8b" and parts[0] in kept:
            at = end
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        for headers, block, reason in parts:
            yield at, end - at, headers, block, reason
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


READ = "archive string, offset long, length long, kind string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, reason string"


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps (kind `gap`) of archives (archive or path, content).

    payload_bytes and payload_digest are those of the full payload: of a revisit, what its HTTP
    headers and its record headers say.
    """
    key = "archive" if "archive" in archives.columns else "path"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for offset, length, headers, block, reason in salvage(content or b""):
                    if headers is None:
                        rows.append((archive, offset, length, "gap", None, None, None, None, None, None, reason))
                        continue
                    kind, payload = headers.get("warc-type"), payload_of(headers, block)
                    n, sha = len(payload), headers.get("warc-payload-digest", "").removeprefix("sha1:") or digest(payload)
                    if kind == "revisit":
                        told = re.search(rb"(?im)^content-length:\s*(\d+)", block)
                        n, payload = int(told[1]) if told else None, None
                    rows.append((archive, offset, length, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), payload, n, sha, None))
                    size += len(payload or b"")
                    if size > 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return archives.select(key, "content").mapInArrow(run, READ)
