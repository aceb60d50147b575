"""WARC: a converter from legacy ARC archives.

ARC files are parsed by the header line that their version block declares (version 1 has
five fields, version 2 ten) and by declared lengths, never by searching for boundaries. Each
record becomes a WARC record with a synthesised identifier, timestamp, type and digests.
Of records with equal payloads one is the response and the others are revisits that refer to
it. Archives are rows of gzip members in a table of the shared folder, so that executors can
write and read them on any storage Spark can.

Each archive is parsed where it lies: only a row for each digest of each archive is shuffled to find
the originals, and each archive is sent its answers.

Archives may be plain or compressed (gzip members or one zstd frame). A URL may hold spaces;
records that aren't HTTP (such as `text/dns`) become resources with their own content type;
HTTP headers may end lines with bare newlines, and header lines without a colon are kept
but not read. Declared lengths that the file doesn't hold are an error.

Defined cases: null html is an empty payload; a null url is `-`; payloads smaller than
`min_bytes` are all responses; of repeated rows that hold the largest page_id of a payload
each is a response; a null page_id stays null and never wins. Record ids are unique, whatever the
page_ids. A revisit whose HTTP header doesn't tell the length has null payload_bytes. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVE_BYTES = 8 << 20
CRAWL_TIME = datetime(2024, 1, 1, tzinfo=timezone.utc)
_PAGE_ID = "X-Page-Id"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{_PAGE_ID}: {'-' if page_id is None else page_id}\r\n\r\n"
    return head.encode() + payload


def write_arc(records: list[tuple[str, bytes]], version: int = 1, when: datetime = CRAWL_TIME) -> bytes:
    """An ARC file of (url, HTTP response) records, with its version block."""
    stamp, out = when.strftime("%Y%m%d%H%M%S"), io.BytesIO()

    def record(url: str, kind: str, body: bytes):
        url = "".join(url.split()) or "-"
        line = [url, "0.0.0.0", stamp, kind]
        if version == 2:
            line += ["200", hashlib.md5(body).hexdigest(), "-", str(out.tell()), "made.arc"]
        out.write(" ".join([*line, str(len(body))]).encode() + b"\n" + body + b"\n")

    record("filedesc://made.arc", "text/plain", f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n".encode())
    for url, body in records:
        record(url, "text/html", body)
    return out.getvalue()


def inflate(data: bytes) -> bytes:
    """The plain bytes of an archive that may be compressed."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompress(data)
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data.lstrip(b"\0\r\n")
    return b"".join(out)


class ArcError(ValueError):
    """What is wrong with an ARC file, and where."""

    def __init__(self, at: int, what: str):
        super().__init__(f"ARC record at byte {at}: {what}")


#: A header line is anchored on the address and the 14 digits of the date: URLs and content types may hold
#: spaces (`text/html; charset=utf-8`). Version 2 has five more fields before the length.
_ARC_LINE = {v: re.compile(r"(.*) ([0-9A-Fa-f.:]+|-) ([0-9]{14}) (.*?)" + r" (\S+)" * n + r" (\S+)") for v, n in ((1, 0), (2, 5))}


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file by its declared fields and lengths; ArcError where it can't be read."""
    data = inflate(data)
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(at, "the header line has no end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # between records
            at = end + 1
            continue
        if version is None:
            values = line.rsplit(" ", 1)
        else:
            found = _ARC_LINE[version].fullmatch(line)
            if not found:
                raise ArcError(at, f"the header line isn't one of version {version}: {line[:200]!r}")
            values = found.groups()
        if not re.fullmatch("[0-9]+", values[-1]):
            raise ArcError(at, f"the declared length is {values[-1][:40]!r}")
        n = int(values[-1])
        body = data[end + 1 : end + 1 + n]
        if len(body) != n:
            raise ArcError(at, f"it is shorter than the declared {n} bytes")
        if version is None:
            said = body.split(b"\n")
            first = said[0].split()
            version = int(first[0]) if first and first[0].isdigit() else None
            if len(said) < 2 or version not in ARC_FIELDS or said[1].decode("utf-8", "replace").split() != ARC_FIELDS[version].split():
                raise ArcError(at, "the archive's own header is of no known version")
        else:
            yield dict(zip(ARC_FIELDS[version].split(), values, strict=True)) | {"body": body}
        at = end + 1 + n
        at += data[at : at + 1] == b"\n"


def record_id(page_id: int | None, place: str) -> str:
    """A stable URN (UUID version 8): 58 bits are a hash of the record's place, so that records that
    share a page_id differ; the lowest 64 bits carry the page_id, or more of the hash without one."""
    own = int.from_bytes(hashlib.sha1(place.encode()).digest()[:16], "big")
    low = own & (1 << 64) - 1 if page_id is None else page_id & (1 << 64) - 1
    return uuid.UUID(int=(own >> 80) << 80 | 8 << 76 | (own >> 64 & 0x3FF) << 66 | low >> 62 << 64 | 2 << 62 | low & (1 << 62) - 1).urn


def page_of(urn: str) -> int:
    x = uuid.UUID(urn).int
    low = (x >> 64 & 3) << 62 | x & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), header bytes, payload of an HTTP response; of anything else
    no fields, no header and all of it."""
    if not body.startswith(b"HTTP/"):
        return {}, b"", body
    end = _HEAD_END.search(body)
    cut = end.end() if end else len(body)
    fields = (x.partition(":") for x in body[:cut].decode("utf-8", "replace").splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, colon, v in fields if colon}, body[:cut], body[cut:]


def warc_date(stamp: str) -> str:
    """The ISO form of an ARC date of 14 digits; shorter ones lack seconds or more, others are 1970."""
    digits = re.sub(r"\D", "", stamp)
    try:
        return datetime.strptime((digits + "0101000000"[len(digits) - 4 :] if 4 <= len(digits) < 14 else digits)[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def _member(lines: list[str], block: bytes) -> bytes:
    raw = "\r\n".join(["WARC/1.1", *lines, f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def warcinfo(place: str) -> bytes:
    """The first record of an archive."""
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(None, f'info {place}')}>", f"WARC-Date: {warc_date(CRAWL_TIME.strftime('%Y%m%d%H%M%S'))}", "Content-Type: application/warc-fields"], b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")


def warc_record(record: dict, urn: str, refers_urn: str | None = None) -> bytes:
    """One gzip member of an ARC record: a response, a revisit without the payload, or a resource."""
    _, head, payload = split_http(record["body"])
    block = head + (payload if refers_urn is None else b"")
    kind = "revisit" if refers_urn else "response" if head else "resource"
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {warc_date(record['Archive-date'])}", f"WARC-Target-URI: {record['URL']}", f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Content-Type: {'application/http; msgtype=response' if head else record['Content-type']}",
    ]
    if refers_urn:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_urn}>"]
    return _member(lines, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record; checks lengths and block digests."""
    while data:
        d = zlib.decompressobj(31)
        raw = d.decompress(data)
        data = d.unused_data
        cut = raw.index(b"\r\n\r\n") + 4
        fields = dict(x.split(": ", 1) for x in raw[: cut - 4].decode().split("\r\n")[1:])
        block = raw[cut : cut + int(fields["Content-Length"])]
        if len(raw) != cut + len(block) + 4 or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def to_arc(pages: DataFrame, version: int = 1) -> DataFrame:
    """(arc, data): legacy archives of a few MB each (in one zstd frame), made of page_id, url and
    html, and their numbers."""

    def run(batches):
        held, size, k, part = [], 0, 0, 0
        zip_ = zstandard.ZstdCompressor(level=3)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), common.binary_array([zip_.compress(write_arc(held, version))])], names=["arc", "data"])

        for batch in batches:
            for page_id, url, html, at in zip(*(batch.column(k) for k in range(4)), strict=True):
                part = at.as_py()
                body = http_response(page_id.as_py(), (html.as_py() or "").encode())
                held.append((url.as_py() or "-", body))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size, k = [], 0, k + 1
        if held:
            yield out()

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.spark_partition_id().alias("part"))
    return src.mapInArrow(common.tidy(run), "arc long, data binary")


def _page_id(fields: dict[str, str]) -> int | None:
    said = fields.get(_PAGE_ID.lower(), "-")
    return int(said) if re.fullmatch(r"-?\d+", said) else None


def arc_digests(arcs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, arc, page, k, n): of the records of each archive that share a payload the largest
    page_id, the place of the first that has it, and their number."""

    def run(batches):
        for batch in batches:
            for arc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best: dict[bytes, list] = {}
                for k, r in enumerate(read_arc(data.as_py())):
                    fields, _, payload = split_http(r["body"])
                    page = _page_id(fields)
                    if page is not None and len(payload) >= min_bytes:
                        old = best.setdefault(hashlib.sha1(payload).digest(), [page, k, 0])
                        if page > old[0]:
                            old[:2] = page, k
                        old[2] += 1
                cols = [pa.array([x[c] for x in best.values()], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([common.binary_array(list(best)), pa.array([arc] * len(best), pa.int64()), *cols], names=["digest", "arc", "page", "k", "n"])

    return arcs.select("arc", "data").mapInArrow(common.tidy(run), "digest binary, arc long, page long, k long, n long")


def convert(arcs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive): a WARC archive (gzip members) for each ARC archive (arc, data).

    The originals of payloads that several records hold are found from one row for each digest of
    each archive, so a payload that a large share of the records hold is one row an archive;
    then each archive is sent the originals of its own payloads."""
    rows = common.materialize(arc_digests(arcs, min_bytes), "digests")
    best = rows.groupBy("digest").agg(F.max(F.struct("page", "arc", "k")).alias("best"), F.sum("n").alias("n")).where("n > 1").select("digest", "best")
    answers = rows.join(best, "digest").groupBy("arc").agg(F.collect_list(F.struct("digest", "best.page", F.col("best.arc").alias("at"), "best.k")).alias("answers"))

    def run(batches):
        for batch in batches:
            for arc, data, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                arc, best = arc.as_py(), {x["digest"]: x for x in found.as_py() or []}
                out = [warcinfo(str(arc))]
                for k, r in enumerate(read_arc(data.as_py())):
                    fields, _, payload = split_http(r["body"])
                    page, refers = _page_id(fields), best.get(hashlib.sha1(payload).digest())
                    again = refers is not None and page is not None and page < refers["page"]
                    out.append(warc_record(r, record_id(page, f"{arc}/{k}"), record_id(refers["page"], f"{refers['at']}/{refers['k']}") if again else None))
                yield pa.RecordBatch.from_arrays([common.binary_array([b"".join(out)])], names=["archive"])

    return arcs.join(answers, "arc", "left").select("arc", "data", "answers").mapInArrow(common.tidy(run), "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per WARC record but the archives' own: page_id, payload_bytes, payload_digest,
    record_type, refers_to, record_id."""

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows: list[list] = [[] for _ in range(6)]
                for fields, block in read_warc(archive.as_py()):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
                    n = len(payload) if kind != "revisit" else int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                    refers = page_of(fields["WARC-Refers-To"][1:-1]) if kind == "revisit" else None
                    for c, v in zip(rows, (_page_id(http), n, digest, kind, refers, fields["WARC-Record-ID"][1:-1]), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])

    return archives.mapInArrow(common.tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def pages_to_warc(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """pages -> ARC -> WARC archives in the shared folder -> records read back."""
    with common.scratch(pages.sparkSession) as keep:
        return read_archives(keep(convert(common.materialize(to_arc(pages, version), "arc", "uncompressed"), min_bytes), "warc", "uncompressed"))


#: Base32 of a digest's bits, five at a time.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, max(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) AS best FROM p),
t AS (SELECT *, CAST(CAST(unhex(s) AS BIT) AS VARCHAR) AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) << CAST(4 - j AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < best THEN best END AS refers_to FROM t
"""
