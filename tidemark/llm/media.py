"""Media columns: interleaved document sequences.

An HTML document becomes an ordered array of structs, either text or a reference to a media
object by digest. Payloads live in a media store keyed by that digest, and a digest join
resolves each reference, so position and caption stay beside the payload they belong to.
Payloads are stored as 8-bit grey images, whose samples are exactly the payload's bytes.

Defined cases: a null or empty text is an empty payload, padded to one block; repeated
payloads are stored once each time but resolve to one object; references without an object
keep null payload columns; null html yields an empty sequence; elements that are never closed
lose no text (scripts and styles do), and a tag that isn't closed within 64 K characters is text;
references are `data-digest` and `src` of img, audio, video and source only (not srcset, data-src,
poster or an object's data); extra columns of the input are ignored by the parser.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 576
WIDTH = 24
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_PNG = b"\x89PNG\r\n\x1a\n"


#: A tag is closed within so many characters, or its `<` is text.
TAG = 1 << 16


def _closed(text: str) -> str:
    """The text with each `<` that no `>` follows soon made plain text: looking for the end of every such
    tag again and again would take the square of a broken page's length."""
    out, end, until = [], None, len(text)
    for m in reversed(list(re.finditer("[<>]", text))):
        at = m.start()
        if text[at] == ">":
            end = at
        elif end is None or end - at > TAG:
            out += [text[at + 1 : until], "&lt;"]
            until = at
    out.append(text[:until])
    return "".join(reversed(out))


class _Figure:
    """An open figure: its captions, and the media in it that no inner figure has captioned."""

    def __init__(self):
        self.captions: list[dict] = []
        self.media: list[dict] = []


class _Interleaver(HTMLParser):
    """Collects text and media references in document order.

    A caption belongs to all media of its figure that have no caption of an inner figure, whether it
    stands before or after them; where there are none it is text. A caption that is never closed ends with
    its figure; without an end of that either it is its first block, and what follows is text. Hidden
    elements (template, noscript) that are never closed hide nothing. Items are added and marked, never
    moved, so the work is linear in the text."""

    HIDDEN = frozenset({"noscript", "template"})
    RAW = frozenset({"script", "style"})
    BREAK = frozenset({"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "figure", "figcaption"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.raw = 0
        self.hidden: list[int] = []  # items before each open hidden element
        self.figures: list[_Figure] = []
        self.caption: tuple[_Figure, list[dict]] | None = None  # the open caption's figure and texts

    def _add(self, kind: str, **more) -> dict:
        self.items.append({"kind": kind, "text": None, "ref": None, "caption": None} | more)
        return self.items[-1]

    def _flush(self):
        if text := " ".join("".join(self.parts).split()):
            x = self._add("text", text=text)
            if self.caption is not None:
                self.caption[1].append(x)
        self.parts = []

    def _end_caption(self):
        """The texts since the caption began are captions of its figure."""
        self._flush()
        if self.caption is not None:
            figure, said = self.caption
            for x in said:
                if x["kind"] == "text":
                    x["kind"] = "caption"
                    figure.captions.append(x)
            self.caption = None

    def _end_figure(self):
        figure = self.figures.pop()
        if self.caption is not None and self.caption[0] is figure:
            self._end_caption()
        said = " ".join(x["text"] for x in figure.captions if x["kind"] == "caption")
        media = [x for x in figure.media if x["kind"] == "media"] if said else figure.media
        for x in media if said else ():
            x["caption"] = said
        if said and not media:  # a caption of nothing is text
            self._add("text", text=said)
        if not said and self.figures:
            more, less = sorted((self.figures[-1].media, media), key=len, reverse=True)
            more += less
            self.figures[-1].media = more

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAK or tag in self.HIDDEN:
            self._flush()
        if tag in self.RAW:
            self.raw += 1
        elif tag in self.HIDDEN:
            self.hidden.append(len(self.items))
        elif tag == "figure":
            self.figures.append(_Figure())
        elif tag == "figcaption" and self.figures:
            self._end_caption()
            self.caption = self.figures[-1], []
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            if ref := (a.get("data-digest") or a.get("src")):
                self._flush()
                x = self._add("media", ref=ref, caption=a.get("alt") or None)
                if self.figures:
                    self.figures[-1].media.append(x)

    def handle_endtag(self, tag):
        if tag in self.BREAK:
            self._flush()
        if tag in self.RAW and self.raw:
            self.raw -= 1
        elif tag in self.HIDDEN and self.hidden:
            self.parts = []
            at = self.hidden.pop()
            for x in self.items[at:]:  # figures may still know of them
                x["kind"] = "hidden"
            del self.items[at:]
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self.figures:
            self._end_figure()

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)

    def result(self) -> list[dict]:
        self.close()
        self._flush()
        if self.caption is not None:  # neither it nor its figure has an end
            figure, said = self.caption
            said = [x for x in said if x["kind"] == "text"]
            for x in said[:1]:
                x["kind"] = "caption"
                figure.captions.append(x)
            self.caption = None
        while self.figures:
            self._end_figure()
        return [{"position": k, **x} for k, x in enumerate(x for x in self.items if x["kind"] != "caption")]


def interleave(text: str | None) -> list[dict]:
    """The ordered sequence of one HTML text."""
    if not text:
        return []
    p = _Interleaver()
    p.feed(_closed(text))
    return p.result()


def encode_image(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are the payload; its length is a multiple of the width."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (height x width) of an image that encode_image() wrote; checks every chunk."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written by this store")
    return rows[:, 1:], width


def pad_payload(text: bytes, block: int = BLOCK) -> bytes:
    n = max(1, -(-len(text) // block)) * block
    return text + b"\xff" * (n - len(text))


def sample_feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit average hash over an 8 x 8 grid of the image."""
    x = samples.astype(np.float64)
    edges = np.linspace(0, x.shape[0], 9).astype(int)
    bands = np.stack([x[a : max(b, a + 1)].mean(0) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    grid = bands.reshape(8, 8, -1).mean(2)
    bits = int("".join("1" if v > grid.mean() else "0" for v in grid.ravel()), 2)
    return f"m{x.mean():.3f};s{x.std():.3f};a{bits:016x}"


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, html, media_digest, media, n_bytes): each whole text as a stored image and the page
    that refers to it by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            buf, off = common.flat_text(texts)
            for i, j in common.spans(off, 4 << 20):
                cols: list[list] = [[], [], [], []]
                for k in range(i, j):
                    raw = buf[off[k] : off[k + 1]].tobytes()
                    media = encode_image(pad_payload(raw))
                    digest = hashlib.sha256(media).hexdigest()
                    title = htmllib.escape(raw[:48].decode("utf-8", "ignore"))
                    page = f'<p>{title}</p><figure><img data-digest="{digest}"><figcaption>{len(raw)} bytes</figcaption></figure>'
                    for c, v in zip(cols, (page, digest, media, len(raw)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())],
                    names=["id", "html", "media_digest", "media", "n_bytes"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(common.tidy(run), "id long, html string, media_digest string, media binary, n_bytes long")


def parse_sequences(pages: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, sequence): the ordered text and media structs of each HTML column."""

    def run(batches):
        for batch in batches:
            seq = [interleave(x) for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, kind)], names=["id", "sequence"])

    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(common.tidy(run), f"id {dict(src.dtypes)['id']}, sequence {SEQUENCE}")


def read_media(store: DataFrame, digest_col: str = "media_digest", media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """Decodes stored objects and computes their features; one row per stored object."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                if hashlib.sha256(media).hexdigest() != digest:
                    raise ValueError(f"stored object {digest} is damaged")
                samples, _ = decode_image(media)
                payload = samples.tobytes()
                row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), common.crc32(payload[-32:]), len(media), sample_feature(samples), payload if with_payload else None)
                for c, v in zip(rows, row, strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["media_digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature", "payload"])

    src = store.select(F.col(digest_col).alias("media_digest"), F.col(media_col).alias("media"))
    return src.mapInArrow(common.tidy(run), "media_digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string, payload binary")


def references(sequences: DataFrame) -> DataFrame:
    """(id, position, caption, ref) of the media in sequences."""
    refs = sequences.select("id", F.explode("sequence").alias("s")).where(F.col("s.kind") == "media")
    return refs.select("id", F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.ref").alias("ref"))


def resolve(sequences: DataFrame, objects: DataFrame) -> DataFrame:
    """Joins media references to objects by digest: (id, position, caption, ref, object columns).

    Only digests, positions and the object's columns are shuffled. Digests that hold a larger share
    of the references than a quarter of a task's are few (four a task at most): their objects are
    broadcast, and their references stay where they are."""
    refs = common.materialize(references(sequences), "references")
    found = objects.withColumnRenamed("media_digest", "ref")
    counts = refs.groupBy("ref").count()
    total = refs.count()
    most = 4 * common.partitions(refs.sparkSession)
    hot = common.materialize(counts.where(F.col("count") > max(8, total / most)).select("ref"), "hot-digests")  # fewer than `most` rows
    near = F.broadcast(hot)
    rest = refs.join(near, "ref", "left_anti").join(found, "ref", "left")
    return rest.unionByName(refs.join(near, "ref", "left_semi").join(F.broadcast(hot.join(found, "ref", "left")), "ref", "left"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Stores every whole text, reads the stored bytes back and resolves each page's reference.

    The stored objects are written to the shared folder once and never shuffled: features are
    computed where the objects are read, and only digests and features meet in the join."""
    stored = common.materialize(store_payloads(docs), "media", "uncompressed")
    pages = stored.select("id", "html", "n_bytes")
    found = read_media(stored).drop("payload").dropDuplicates(["media_digest"])
    linked = resolve(parse_sequences(pages), found)
    return linked.select(
        F.col("id").alias("doc_id"),
        F.regexp_extract("caption", r"^(\d+)", 1).cast("long").alias("n_bytes"),
        "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("ref").alias("media_sha256"), "feature", "position", "caption",
    )
