"""Media columns: interleaved document sequences with payloads resolved by digest.

A page is parsed into an ordered sequence of structs: runs of text, and references to
media with their digest and caption, each with its position. Payloads are kept once for
each task and digest in a media table, as binary greymaps: a header and 8-bit samples,
lossless. ``payloads`` joins the stored bytes to references by digest; ``described``
reads the stored bytes back and computes their features where they lie, and
``resolved`` joins those few, so a payload that very many references share is not moved
to each of them. Positions and captions stay with their reference.

The query shows each document as a page: its paragraphs, with the figure of its payload
after the first one and the start of the text as caption.

Null and empty texts are a payload of 64 zero bytes, with an empty caption; repeated
rows, and rows with a null doc_id, are pages of their own and resolve to the same media;
a very long text is one payload and one page. A reference whose digest the media table
lacks stays, with null features. An empty table gives no rows. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, id_and_text, prepare, written

BLOCK = 64
CAPTION_CHARS = 80
SCHEME = "sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SKIPPED = {"script", "style", "noscript", "template"}


def padded(raw: bytes) -> bytes:
    """With zero bytes up to a positive multiple of BLOCK."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def greymap(raw: bytes) -> bytes:
    """A binary greymap (P5) whose samples are the padded bytes, BLOCK to a row; a comment holds the length before padding."""
    payload = padded(raw)
    return b"P5\n# %d\n%d %d\n255\n" % (len(raw), BLOCK, len(payload) // BLOCK) + payload


def samples(stored: bytes) -> tuple[int, bytes]:
    """(length before padding, payload) of a stored greymap."""
    magic, comment, sides, depth, payload = stored.split(b"\n", 4)
    width, height = map(int, sides.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * height:
        raise ValueError("not a greymap of 8-bit samples")
    return int(comment[2:]), payload


def features(stored: bytes) -> tuple:
    """What FEATURES names after the digest, from stored bytes."""
    n, payload = samples(stored)
    values = np.frombuffer(payload, np.uint8)
    bins = np.bincount(values >> 4, minlength=16)
    shape = f"w{BLOCK} h{len(values) // BLOCK} sum{int(values.sum(dtype=np.int64))} max{int(values.max())} steps{int(np.count_nonzero(values[1:] != values[:-1]))} h16:" + ",".join(map(str, bins))
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), shape


class _Sequence(HTMLParser):
    """Text runs and media references in reading order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.skip = self.caption = 0
        self.figure: list[int] = []
        self.words: list[str] = []

    def close_run(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.items.append(["text", text, None, None])
        self.run = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("img", "video", "audio", "source") and values.get("src"):
            self.close_run()
            src = values["src"]
            self.items.append(["media", src, src[len(SCHEME) :] if src.startswith(SCHEME) else None, values.get("alt")])
            self.figure.append(len(self.items) - 1)
        elif tag == "figure":
            self.close_run()
            self.figure = []
        elif tag == "figcaption":
            self.close_run()
            self.caption, self.words = 1, []
        elif tag not in ("b", "i", "em", "strong", "a", "span", "code", "sub", "sup", "small", "u"):
            self.close_run()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption:
            self.caption = 0
            for k in self.figure:
                self.items[k][3] = " ".join("".join(self.words).split()) or self.items[k][3]
        elif tag == "figure":
            self.figure = []
        elif tag in ("p", "div", "article", "section", "li", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "main", "body"):
            self.close_run()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption else self.run).append(data)


def sequence(html: str | None) -> list[dict]:
    """The interleaved sequence of a page, positions from 0."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.close_run()
    return [{"position": k, "kind": kind, "text": text, "digest": digest, "caption": caption} for k, (kind, text, digest, caption) in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items) of every page."""
    prepare(pages.sparkSession)
    shape = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(x) for x in batch.column(1).to_pylist()], shape)], ["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id long, items {SEQUENCE}")


def store(texts: DataFrame, what: str = "media") -> DataFrame:
    """Write (digest, stored) for (doc_id, text) rows, and read the table back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, bytes] = {}  # copies within a batch are stored once
            for raw in batch.column(1).to_pylist():
                seen.setdefault(digest_of(raw), greymap(raw or b""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], ["digest", "stored"])

    return written(texts.mapInArrow(run, "digest string, stored binary"), what)


def described(media: DataFrame) -> DataFrame:
    """FEATURES of each digest of a media table, read from its stored bytes; equal digests once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [x.split()[0] for x in FEATURES.split(", ")])

    names = [x.split()[0] for x in FEATURES.split(", ")][1:]
    rows = media.select("digest", "stored").mapInArrow(run, FEATURES)
    return written(rows.groupBy("digest").agg(*(F.any_value(n).alias(n) for n in names)), "media-features")


def resolved(references: DataFrame, features_table: DataFrame) -> DataFrame:
    """References (a written table with a digest) with the features of their media; a digest that very many share is dealt out."""
    return dealt_join(references, features_table, "digest", "left")


def payloads(references: DataFrame, media: DataFrame) -> DataFrame:
    """References (a written table with a digest) with the stored bytes of their media."""
    return dealt_join(references, media.groupBy("digest").agg(F.any_value("stored").alias("stored")), "digest", "left")


def digest_of(raw: bytes | None) -> str:
    """The name of a payload: the digest of its padded bytes, and their number before padding."""
    return f"{hashlib.sha256(padded(raw or b'')).hexdigest()}-{len(raw or b'')}"


def page(raw: bytes | None) -> str:
    """The page that shows a document: its paragraphs, and the figure of its payload after the first one."""
    text = (raw or b"").decode("utf-8", "replace")
    paragraphs = [f"<p>{escape(x, quote=False)}</p>" for x in text.split("\n\n")]
    caption = escape(" ".join(text[:400].split())[:CAPTION_CHARS], quote=False)
    figure = f'<figure><img src="{SCHEME}{digest_of(raw)}" alt=""><figcaption>{caption}</figcaption></figure>'
    return "<article>" + paragraphs[0] + figure + "".join(paragraphs[1:]) + "</article>"


def op8_media(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the place of the media in its page (position), its caption, and the page's items and texts."""
    prepare(docs.sparkSession)
    texts = id_and_text(docs)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page(t) for t in batch.column(1).to_pylist()], pa.string())], ["id", "html"])

    items = sequences(texts.mapInArrow(show, "id long, html string"), "id", "html")
    counted = items.select("id", F.size("items").alias("n_items"), F.size(F.filter("items", lambda i: i["kind"] == "text")).alias("n_texts"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i"))
    references = written(counted.select("id", "n_items", "n_texts", "i.position", "i.digest", "i.caption"), "media-references")
    found = resolved(references, described(store(texts)))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "n_texts")
