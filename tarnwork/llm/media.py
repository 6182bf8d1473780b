"""Interleaved text and media: HTML to ordered items, and media payloads resolved by digest.

A page's items are texts and media references in document order, each with its position; a reference carries its
caption (the figcaption of its figure, else its alt or title). Payloads live in a table keyed by the SHA-256 of their
bytes, each stored once a task at least; references find them by a join on the digest, whose payload side has one
narrow row a digest, so that a payload that very many pages show is decoded where it is stored and not where it is used.

``store_text`` makes media of texts: UTF-8 padded with blanks to a positive multiple of 192, as the samples of an
8-bit grey PNG of 192 columns. Several documents share a page, a paragraph and a captioned figure each; which facts are
whose is told by the place of the media item among its page's, so text and media must stay in order.

Rows: null HTML or text is empty. Repeated rows give repeated items. Equal texts have equal digests and values. A very
long text closes its page. A reference without a stored payload stays, with nulls. An empty table gives no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

WIDTH = 192
SCHEME = "media:sha256:"
_MEDIA = {"img", "video", "audio", "source", "embed", "iframe", "object"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "figure", "header", "footer", "nav", "main", "br", "hr", "body", "title"}
_SILENT = {"script", "style", "noscript", "template"}
#: Digests that a task remembers as stored already (others are stored again, and met once); documents on a page.
REMEMBERED, PAGE = 200_000, 8
ITEMS = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
FACTS = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK or tag in _MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.caption = []
        if tag in _MEDIA:
            given = dict(attrs)
            ref = given.get("src") or given.get("data")
            if ref:
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": given.get("alt") or given.get("title")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure if self.figure is not None else len(self.items) :]:
                if item["kind"] == "media" and words:
                    item["caption"] = words
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """Items of a page in order, with positions from 0."""
    p = _Items()
    p.feed(page or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, items (and the columns to keep): the interleaved sequence of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "ref", "caption"))]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in (key, *keep)), pa.array([parse(x) for x in b["_html"].to_pylist()], kind)], [key, *keep, "items"])

    types = dict(pages.dtypes)
    return pages.select(key, *keep, F.col(html).alias("_html")).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in (key, *keep)) + f", items {ITEMS}")


def resolve(seqs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every media item of the sequences, its place among them (nth), and what facts holds under its digest; nulls if nothing."""
    kept = [c for c in seqs.columns if c != "items"]
    refs = seqs.select(*kept, F.posexplode(F.filter("items", lambda i: i["kind"] == "media")).alias("nth", "_i"))
    refs = refs.select(*kept, "nth", "_i.position", "_i.caption", F.when(F.col("_i.ref").startswith(SCHEME), F.substring_index("_i.ref", ":", -1)).alias("digest"))
    return refs.join(facts, "digest", "left")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0, then the samples
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of such a PNG; raises on anything else or a damaged one."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("unexpected layout")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return lines[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Mean, eight-bin histogram in thousandths, and the signs of 8 x 8 block means against the mean."""
    rows = samples.reshape(-1, WIDTH)
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    edges = np.arange(8) * len(rows) // 8
    sums = np.add.reduceat(rows.reshape(len(rows), 8, -1).sum(axis=2, dtype=np.int64), edges, axis=0)
    counts = np.maximum(np.diff([*edges, len(rows)]), 1) * (WIDTH // 8)
    blocks = sums / counts[:, None]
    mean = samples.sum(dtype=np.int64) / len(samples)
    return f"{mean:.3f}:{','.join(map(str, shares))}:{np.packbits(blocks > mean).tobytes().hex()}"


def store_text(docs: DataFrame) -> DataFrame:
    """page, html, documents, stored: pages that show the images of up to PAGE documents each; documents are listed in the
    order of their figures, and images (digest, media) stand with the page where a task stores them first."""
    listed = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())]))
    images = pa.list_(pa.struct([("digest", pa.string()), ("media", pa.binary())]))

    def run(batches):
        seen: set[str] = set()
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                html, documents, stored, size = [], [], [], 0
                while at < b.num_rows and len(documents) < PAGE and size < 1 << 22:
                    doc, raw = b["doc_id"][at].as_py(), (b["text"][at].as_py() or "").encode()
                    size += len(raw)
                    payload = raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)
                    digest = hashlib.sha256(payload).hexdigest()
                    caption = html_lib.escape(f"Document {doc}: {len(raw)} bytes of text")
                    html.append(f'<h2>Document {doc}</h2><p>As an image:<figure><img src="{SCHEME}{digest}" alt="text"><figcaption>{caption}</figcaption></figure>')
                    documents.append({"doc_id": doc, "n_bytes": len(raw)})
                    if digest not in seen:
                        stored.append({"digest": digest, "media": to_png(payload)})
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    at += 1
                number += 1
                row = (f"{task}-{number}", f"<title>{len(documents)} documents</title><article>{''.join(html)}</article>", documents, stored)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), listed, images))], ["page", "html", "documents", "stored"])

    kind = "page string, html string, documents array<struct<doc_id: bigint, n_bytes: bigint>>, stored array<struct<digest: string, media: binary>>"
    return staged(docs.select("doc_id", "text").mapInArrow(run, kind), "media")


def facts(stored: DataFrame) -> DataFrame:
    """FACTS of each stored payload: its bytes are read back from the stored form and checked against its digest."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, image in zip(b["digest"], b["media"]):
                image = image.as_py()
                payload = from_png(image)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest.as_py():
                    raise ValueError(f"stored media {digest.as_py()} does not hold its payload")
                rows.append((digest.as_py(), len(payload), sha, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if "bigint" in x else pa.string()) for i, x in enumerate(FACTS.split(", "))], names)

    return stored.select(F.explode("stored").alias("_s")).select("_s.*").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, page, position, caption and FACTS of every document's image."""
    stored = store_text(docs)
    # Facts as a table: the join then has an exchange of its own on either side, of which Spark splits a hot digest's.
    shown = resolve(sequences(stored, "page", keep=("documents",)), staged(facts(stored), "media-facts"))
    names = [x.split()[0] for x in FACTS.split(", ")]
    return shown.withColumn("_d", F.get("documents", "nth")).select("_d.doc_id", "_d.n_bytes", "page", "position", "caption", *names)
