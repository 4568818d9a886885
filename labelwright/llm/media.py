"""Media columns: interleaved document sequences.

`sequences` parses HTML into the ordered parts of a page: text, and references to media with their captions (figcaption,
else the alt text), each with its position; `resolve` joins references to a store of payloads by digest, so that
positions and captions stay with what they describe. A payload is kept losslessly as the samples of an 8-bit grey PNG of 192
columns (`png`, `samples`), each distinct one once per task, and once for all after the digest join.

Null HTML has no parts, a null text is an empty payload of one padded row; a reference without a stored payload keeps its
place with null features; rows with equal ids are treated each; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: What is not shown; a head needs no rule of its own, as it holds nothing else.
SKIPPED = {"script", "style", "template", "noscript", "title"}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
PART = "position int, kind string, text string, ref string, caption string, n_bytes long"


def padded(text: bytes, multiple: int = WIDTH) -> bytes:
    rows = max(1, -(-len(text) // multiple))
    return text.ljust(rows * multiple, b" ")


def png(samples: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of the samples, row by row without a filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)
    body[:, 1:] = rows

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body.tobytes(), 1)) + part(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that `png` made; raises ValueError for anything else or damaged."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, width, height = len(SIGNATURE), b"", 0, 0
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        part = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG")
        elif kind == b"IDAT":
            data += part
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation, distinct values and a histogram of 8 steps of the samples."""
    a = np.frombuffer(payload, np.uint8)
    steps = np.bincount(a >> 5, minlength=8)
    return f"{WIDTH}x{len(a) // WIDTH};mean={a.mean():.4f};std={a.std():.4f};distinct={len(np.unique(a))};hist={','.join(map(str, steps))}"


class Interleaved(HTMLParser):
    """Collects (kind, text, ref, caption, n_bytes) in the order of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list[Any]] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[list[int]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.parts.append(["text", text, None, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.figures.append([])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            own = dict(attrs)
            if own.get("src"):
                self.flush()
                size = own.get("data-bytes") or ""
                if self.figures:
                    self.figures[-1].append(len(self.parts))
                self.parts.append([MEDIA[tag], None, own["src"], own.get("alt") or None, int(size) if size.isdecimal() and len(size) < 19 else None])
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "br", "tr", "article", "section"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for i in self.figures[-1] if self.figures else []:
                self.parts[i][3] = words or self.parts[i][3]
        elif tag == "figure":
            self.flush()
            del self.figures[-1:]
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "tr", "article", "section"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parts(html: str) -> list[dict[str, Any]]:
    parser = Interleaved()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [dict(zip(("position", "kind", "text", "ref", "caption", "n_bytes"), (i, *p))) for i, p in enumerate(parser.parts)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and `parts`: the ordered text and media-reference structs of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))
        for whole in batches:
            for batch in common.slices(whole, "html"):
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([parts(h or "") for h in batch.column("html").to_pylist()], kind)], ["key", "parts"])

    kind = pages.select(F.col(key)).schema[0].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"key {kind}, parts array<struct<{', '.join(c.replace(' ', ':') for c in PART.split(', '))}>>").withColumnRenamed("key", key)


def resolve(sequenced: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """A row per media reference: key, the fields of the part, and the columns of its stored payload (one row per `digest`), but for those that are named as a field of the part."""
    part = ["position", "kind", "ref", "caption", "n_bytes"]
    store = store.select("digest", *(c for c in store.columns if c.lower() not in {"digest", key.lower(), *part}))
    refs = sequenced.select(key, F.explode("parts").alias("part")).filter("part.ref is not null").select(key, "part.position", "part.kind", "part.ref", "part.caption", "part.n_bytes", F.regexp_extract("part.ref", "^digest:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(store, "digest", "left")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, a page that shows the text's payload as an image with a caption, the digest of the stored form, and it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[str] = set()
            for batch in common.slices(whole):
                html, digests, images = [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    raw = (text or "").encode()
                    image = png(padded(raw))
                    digest = hashlib.sha256(image).hexdigest()
                    html.append(f'<article><p>Document</p><figure><img src="digest:{digest}" data-bytes="{len(raw)}"><figcaption>Text of {len(raw)} bytes</figcaption></figure></article>')
                    digests.append(digest)
                    images.append(None if digest in seen else image)
                    seen.add(digest)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(html), pa.array(digests), pa.array(images, pa.binary())], ["doc_id", "html", "digest", "image"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, html string, digest string, image binary")


def described(images: DataFrame) -> DataFrame:
    """One row per digest with the features of the payload that is read from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "image"):
                rows = []
                for digest, image in zip(batch.column("digest").to_pylist(), batch.column("image")):
                    image = image.as_py()
                    if hashlib.sha256(image).hexdigest() != digest:
                        raise ValueError(f"the stored bytes of {digest} have changed")
                    payload = samples(image)
                    rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), feature(payload)))
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    return images.filter("image is not null").select("digest", "image").mapInArrow(run, schema).dropDuplicates(["digest"])


def round_trip(docs: DataFrame) -> DataFrame:
    """Texts stored as media, referred to from pages, resolved by digest and read back: a row per document."""
    stored = common.materialise(documents_as_media(docs), "media")
    payloads = common.small(common.materialise(described(stored), "payloads"))
    found = resolve(sequences(stored, "doc_id", "html"), payloads, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")
