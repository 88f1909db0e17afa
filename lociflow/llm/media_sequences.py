"""Interleaved document sequences: HTML becomes ordered text and media-reference items, and a join on the digest
resolves the references against a content-addressed store of media.

Defined cases: a null or empty HTML text gives an empty sequence; a reference without a stored medium keeps its item with
null media columns; equal payloads share one digest and tie in nothing else; repeated documents keep their own rows; a text
of any length is one medium; an empty table gives an empty one; columns beside the named ones are left out because the
operator selects by name before it works.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, ship

#: Samples of a stored row; payloads are padded with zero bytes to a positive multiple of it.
WIDTH = 64
DEFLATE_LEVEL = 3
SCHEME = "sha256:"
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,media_digest:string,caption:string>"
FEATURES = "media_digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT_TAGS = frozenset("head noscript script style template title".split())
MEDIA_TAGS = frozenset("audio embed img source video".split())


def pad(data: bytes, width: int = WIDTH) -> bytes:
    return data + bytes(-len(data) % width if data else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes, `width` to a row."""
    if not payload or len(payload) % width:
        raise ValueError("a payload is a positive multiple of the row width")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = np.zeros((len(samples), width + 1), np.uint8)  # filter type 0 in front of each row
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), DEFLATE_LEVEL)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; every checksum is verified."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(data):
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("PNG chunk checksum")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only plain 8-bit grey images are stored")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return rows[:, 1:]


def fingerprint(samples: np.ndarray) -> str:
    """Average hash over the 64 column means, then the mean and the entropy of the samples."""
    columns = samples.mean(axis=0)
    bits = np.packbits(columns > columns.mean()).tobytes().hex()
    share = np.bincount(samples.reshape(-1), minlength=256) / samples.size
    share = share[share > 0]
    return f"{bits}:{samples.mean():.4f}:{-(share * np.log2(share)).sum():.4f}"


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.add("text", text=said)

    def add(self, kind: str, **x: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "media_digest": None, "caption": None} | x)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in MEDIA_TAGS and not self.silent:
            known = dict(attrs)
            if source := known.get("src") or known.get("data-src"):
                self.flush()
                self.add("media", media_digest=source.removeprefix(SCHEME), caption=(known.get("alt") or known.get("title") or None))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            for x in self.items[self.figure if self.figure is not None else len(self.items) :]:
                if x["kind"] == "media":
                    x["caption"] = said or x["caption"]
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page: text blocks and media references, each with its position; captions stay with the media of their figure."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, id_col: str, html_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, items): one row a page; items is an array in document order."""
    ship(pages.sparkSession)
    kept = [pages[c] for c in keep]
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pages.select(id_col, *kept).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media_digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            items = pa.array([parse_html(x.as_py()) for x in b.column(b.num_columns - 1)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], items], names=[*b.schema.names[:-1], "items"])

    return pages.select(id_col, *kept, F.col(html_col).alias("__html")).mapInArrow(parse, f"{kinds}, items array<{ITEM}>")


def media_features(store: DataFrame) -> DataFrame:
    """Read each stored medium back and describe its payload; one row a digest."""
    ship(store.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples = decode_png(media)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return store.where(F.col("media").isNotNull()).select("media_digest", "media").mapInArrow(read, FEATURES).dropDuplicates(["media_digest"])


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Join media columns to exploded items on the digest. `media` has one row a digest, so a popular medium makes only
    the items' side uneven; adaptive execution splits it if `media` comes straight from a table (see cut())."""
    return items.join(media, "media_digest", "left")


def illustrate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a medium beside a page that refers to it: (id, n_bytes, html, media_digest, media).

    A task stores a digest once; other tasks may store it again, with equal bytes.
    """
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sizes, pages, digests, media = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = pad(data)
                digest = hashlib.sha256(payload)
                media.append(None if digest.digest() in seen else encode_png(payload))
                seen.add(digest.digest())
                sizes.append(len(data))
                digests.append(digest.hexdigest())
                pages.append(f'<article><h1>Document {key}</h1><figure><img src="{SCHEME}{digests[-1]}" alt=""><figcaption>Bytes of document {key}</figcaption></figure><p>{len(data)} bytes</p></article>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=[b.schema.names[0], "n_bytes", "html", "media_digest", "media"])

    return documents.select(id_col, text_col).mapInArrow(store, f"`{id_col}` {kind}, n_bytes long, html string, media_digest string, media binary")


def document_media(documents: DataFrame) -> DataFrame:
    """Every whole text through the store and back, with the item that refers to it."""
    stored = cut(illustrate(documents), "media")
    parsed = sequences(stored, "doc_id", "html", keep=("n_bytes",))
    items = parsed.select("doc_id", "n_bytes", F.size("items").alias("n_items"), F.explode("items").alias("item")).where("item.kind = 'media'").select("doc_id", "n_bytes", "n_items", "item.position", "item.caption", "item.media_digest")
    return resolve(items, cut(media_features(stored), "media-features")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
