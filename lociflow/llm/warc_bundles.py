"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames; a seek table in a skippable frame ends each bundle, so that any
frame can be read alone. An index table maps record identifiers to bundle, frame and offset within the frame; all reading
goes by it.

Payloads are not shuffled unless another page may have an equal one: a blocked Bloom filter of the digests that occur
again passes those to an exact join.

Bundles are written and read by pyarrow's file systems in Python workers, so the shared folder must be one that they know
(local or mounted, hdfs, s3, gs; `s3a` is taken for `s3`).

Defined cases: a null payload is empty; payloads shorter than `least` never become revisits; rows that share the
smallest identifier of a digest are all responses; a null identifier is written as `null` and never the first of others;
rows of one identifier are told apart by a number after it, so each record's name is its own; a payload may have any
length, and a frame then holds it alone; an empty table gives no bundle and no row; columns beside page_id, url and html
are left out; bundles are written under a temporary name and moved when whole, with a name of its own for each attempt,
and only those that a finished task reports count.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, file_system, new_folder, ship
from lociflow.llm.url_filter import build_filter, maybe_listed

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
LEAST_REVISIT = 100
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, copy long, bundle string, frame int, frame_offset long, record_bytes long"
RECORD = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long"


def record_urn(key: int | None, copy: int = 0) -> str:
    """Name of a record; `copy` tells the rows of one identifier apart."""
    return f"<urn:x-page:{'null' if key is None else key}{f':{copy}' if copy else ''}>"


def warc_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which tells the payload's full length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(key, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, header fields in lower case, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if frame[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield at, start + size + 4 - at, fields, frame[start : start + size]
        at = start + size + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *x) for x in frames) + struct.pack("<IBI", len(frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(compressed, uncompressed, checksum) of each frame, from a bundle or its last bytes."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums")
    size = 12 * count + 9
    if struct.unpack("<II", tail[-size - 8 : -size]) != (SKIPPABLE_MAGIC, size):
        raise ValueError("the seek table's frame is broken")
    return [struct.unpack_from("<III", tail, len(tail) - size + 12 * i) for i in range(count)]


def open_frame(packed: bytes, entry: tuple[int, int, int]) -> bytes:
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, entry[1]))
    if len(data) != entry[1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry[2]:
        raise ValueError("frame checksum")
    return data


class BundleWriter:
    """Writes bundles into a folder that every executor sees; rows() gives the index of what is on disk."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
        self.files, self.folder = file_system(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.done = None, []
        self.frame, self.size, self.pending = [], 0, []

    def add(self, key: int | None, copy: int, record: bytes) -> None:
        self.pending.append((key, copy, self.size, len(record)))
        self.frame.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.frame:
            return
        if self.out is None:
            self.name, self.written, self.frames, self.rows = f"bundle-{uuid.uuid4().hex}.warc.zst", 0, [], []
            self.out = self.files.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
        data = b"".join(self.frame)
        packed = self.packer.compress(data)
        self.rows += [(key, copy, self.name, len(self.frames), at, n) for key, copy, at, n in self.pending]
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)
        self.written += len(packed)
        self.frame, self.size, self.pending = [], 0, []
        if self.written >= self.bundle_bytes:
            self.end_bundle()

    def end_bundle(self) -> None:
        self.end_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.files.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
            self.done += self.rows
            self.out = None

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], names=[n for n, _ in columns])


def write_bundles(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write `records` (record_id, copy, url, payload binary, payload_digest, refers_to) and return the index table, itself on
    disk."""
    ship(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter(folder, frame_bytes, bundle_bytes)
        for b in batches:
            for key, copy, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.add(key, copy, warc_record(key, url, payload or b"", digest, first, date, copy))
            if done := out.take():
                yield _batch(done, INDEX)
        out.end_bundle()
        if done := out.take():
            yield _batch(done, INDEX)

    chosen = records.select("record_id", "copy", "url", "payload", "payload_digest", "refers_to")
    return cut(chosen.mapInArrow(write, INDEX), "warc-index")


class BundleReader:
    """Reads records by their index entries: a bundle's seek table once, a frame once for entries in order."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = file_system(folder)
        self.name = self.source = self.frame = None

    def open(self, bundle: str) -> None:
        self.close()
        self.name, self.frame, self.source = bundle, None, self.files.open_input_file(f"{self.folder}/{bundle}")
        size = self.source.size()
        self.source.seek(size - 9)
        tail = 12 * struct.unpack("<IBI", self.source.read(9))[0] + 17
        self.source.seek(size - tail)
        self.entries = read_seek_table(self.source.read(tail))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def record(self, bundle: str, frame: int, offset: int, size: int) -> bytes:
        if bundle != self.name:
            self.open(bundle)
        if frame != self.frame:
            self.source.seek(self.starts[frame])
            self.data, self.frame = open_frame(self.source.read(self.entries[frame][0]), self.entries[frame]), frame
        return self.data[offset : offset + size]

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
        self.name = self.source = None


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record that `index` names, fetched by its entry, with checksums, names and digests verified. A bundle's entries
    are read in one task, in order; BUNDLE_BYTES bound what that is."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = BundleReader(folder)
        for b in batches:
            rows = []
            for key, copy, bundle, frame, offset, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (_, length, fields, block), *more = parse_records(source.record(bundle, frame, offset, size))
                if more or length != size or fields["warc-record-id"] != record_urn(key, copy):
                    raise ValueError("the index leads to another record")
                rows.append((*describe(fields, block), bundle, frame, offset))
            yield _batch(rows, RECORD)
        source.close()

    ordered = index.select("record_id", "copy", "bundle", "frame", "frame_offset", "record_bytes").repartition("bundle").sortWithinPartitions("bundle", "frame", "frame_offset")
    return ordered.mapInArrow(read, RECORD)


def describe(fields: dict[str, str], block: bytes) -> tuple:
    """(record_id, payload bytes, payload digest, type, refers_to) of a parsed record; a response's payload is hashed anew."""
    ident = lambda x: None if x is None or x.startswith("<urn:x-page:null") else int(re.fullmatch(r"<urn:x-page:(-?\d+)(:\d+)?>", x)[1])
    cutting = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"Content-Length: (\d+)", block[:cutting])[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(block) - cutting != size or hashlib.sha256(block[cutting:]).hexdigest() != digest):
        raise ValueError("payload digest")
    return ident(fields["warc-record-id"]), size, digest, fields["warc-type"], ident(fields.get("warc-refers-to"))


def read_record(folder: str, bundle: str, frame: int, frame_offset: int, record_bytes: int) -> bytes:
    """One record by its index entry: the seek table and the one frame are all that is read."""
    source = BundleReader(folder)
    try:
        return source.record(bundle, frame, frame_offset, record_bytes)
    finally:
        source.close()


def archive_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of pages, with refers_to where an equal payload has a smaller identifier."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    again = known.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("m")).where("m > 1")
    # written first: adaptive execution then splits the pages of a popular payload
    firsts = cut(again.select(F.col("payload_digest").alias("known_digest"), "first_id"), "first-payloads")
    probed = maybe_listed(known, *build_filter(firsts, "known_digest"), "payload_digest")
    single = probed.where("NOT maybe").withColumn("refers_to", F.lit(None).cast("long"))
    hits = probed.where("maybe").join(firsts, F.col("payload_digest") == F.col("known_digest"), "left")
    hits = hits.withColumn("refers_to", F.when(F.col("record_id") != F.col("first_id"), F.col("first_id")))
    columns = ["record_id", "url", "payload", "payload_digest", "refers_to"]
    return single.select(columns).unionByName(hits.select(columns)).withColumn("copy", F.lit(0).cast("long"))


def page_archive(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_bundles(told_apart(pages, archive_records(pages)), folder)
    return read_bundles(pages.sparkSession, folder, index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset")


def told_apart(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Number the records of identifiers that several pages have, or none: by a number of the row, which differs and means no
    more. Where all identifiers are different nothing is done but to count them."""
    ids = pages.groupBy(F.col("page_id").cast("long").alias("again_id")).agg(F.count("*").alias("m")).where("m > 1")
    ids = cut(ids.select("again_id"), "repeated-ids")
    if ids.isEmpty():
        return records
    numbered = records.join(ids, F.col("record_id").eqNullSafe(F.col("again_id")), "left").withColumn("again", F.col("again_id").isNotNull() | F.col("record_id").isNull())
    return numbered.withColumn("copy", F.when(F.col("again"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).cast("long")).drop("again_id", "again")
