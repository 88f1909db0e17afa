"""Exact duplicates by composable polynomial fingerprints.

A text of bytes b has the fingerprint sum(b[i] * x ** i) modulo two primes below 2 ** 31. It is composable: a chunk that
begins at byte k adds its own fingerprint times x ** k, so the chunks of a huge document are hashed by different tasks and
summed in any order. A fingerprint counts with the text's length.

Equal fingerprints are not trusted. Every text of a group is compared with one text of the group, chunk by chunk, by a join on
(fingerprint, chunk number): no task holds a whole text, and adaptive execution splits a large group. Texts that differ from
it (a collision) form a group of their own and are compared again, until none is left.

Texts are read again for the comparison only where a fingerprint repeats: a blocked Bloom filter of those rows' keys passes
possible hits to an exact join, so other texts are not shuffled.

Defined cases: a null text counts as empty; a null identifier stays only where its group has no other; of rows alike in
identifier and text one stays; rows of one identifier and unlike texts are different documents; texts may have any length;
an empty table gives an empty one; columns beside the identifier and the text are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, passing, ship
from lociflow.llm.url_filter import build_filter, maybe_listed

#: Two primes, and the point at which each polynomial is taken.
PRIMES = (2**31 - 1, 2**31 - 19)
POINTS = (1_290_371_117, 871_345_631)
#: Bytes of a chunk: 2 ** 16 products below 2 ** 39 sum up below 2 ** 55. A task hashes a chunk; a larger text has several.
CHUNK = 1 << 16
SEED = 42


@cache
def powers(which: int) -> np.ndarray:
    """x ** 0 ... x ** (CHUNK - 1) of a polynomial; each step doubles what is known."""
    prime, out = PRIMES[which], np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.append(out, out * np.uint64(pow(POINTS[which], len(out), prime)) % np.uint64(prime))
    return out[:CHUNK]


def chunk_hash(data: bytes, at: int = 0) -> tuple[int, int]:
    """What the chunk that begins at byte `at` adds to a text's fingerprint."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    return tuple(int(np.dot(codes, powers(i)[: len(codes)])) % p * pow(POINTS[i], at, p) % p for i, p in enumerate(PRIMES))


def composed(parts: list[tuple[int, int]]) -> tuple[int, int]:
    """The fingerprint of a text from what its chunks add."""
    return tuple(sum(x[i] for x in parts) % p for i, p in enumerate(PRIMES))


def chunks(data: Column, size: int) -> Column:
    """Pieces of a binary column, one at least."""
    n = F.greatest(F.ceil(F.octet_length(data) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, size))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, bits: int = 62) -> DataFrame:
    """(row, id, key, n_bytes, f, sha256) of each document: a number of its own, a hash of identifier and text, and `bits` bits of
    the fingerprint. The numbers hold only as long as the table is not computed again: write it."""
    if not 0 < size <= CHUNK:
        raise ValueError(f"a chunk has 1 to {CHUNK} bytes, not {size}")
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [chunk_hash(x.as_py(), i * size) for i, x in zip(b.column(6).to_pylist(), b.column(7), strict=True)]
            f = np.array(own, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(f[:, 0]), pa.array(f[:, 1])], names=["row", "id", "key", "n_bytes", "sha256", "several", "f0", "f1"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    data, number = text.cast("binary"), F.monotonically_increasing_id() * 2
    told = [F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256")]
    short = documents.where(F.octet_length(text) <= size).select(number.alias("row"), *told, F.lit(False).alias("several"), F.lit(0).alias("i"), data.alias("chunk"))
    # numbered before they are cut: in one select the chunks would be numbered
    long = documents.where(F.octet_length(text) > size).select((number + 1).alias("row"), *told, data.alias("data"))
    long = long.select("row", "id", "key", "n_bytes", "sha256", F.lit(True).alias("several"), F.posexplode(chunks(F.col("data"), size)).alias("i", "chunk"))
    # the chunks of a long text go to other tasks
    each = f"row long, id {kind}, key long, n_bytes long, sha256 string, several boolean, f0 long, f1 long"
    parts = cut(short.mapInArrow(hashed, each).unionByName(long.repartition("row", "i").mapInArrow(hashed, each)), "chunk-hashes")
    whole = [F.pmod(F.sum(f"f{i}"), F.lit(p)).alias(f"f{i}") for i, p in enumerate(PRIMES)]
    summed = parts.where("several").groupBy("row", "id", "key", "n_bytes", "sha256").agg(*whole)
    f = F.shiftleft("f0", 31).bitwiseOR(F.col("f1")).bitwiseAND(F.lit((1 << bits) - 1))
    return parts.where("NOT several").drop("several").unionByName(summed).select("row", "id", "key", "n_bytes", f.alias("f"), "sha256")


def key_of(id_col: str, text_col: str) -> Column:
    """A hash by which a row's text is found again; rows alike in it share what they get."""
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def differing(pieces: DataFrame, members: DataFrame) -> DataFrame:
    """(key, n_bytes, f) of the `members` whose text is not that of their group's last member. `pieces` (key, i, chunk) has their
    texts."""
    groups = cut(members.groupBy("n_bytes", "f").agg(F.max(F.struct("id", "key"))["key"].alias("last")), "last-rows")
    named = cut(members.join(groups, ["n_bytes", "f"]).select("key", "n_bytes", "f", (F.col("key") == F.col("last")).alias("is_last")), "compared-rows")
    rows = cut(pieces.join(named, "key"), "compared-chunks")
    ends = rows.where("is_last").groupBy("n_bytes", "f", "i").agg(F.first("chunk").alias("other"))
    ends = cut(ends, "last-chunks")
    both = rows.where("NOT is_last").join(ends, ["n_bytes", "f", "i"])
    return both.where("chunk <> other").select("key", "n_bytes", "f").distinct()


def collisions(documents: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame | None:
    """(key, turn) of the rows whose text was found unlike an earlier one of the same fingerprint, or None: turn 1 holds those
    that are equal to the second text of their group, and so on."""
    # written, so that adaptive execution can split the rows of a large group
    several = cut(marked.groupBy("n_bytes", "f").agg(F.count("*").alias("m")).where("m > 1").select("n_bytes", "f"), "several")
    members = cut(marked.join(several, ["n_bytes", "f"]).select("key", "id", "n_bytes", "f").distinct(), "members")
    if members.isEmpty():
        return None
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    probed = maybe_listed(documents.select(key_of(id_col, text_col).alias("key"), text.alias("data")), *build_filter(members, "key"), "key").where("maybe")
    pieces = probed.select("key", F.posexplode(chunks(F.col("data"), size)).alias("i", "chunk"))
    found, turn = None, 0
    while True:
        apart = cut(differing(pieces, members), f"apart-{turn}")
        if apart.isEmpty():
            return found
        turn += 1
        members = cut(members.join(apart, ["key", "n_bytes", "f"], "left_semi"), f"members-{turn}")
        now = members.select("key", F.lit(turn).alias("turn"))
        found = now if found is None else cut(found.unionByName(now).groupBy("key").agg(F.max("turn").alias("turn")), f"turns-{turn}")


def exact_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, bits: int = 62) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each document. Of equal texts the largest identifier stays."""
    marked = cut(fingerprints(documents, id_col, text_col, size, bits), "fingerprints")
    with passing():
        found = collisions(documents, marked, id_col, text_col, size)
        found = None if found is None else cut(found, "turns", last=True)
    turned = marked.withColumn("turn", F.lit(0)) if found is None else cut(marked.join(found, "key", "left").withColumn("turn", F.coalesce("turn", F.lit(0))), "turned")
    groups = turned.groupBy("n_bytes", "f", "turn").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size"))
    groups = cut(groups.select("n_bytes", "f", "turn", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups")
    return turned.join(groups, ["n_bytes", "f", "turn"]).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def document_copies(documents: DataFrame) -> DataFrame:
    return exact_classes(documents).withColumnRenamed("id", "doc_id")
