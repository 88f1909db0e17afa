"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Such sets differ in a seventh of the bits of a SimHash fingerprint. A vantage-point tree can't help at that radius:
unrelated texts lie at half the bits, give or take a sixteenth, so no branch is ever excluded. So op8's vantage-point search
ties only the rows whose 64-bit fingerprints differ in 2 bits or fewer; beyond that the fingerprints serve as a filter, and all
links are exact:

1 candidates share a shingle of their prefixes (rare shingles first); no pair of the similarity is missed by that
2 fingerprints of BITS bits must not differ by more than MOST_BITS, which a pair of the similarity does less than once in
  10^9 times
3 what is left is decided by the exact intersection of the two sets

Texts are read again for step 3 only where a pair names them: a blocked Bloom filter of their keys passes possible hits to
an exact join, so the other texts are not shuffled. The same holds where rows are dropped.

A row is known by the two 64-bit hashes of its identifier and text; rows alike in both are repeats. Sets are equal if two
hashes of them are.

Defined cases: texts without words (null, blank) are copies of one another; a text of fewer words than a shingle is one
shingle; a text may be one unbroken run of any length; rows of one identifier and unlike texts are different documents;
of a class the smallest identifier stays, of equal identifiers the smaller hash, of repeats one, and a null identifier
only where there is no other; an empty table gives an empty one; columns of the documents are carried whole and can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, passing, ship, uniform
from lociflow.llm.simhash import components
from lociflow.llm.simhash import links as tree_links
from lociflow.llm.url_filter import build_filter, maybe_listed

SEED = 42
#: Words a shingle and least similarity (the code counts it as 4/5).
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and how many may differ. A pair of the similarity differs in 3/16 of the bits at most on average
#: (sets of 4 and 5 shingles, the worst case); the limit lies six standard deviations above that.
BITS, MOST_BITS = 256, 85
#: The same limit while single pairs are tried, where a miss costs nothing: pairs of the similarity lie at 39 bits on average.
NEAR_BITS = 56
#: Sets expected in the sample that tells common shingles (a sixteenth of all if that is more), the count that makes one
#: common, and how many common ones are told at most. They order the shingles and do not change what is found.
SAMPLE_SETS, OFTEN, COMMON = 8_192, 4, 1 << 19
#: Rows among which a bucket's row finds the one it meets in a turn.
NEIGHBOURS = 64
#: Orders of a turn, and bits by which the fingerprints are turned round from one to the next.
ORDERS, TURN = 2, 13
PAIR_ROWS = 250_000
#: Bits of a row's number within its task, and of a place in a prefix that goes with it (a later place counts as the last, which
#: only lets more pairs be tried). The rest is the task's number.
ROW_BITS, PLACE_BITS = 28, 12
#: Rows of one shingle that a task compares; the rows of a more frequent one are dealt in blocks of so many.
BLOCK = 4_096
#: Turns of single pairs at most, before all others are tried; a turn that links fewer than this share of its pairs ends them.
TURNS, LEAST_SHARE = 3, 0.1
#: Bits of a set's parities (parities()) at least and at most, and pairs whose parities are compared at a time.
LEAST_PARITIES, MOST_PARITIES, COMPARED = 64, 2_048, 1 << 14
#: Texts of an Arrow batch that a worker holds apart at a time, and bytes that are hashed at a time.
ROWS = 128
PIECE = 1 << 18
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(256)).lower()
STEP = np.uint64(0x9E3779B97F4A7C15)
MARK = "row long, k1 long, k2 long, h1 long, h2 long, n int, bits long, fp binary, parity binary, prefix array<long>, deal array<int>"  # and the identifier, with its own type


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, A-Z lower-cased; PIECE bytes at a time, cut between words."""
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in BLANK:
            end += 1
        codes = np.frombuffer(data[at:end].translate(LOWER), np.uint8)
        at = end
        inside = CODES[codes] != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, length = edge[::2], edge[1::2] - edge[::2]
        if len(first):
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            powers = np.cumprod(np.full(int(length.max()), STEP, np.uint64))
            out.append(np.add.reduceat(CODES[codes[inside]] * powers[place], np.cumsum(length) - length))
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_sets_of(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; none without words."""
    out, at = [], 0
    while at < len(texts):
        some = []
        while at < len(texts) and (not some or sum(map(len, some)) < PIECE):
            some.append(texts[at] or b"")
            at += 1
        each = [word_hashes(x) for x in some]
        n = np.array([len(x) for x in each])
        words, first = np.concatenate(each), np.cumsum(n) - n
        hashes = np.full(max(0, len(words) - size + 1), size, np.uint64)
        for i in range(size):
            hashes = mixed(hashes * STEP + words[i : i + len(hashes)])
        for x, start, count in zip(each, first, n, strict=True):
            if count >= size:
                out.append(np.unique(hashes[start : start + count - size + 1]))
            else:  # all words are one shingle
                h = np.full(min(count, 1), count, np.uint64)
                for w in x:
                    h = mixed(h * STEP + w)
                out.append(h)
    return out


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """A bit is 1 if more than half of the shingles have it in their BITS-bit hash."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 255):
        some = shingles[at : at + 255]
        wide = np.stack([mixed(some + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for i in range(BITS // 64)], axis=1)
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8).reshape(len(some), BITS // 8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parities of sets of so many shingles: the power of two that holds two a shingle, within the limits."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_PARITIES, MOST_PARITIES)


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of the shingles: whether an odd number of them has it. A shingle that only one of two sets has turns
    one bit, so sets differ in as many shingles as in bits at least. Parities of half the bits are those of both halves together."""
    bits = int(parity_bits(np.array([len(shingles)]))[0])
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


class Parities:
    """The parities of a task's rows, and which pairs of them may be similar."""

    def __init__(self, n: np.ndarray, parity: list[bytes]) -> None:
        self.n, self.bits = n, parity_bits(n)
        words = int(self.bits.max()) // 64
        flat = b"".join(x.ljust(8 * words, b"\0") for x in parity)
        self.whole = np.frombuffer(flat, np.uint64).reshape(len(n), words)

    def of(self, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Parities of `bits` bits, which are the rows' own or half of them."""
        found = self.whole[rows]
        for own in np.unique(self.bits[rows][self.bits[rows] > bits]):
            wide, half = np.flatnonzero((self.bits[rows] == own) & (bits < own)), own // 128
            found[wide, :half] ^= found[wide, half : 2 * half]
            found[wide, half:] = 0
        return found

    def may_be(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sets of a similarity of 4/5 differ in a ninth of their sizes' sum at most."""
        out = np.zeros(len(left), bool)
        for at in range(0, len(left), COMPARED):
            a, b = left[at : at + COMPARED], right[at : at + COMPARED]
            bits = np.minimum(self.bits[a], self.bits[b])
            out[at : at + COMPARED] = 9 * np.bitwise_count(self.of(a, bits) ^ self.of(b, bits)).sum(axis=1, dtype=np.int64) <= self.n[a] + self.n[b]
        return out


#: A number for each byte value; zero for blanks.
CODES = np.where(np.isin(np.arange(256), list(BLANK)), np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * STEP))


def listed(sets: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    flat = np.concatenate(sets) if sets else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(flat.view(kind)))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of ROWS rows: what a worker builds beside a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of a row's identifier and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(SEED), F.col(text_col), F.col(id_col))


def common_shingles(texts: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the texts, the rarer first, and the blocks of rows that each may fill; COMMON
    at most, so that a shingle not among them has about one in COMMON of all rows or fewer."""
    ship(texts.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = shingle_sets_of(b.column(0).cast(pa.binary()).to_pylist(), size)
            token, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], names=["token", "n"])

    share = max(1 / 16, SAMPLE_SETS / max(1, texts.count()))
    drawn = texts.where(uniform(F.lit(SEED), F.col("k1")) < share).select("text").mapInArrow(each, "token long, n int")
    found = drawn.groupBy("token").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}").orderBy(F.desc("n"), "token").limit(COMMON)
    got = found.toPandas()[::-1]
    return got["token"].to_numpy(np.int64).copy(), np.ceil(got["n"].to_numpy(np.float64) / (min(1.0, share) * BLOCK)).astype(np.int32)


def prefixes(lengths: np.ndarray, tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, token, rank) of each set's prefix in an order common to all sets: rare shingles by value, of rank 0, then
    `common`, whose first has rank 1.

    Two sets of n and m shingles with a similarity of 4/5 share ceil(4n/5) and ceil(4m/5) at least, so each has a shared
    one among its first n - ceil(4n/5) + 1. Any order will do; this one keeps popular passages out of the prefixes."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.zeros(len(tokens), np.int64)
    if len(common) and len(tokens):
        by_value = np.argsort(common)
        at = np.minimum(np.searchsorted(common, tokens, sorter=by_value), len(common) - 1)
        rank = np.where(common[by_value[at]] == tokens, by_value[at] + 1, 0)
    order = np.argsort(row * (len(common) + 1) + rank, kind="stable")
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = place < np.repeat(lengths - -(-4 * lengths // 5) + 1, lengths)
    return row[first], place[first], tokens[order[first]], rank[order[first]]


def marked_rows(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id and MARK of each row (id, k1, k2, text): a number of its own, two hashes, size, fingerprint and prefix of its set, and
    the blocks that each shingle of the prefix may fill. A task gives a set's prefix once, or seldom. The numbers hold only
    as long as the table is not computed again: write it."""
    ship(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, size))  # 12 COMMON bytes at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        number = TaskContext.get().partitionId() << ROW_BITS
        common, blocks = sent.value
        blocks = np.append(np.int32(1), blocks)
        for b in small(batches):
            sets = shingle_sets_of(b.column(3).cast(pa.binary()).to_pylist(), size)
            n = np.array([len(x) for x in sets], np.int64)
            row, _, token, rank = prefixes(n, (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64), common)
            at = np.searchsorted(row, np.arange(1, len(sets)))
            found, deal = (np.split(x, at) if sets else [] for x in (token, blocks[rank]))
            hashes, prints, odd = [], [], []
            for i, x in enumerate(sets):
                key = xxhash.xxh3_128_digest(x.tobytes())
                hashes.append(key)
                prints.append(wide_fingerprint(x))
                odd.append(parities(x))
                if key in seen:
                    found[i], deal[i] = found[i][:0], deal[i][:0]
                seen.add(key)
            if len(seen) > 200_000:
                seen.clear()
            pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(number, number + len(sets))), b.column(1), b.column(2), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n.astype(np.int32)), pa.array(np.frombuffer(b"".join(prints), np.int64)[:: BITS // 64]), pa.array(prints, pa.binary()), pa.array(odd, pa.binary()), listed(found), listed(deal, np.int32)],
                names=["id", *(x.split()[0] for x in MARK.split(", "))],
            )
            number += len(sets)

    return texts.select("id", "k1", "k2", "text").mapInArrow(each, f"id {kind}, {MARK}")


def shared_buckets(marked: DataFrame, equal: DataFrame) -> DataFrame:
    """(token, row, n, bits, place, deal): the prefixes' shingles that two sets or more have, a row for each set. `equal` (a, b) has
    the rows whose set an earlier row stands for.

    A shingle of one block is sent with nothing but its row and place, in one number; what else is needed is joined to those
    that are shared. Rows of a shingle that may fill several blocks go to as many tasks; such a one is given even if only
    one set has it."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        token, row = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(2))
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        same = token[1:] == token[:-1]
        held = np.append(same, False) | np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(token[held]), pa.array(row[held])], names=["token", "at"])

    each = marked.select("row", F.posexplode(F.arrays_zip("prefix", "deal")).alias("place", "x"))
    each = each.select(F.col("x.prefix").alias("token"), (F.shiftleft("row", PLACE_BITS) + F.least("place", F.lit((1 << PLACE_BITS) - 1))).alias("at"), F.col("x.deal").alias("deal"))
    parts = (marked.select(F.sum(F.size("prefix"))).first()[0] or 0) // PAIR_ROWS
    single = each.where("deal = 1").select("token", "at").repartition(max(12, parts), "token").mapInArrow(shared, "token long, at long")
    found = single.withColumn("deal", F.lit(1)).unionByName(each.where("deal > 1"))
    found = found.select("token", F.shiftright("at", PLACE_BITS).alias("row"), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"), "deal")
    firsts = cut(marked.select("row", "n", "bits").join(equal.select(F.col("a").alias("row")), "row", "left_anti"), "first-rows")
    return found.join(firsts, "row").select("token", "row", "n", "bits", "place", "deal")


def with_blocks(buckets: DataFrame) -> DataFrame:
    """Put `blocks` for `deal`: the blocks of BLOCK rows that a shingle's rows do fill."""
    several = buckets.where("deal > 1")
    sizes = cut(several.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "sizes")
    blocks = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    several = cut(several.join(sizes, "token", "left").withColumn("blocks", blocks).drop("m", "deal"), "dealt-buckets")
    return buckets.where("deal = 1").withColumnRenamed("deal", "blocks").unionByName(several)


def apart(token: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows, sorted by token, are of a token that has rows of several roots."""
    if not len(token):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    return np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), np.diff(np.append(first, len(token))))


def bucket_pairs(token: np.ndarray, row: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, bits: np.ndarray, side: np.ndarray, turn: int | None, parity: list[bytes] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one token and of different roots that may be similar by their sizes, the token's places and, if given,
    their parities.

    In a turn, each row meets ORDERS others at most: in each order of the fingerprints, turned round by some bits, the nearest
    of the next NEIGHBOURS rows that it may be similar to. Without a turn it meets all whose sizes are near enough. Rows of
    one side, 1 or 2, do not meet."""
    order = np.lexsort((row, n, token))
    token, row, n, place, root, bits, side = (x[order] for x in (token, row, n, place, root, bits, side))
    held = apart(token, root)
    columns = [x[held] for x in (token, row, n, place, root, bits, side)]

    def may_be(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # a pair's first common shingle leaves no more than this; it has to reach ceil(4 (n + m) / 9)
        reach = np.minimum(n[left] - place[left], n[right] - place[right])
        return (root[left] != root[right]) & (9 * reach >= 4 * (n[left] + n[right])) & ((side[left] == 0) | (side[left] != side[right]))

    def pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(row[left], row[right]), np.maximum(row[left], row[right])

    if turn is None:
        token, row, n, place, root, bits, side = columns
        odd = Parities(n, [parity[i] for i in order[held]]) if parity and len(n) else None
        left, step = np.arange(len(token)), 0
        while len(left):
            step += 1
            left = left[left + step < len(token)]
            left = left[(token[left] == token[left + step]) & (4 * n[left + step] <= 5 * n[left])]  # in order of size
            some = left[may_be(left, left + step)]
            if odd:
                some = some[odd.may_be(some, some + step)]
            yield pairs(some, some + step)
        return
    for i in range(turn * ORDERS, turn * ORDERS + ORDERS):
        shift = TURN * i % 64
        turned = (columns[5] << np.uint64(shift)) | (columns[5] >> np.uint64(-shift % 64)) if shift else columns[5]
        order = np.lexsort((columns[1], turned, columns[0]))
        token, row, n, place, root, bits, side = (x[order] for x in columns)
        left = np.arange(len(token))
        least, other = np.full(len(token), NEAR_BITS * 64 // BITS + 6, np.uint8), np.full(len(token), -1)
        for step in range(1, NEIGHBOURS + 1):
            left = left[left + step < len(token)]
            left = left[token[left] == token[left + step]]
            if not len(left):
                break
            some = left[may_be(left, left + step)]
            d = np.bitwise_count(bits[some] ^ bits[some + step])
            nearer = d < least[some]
            least[some[nearer]], other[some[nearer]] = d[nearer], some[nearer] + step
        some = np.flatnonzero(other >= 0)
        yield pairs(some, other[some])


def cells(buckets: DataFrame, turn: int | None) -> DataFrame:
    """(token, row, n, place, root, bits, side): what is compared in one task; `token` is a number for it.

    In a turn a row of a frequent shingle is in one block, in another one for each shingle and turn. Without a turn each
    pair of blocks is a cell of its own, and a block with itself; those of a shingle whose rows are all tied are left out."""
    columns = [F.col(c) for c in ("row", "n", "place", "root", "bits")]
    alone = F.lit(0).cast("byte").alias("side")
    if turn is not None:
        block = F.pmod(F.xxhash64("row", "token", F.lit(turn)), F.col("blocks"))
        return buckets.select(F.when(F.col("blocks") > 1, F.xxhash64("token", block)).otherwise(F.col("token")).alias("token"), *columns, alone)
    several = buckets.where("blocks > 1")
    loose = cut(several.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token"), "loose-tokens")
    own = F.pmod(F.xxhash64("row", "token"), F.col("blocks")).cast("int")
    several = several.join(loose, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side")
    several = several.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("token"), *columns, side)
    return buckets.where("blocks = 1").select("token", *columns, alone).unionByName(several)


def near_pairs(buckets: DataFrame, turn: int | None, parts: int, marked: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: bucket_pairs() of all buckets (token, row, n, place, root, bits, blocks), dealt to so many tasks. Without a turn
    the rows of cells of several roots get their parities from `marked`, so that a task itself sees that a pair is not similar."""
    names = ["token", "row", "n", "place", "root", "bits", "side"]

    def columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        parts = [b for b in batches if b.num_rows]
        return [np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(7)] if parts else []

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := columns(batches):
            order = np.argsort(found[0], kind="stable")
            order = order[apart(found[0][order], found[4][order])]
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in found], names=names)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            token, row, n, place, root, bits, side = columns(batches)
            parity = [x for b in batches for x in b.column(7).to_pylist()] if turn is None else None
            for a, b in distinct_pairs(bucket_pairs(token, row, n.astype(np.int64), place.astype(np.int64), root, bits.view(np.uint64), side, turn, parity)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = cells(buckets, turn).repartition(parts, "token")
    if turn is None:
        kept = cut(dealt.mapInArrow(loose, dealt.schema), "loose-rows")
        dealt = kept.join(marked.select("row", "parity"), "row").select(*names, "parity").repartition(max(12, kept.count() // PAIR_ROWS), "token")
    return dealt.mapInArrow(paired, "a long, b long").distinct()


def distinct_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs without their repeats, as far as PAIR_ROWS pairs at a time show them."""
    held, n = [], 0

    def once() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return a[new], b[new]

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PAIR_ROWS:
            held, n = [once()], 0
            if len(held[0][0]) >= PAIR_ROWS // 2:
                yield held.pop()
    if held:
        yield once()


def fingerprints_near(pairs: DataFrame, marked: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """The pairs whose fingerprints differ in `most` bits or fewer."""
    ship(pairs.sparkSession)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (2, 3))
            held = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(held), b.column(1).filter(held)], names=["a", "b"])

    both = pairs.join(marked.select(F.col("row").alias("a"), F.col("fp").alias("x")), "a").join(marked.select(F.col("row").alias("b"), F.col("fp").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def split_by_key(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (with k1, k2) whose k1 is surely not one of `keys`, and those where it may be: a blocked Bloom filter tells."""
    probed = maybe_listed(rows, *build_filter(keys, "k1"), "k1")
    return probed.where("NOT maybe").drop("maybe"), probed.where("maybe").drop("maybe")


def shingle_sets(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row, tokens): the shingle set of each row (row, text)."""
    ship(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), listed(shingle_sets_of(b.column(1).cast(pa.binary()).to_pylist(), size))], names=["row", "tokens"])

    return rows.select("row", "text").mapInArrow(each, "row long, tokens array<long>")


def similar(inter: Column, left: Column, right: Column) -> Column:
    """Whether sets of two sizes with so many shingles in common have a similarity of SIMILARITY = 4/5 or more."""
    return 5 * inter >= 4 * (left + right - inter)


class Verifier:
    """Decides pairs by the exact intersection of their sets. The sets are made again from the texts of the rows that a pair
    names; a later call makes those only that no former one has made."""

    def __init__(self, marked: DataFrame, texts: DataFrame, size: int) -> None:
        self.marked, self.texts, self.size, self.sets = marked, texts, size, None

    def fetch(self, pairs: DataFrame) -> None:
        named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        if self.sets is not None:
            named = named.join(self.sets.select("row"), "row", "left_anti")
        keys = cut(self.marked.select("row", "k1", "k2").join(named, "row"), "keys")
        if keys.isEmpty():
            return
        found = split_by_key(self.texts, keys)[1].join(keys, ["k1", "k2"]).dropDuplicates(["row"])
        made = cut(shingle_sets(found, self.size), "sets-of-pairs")
        self.sets = made if self.sets is None else self.sets.unionByName(made)

    def links(self, pairs: DataFrame, most: int = MOST_BITS) -> tuple[DataFrame, int]:
        """(a, b) of the pairs that are similar, and the number of pairs tried."""
        pairs = cut(fingerprints_near(pairs, self.marked, most), "pairs")
        tried = pairs.count()
        if not tried:
            return pairs, 0
        self.fetch(pairs)
        both = pairs.join(self.sets.select(F.col("row").alias("a"), F.col("tokens").alias("x")), "a").join(self.sets.select(F.col("row").alias("b"), F.col("tokens").alias("y")), "b")
        return cut(both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "links"), tried


def tree_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): what op8's vantage-point shards link among the 64-bit fingerprints of the rows (row, bits), as pairs of the first rows of
    two fingerprints, and each row beside the first of its own."""
    nodes = cut(rows.groupBy("bits").agg(F.min("row").alias("first")), "fingerprints")
    found = cut(tree_links(nodes.select(F.col("bits").alias("fp"))), "tree-links")
    side = lambda name: nodes.select(F.col("bits").alias(name), F.col("first").alias(f"{name}_row"))
    met = found.join(side("a"), "a").join(side("b"), "b").select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))
    return met.unionByName(rows.join(nodes, "bits").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))).distinct()


def near_links(marked: DataFrame, texts: DataFrame, equal: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b): links that tie the same sets as all pairs of a similarity of SIMILARITY or more do.

    First op8's search ties the rows whose 64-bit fingerprints lie near each other, as far as the exact similarity bears it out.
    In the next turns a row meets a few rows of each bucket that the links found so far do not tie to it, so a large
    group of near copies grows together by few pairs. Then all pairs are tried that are still apart: none is missed."""
    buckets = with_blocks(cut(shared_buckets(marked, equal), "buckets"))
    judge, rooted = Verifier(marked, texts, size), buckets.withColumn("root", F.col("row"))
    rows, in_cells = buckets.agg(F.count("*"), F.sum("blocks")).first()

    def with_roots(links: DataFrame) -> DataFrame:
        roots = cut(components(links), "roots-so-far").withColumnRenamed("node", "__node")
        return buckets.join(roots, F.col("row") == F.col("__node"), "left").withColumn("root", F.coalesce("root", "row"))

    found, _ = judge.links(tree_pairs(marked.select("row", "bits").join(equal.select(F.col("a").alias("row")), "row", "left_anti")))
    turn = 0
    if not found.isEmpty():
        rooted = with_roots(found)
    while True:
        parts = max(12, (rows if turn is not None else in_cells or 0) // PAIR_ROWS)
        new, tried = judge.links(near_pairs(rooted, turn, parts, marked), MOST_BITS if turn is None else NEAR_BITS)
        found = found.unionByName(new)
        if turn is None:
            return found
        linked = new.count()
        if linked:
            rooted = with_roots(found)
        turn = turn + 1 if linked > LEAST_SHARE * tried and turn + 1 < TURNS else None


def near_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, k1, k2, root): a row for each document; root is the same number for all of a class."""
    k1, k2 = row_keys(id_col, text_col)
    texts = documents.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    marked = cut(marked_rows(texts, size), "marked")
    # the first row of each set stands for it: an edge to it ties the others
    firsts = cut(marked.groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "firsts")
    equal = cut(marked.join(firsts, ["h1", "h2"]).where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")), "equal-sets")
    rooted = cut(components(near_links(marked, texts, equal, size).unionByName(equal)), "roots").withColumnRenamed("node", "row")
    return marked.select("row", "id", "k1", "k2").join(rooted, "row", "left").select("id", "k1", "k2", F.coalesce("root", "row").alias("root"))


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `documents` of each class: that of the smallest identifier."""
    with passing():  # the marks, buckets and pairs are larger than the classes, and of no use after
        found = cut(near_classes(documents, id_col, text_col), "classes", last=True)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("k1"), F.col("k2"))
    groups = found.groupBy("root").agg(F.count("*").alias("m"), F.min(order).alias("least")).where("m > 1")
    stays = cut(groups.select("root", F.col("least.k1").alias("s1"), F.col("least.k2").alias("s2")), "stays")
    # every row of a class of several is named: those that go, and those that stay once
    listed_rows = found.join(stays, "root").groupBy("k1", "k2").agg(F.max((F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).alias("stays"))
    listed_rows = cut(listed_rows, "listed-rows")
    k1, k2 = row_keys(id_col, text_col)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), k1.alias("k1"), k2.alias("k2"))
    others, hits = split_by_key(rows, listed_rows)
    hits = hits.join(listed_rows, ["k1", "k2"], "left")
    once = hits.where("stays").dropDuplicates(["k1", "k2"])
    return others.select("whole.*").unionByName(hits.where("stays IS NULL").select("whole.*")).unionByName(once.select("whole.*"))
