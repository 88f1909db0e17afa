"""How filters interact: what each removes in every order in which they can be applied.

Five filters fail a document or not, whatever the others do, so a document is known by a mask of five bits. All orders follow
from the numbers of documents by part and mask; no text is looked at once an order.

Four filters look at one text. The fifth finds repeated texts, through a routed RDD: records go to the partition that the
xxhash of their text names, where a chain for each hash holds every full text that has it with its smallest identifier.
Identifiers that are not the smallest are emitted. A task sends one record for each distinct text only, that of its smallest
identifier: all others are known to be repeats already, so a text that a third of all rows share is a record a task.

The count vectors are merged by combineByKey, in each task before they are sent.

Defined cases: a null text counts as empty, and a text without words fails A only of the first two; a null source is the part
named by the empty string; a null identifier is larger than all others; rows of one text and one smallest identifier do not
fail E, since none has a smaller one; labels that repeat an identifier count if one of their rows says so; an empty table
gives an empty one; texts may have any length; columns beside those named are left out, so none can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The bit of the filter that looks for repeated texts.
REPEATED = 1 << FILTERS.index("E")
SYMBOLS = re.compile(rb"[#$%&*|]")
#: Bytes of texts that a task chains before it sends them, and that a partition chains, about.
HELD_BYTES, PART_BYTES = 64 << 20, 64 << 20
#: What is counted of a mask: documents, those labelled good, those labelled toxic.
COUNTED = 3
NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # at blanks of ASCII: space and 9 to 13
    few = len(words) < 200
    plain = 100 * len(set(words)) < 50 * len(words)
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    loud = 100 * len(text.translate(None, NOT_UPPER)) > 2 * points
    return few | plain << 1 | loud << 2 | (SYMBOLS.search(text) is not None) << 3


def larger(left, right) -> bool:
    """Whether an identifier is larger than another; none is larger than any."""
    return right is not None and (left is None or left > right)


class Chains:
    """For each hash, the texts that have it: the smallest identifier of each, and how often its rows carry what."""

    def __init__(self) -> None:
        self.held: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, h: int, text: bytes, doc_id, carried: Counter) -> tuple[object, Counter] | None:
        """Put a record in; what turns out not to be the smallest comes back: (identifier, carried)."""
        chain = self.held.setdefault(h, [])
        for link in chain:
            if link[0] != text:
                continue
            if larger(doc_id, link[1]):
                return doc_id, carried
            if doc_id == link[1]:
                link[2] += carried
                return None
            out = link[1], link[2]
            link[1:] = doc_id, carried
            return out
        chain.append([text, doc_id, carried])
        self.bytes += len(text)
        return None

    def records(self) -> Iterator[tuple[int, tuple]]:
        for h, chain in self.held.items():
            for link in chain:
                yield h, tuple(link)


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def repeats(rows: RDD, parts: int, hash_of=text_hash, held_bytes: int = HELD_BYTES) -> RDD:
    """(identifier, carried, n, repeated) of rows (identifier, carried, text): n rows alike in the first two, and whether a row of
    an equal text has a smaller identifier. `carried` is hashable."""

    def sent(records: Iterable[tuple]) -> Iterator[tuple]:
        chains = Chains()
        for doc_id, carried, text in records:
            h = hash_of(text)
            if out := chains.add(h, text, doc_id, Counter([carried])):
                yield text_hash(repr(out[0]).encode()), (None, *out)  # settled: any partition will do
            if chains.bytes >= held_bytes:
                yield from chains.records()
                chains = Chains()
        yield from chains.records()

    def chained(records: Iterable[tuple]) -> Iterator[tuple]:
        chains = Chains()
        for h, (text, doc_id, carried) in records:
            out = (doc_id, carried) if text is None else chains.add(h, text, doc_id, carried)
            if out:
                yield from ((out[0], c, n, True) for c, n in out[1].items())
        for _, (_, doc_id, carried) in chains.records():
            yield from ((doc_id, c, n, False) for c, n in carried.items())

    return rows.mapPartitions(sent).partitionBy(parts, lambda h: h % parts).mapPartitions(chained)


def partitions(documents: DataFrame, text_col: str) -> int:
    """So many that one holds about PART_BYTES of texts, all different."""
    total = documents.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(12, -(-total // PART_BYTES))


def texts(documents: DataFrame, id_col: str, text_col: str, *more: Column) -> RDD:
    return documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary"), *more).rdd


def non_minimum_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of each row whose text a row of a smaller identifier has; rows alike in both give one."""
    ship(documents.sparkSession)
    rows = texts(documents, id_col, text_col).map(lambda r: (r[0], None, bytes(r[1])))
    found = repeats(rows, partitions(documents, text_col)).filter(lambda x: x[3]).map(lambda x: x[:1])
    return documents.sparkSession.createDataFrame(found, f"id {documents.schema[id_col].dataType.simpleString()}", verifySchema=False).distinct()


def masks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n): n documents of this identifier, part and mask. The bit 2 ** i is set if filter i fails them."""
    ship(documents.sparkSession)

    def looked_at(r) -> tuple:
        text = bytes(r[1])
        return r[0], (r[2], text_mask(text)), text

    rows = texts(documents, id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit(""))).map(looked_at)
    found = repeats(rows, partitions(documents, text_col)).map(lambda x: (x[0], x[1][0], x[1][1] | REPEATED * x[3], x[2]))
    return documents.sparkSession.createDataFrame(found, f"id {documents.schema[id_col].dataType.simpleString()}, part string, mask int, n long", verifySchema=False)


def count_vectors(marked: DataFrame) -> RDD:
    """(part, vector) of rows (part, mask, n, good, toxic): documents, good and toxic ones of each mask."""

    def begun(row: tuple) -> np.ndarray:
        return merged(np.zeros((1 << len(FILTERS), COUNTED), np.int64), row)

    def merged(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        vector[mask] += (n, n * good, n * toxic)
        return vector

    rows = marked.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return rows.combineByKey(begun, merged, lambda a, b: a + b)


@cache
def selections() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: the masks removed there, those kept after it, those of its filter removed before; and the bit."""
    mask, rows = np.arange(1 << len(FILTERS)), []
    for order in ORDERS:
        before = 0
        for name in order:
            bit = 1 << FILTERS.index(name)
            fails, gone = mask & bit != 0, mask & before != 0
            before |= bit
            rows.append((fails & ~gone, mask & before == 0, fails & gone, bit))
    return tuple(np.array(x).astype(np.int64) for x in zip(*rows, strict=True))


ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def order_rows(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """ROWS of a part: a row for each order of the filters and each step of it."""
    removes, keeps, late, bit = selections()
    removed, kept, redundant, alone = removes @ vector, keeps @ vector[:, 0], late @ vector[:, 0], vector[bit, 0]
    whole = {b: int(removed[bit == b, 0].sum()) for b in set(bit.tolist())}
    for i, order in enumerate(ORDERS):
        for step in range(len(FILTERS)):
            at = i * len(FILTERS) + step
            numbers = (kept[at], removed[at, 0], redundant[at], alone[at], removed[at, 1], removed[at, 2])
            yield part, order, step + 1, *map(int, numbers), whole[int(bit[at])]


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """ROWS of every part of the documents. `labels` has the identifier, quality and toxic."""
    marked = cut(masks(documents, id_col, text_col, part_col), "masks")
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    told = cut(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")), "labels")
    both = marked.join(told, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return documents.sparkSession.createDataFrame(count_vectors(both).flatMap(lambda x: order_rows(*x)), ROWS, verifySchema=False)
