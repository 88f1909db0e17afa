"""Harmonic packing of tokenized documents into sequences.

A length in (C / (k + 1), C / k] is of class k; a bin of class k takes exactly k documents and is then full. Every worker
fills its own bins, so no data move. A document first gives whole sequences; what is left of it, below one sequence, is
classed whole. The space that a full bin leaves is filled from a filler, a document that is cut where the spaces need it:
a worker takes one whenever its fillers hold less than FILLER sequences. So most documents stay in one piece and there is
next to no padding. What a worker's open bins and fillers hold at its end, below one sequence for each class, is laid end
to end and cut at the capacity.

Defined cases: a null or empty text has the end token alone; special strings in texts become their token, as the
tokenizer has it by default; a text of any length is cut into as many sequences as it needs; repeated rows are packed
each; equal lengths are packed as they come; an empty table gives an empty one; columns beside the identifier and the text
are left out; sequence identifiers hold the partition's number above 2 ** 32, so they differ between workers and stay the
same when a task runs again on the same rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lociflow.llm.shared import ship

CAPACITY = 2048
#: Sequences that a worker's fillers hold at least.
FILLER = 1
END = 1
ROWS = 20_000
SPECIAL = {"<|endoftext|>": 50256}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary as ranks. They hold the merges of the JSON file and give its identifiers (the tests compare
    them over all code points), at several times the speed."""
    with open(path, "rb") as x:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, x)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str | None, known: tiktoken.Encoding) -> np.ndarray:
    return np.array([*known.encode(text or "", allowed_special="all"), END], dtype="<u4")


class Packer:
    """One worker's bins. A piece is (doc, start, ids, tokens of the document)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.next_id, self.capacity, self.bins, self.rows = first_id, capacity, {}, []
        self.fillers, self.held = deque(), 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def fill(self, room: int) -> list[tuple]:
        """Pieces of the fillers for a space."""
        out = []
        while room and self.fillers:
            doc, start, ids, total = self.fillers.popleft()
            part, rest = ids[:room], ids[room:]
            out.append((doc, start, part, total))
            if len(rest):
                self.fillers.appendleft((doc, start + len(part), rest, total))
            room -= len(part)
            self.held -= len(part)
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.close([(doc, at, ids[at : at + self.capacity], len(ids))])
        rest = (doc, whole, ids[whole:].copy(), len(ids))
        size = len(rest[2])
        if not size:
            return
        if self.held < FILLER * self.capacity:
            self.fillers.append(rest)
            self.held += size
            return
        k = self.capacity // size
        pieces = self.bins.setdefault(k, [])
        pieces.append(rest)
        if len(pieces) == k:
            del self.bins[k]
            self.close(pieces + self.fill(self.capacity - sum(len(x[2]) for x in pieces)))

    def end(self) -> None:
        left, room, pieces = [x for k in sorted(self.bins) for x in self.bins[k]] + list(self.fillers), self.capacity, []
        self.bins, self.fillers, self.held = {}, deque(), 0
        for doc, start, ids, total in left:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                pieces.append((doc, start, part, total))
                start += len(part)
                room -= len(part)
                if not room:
                    self.close(pieces)
                    room, pieces = self.capacity, []
        if pieces:
            self.close(pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def pack(documents: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; `vocabulary` is a path that every executor has."""
    ship(documents.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(vocabulary, pattern)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py(), known))
                if len(packer.rows) >= ROWS:
                    yield packer.take()
        packer.end()
        yield packer.take()

    return documents.select(documents[id_col].cast("long").alias(id_col), text_col).mapInArrow(fill, PIECE)
