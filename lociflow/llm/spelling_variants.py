"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each belongs to.

A word is cut in two halves. One edit leaves one of them whole: the first half is still at the start of the near word, or
the second half at its end. Automaton shards (Aho-Corasick) hold both halves of every word; all words are scanned, a match
counts if it is at the right offset and if the two words' lengths differ by one at most, and then the words are compared.

Which shard holds a half follows from its outermost ANCHOR code points, so a word is scanned by two shards and not by all:
that of its start, for first halves, and that of its end, for second halves. The halves of an anchor that has more than
SHARD_WORDS words are dealt to several shards, each of which scans all the anchor's words. A shard's automaton is the only
thing that a task holds whole; the words to scan stream past it. Near pairs never leave a task: a task gives for each
scanned word its number of near words and the best of them.

Defined cases: a null text has no words; a null identifier counts as the empty string; equal rows count each; texts and runs
may have any length (texts are read in pieces that end between runs, long words are compared one by one); of near words
with the same number of occurrences the first in code-point order is the form; an empty table gives an empty one; columns
beside the identifier and the text are left out, so none can clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, ship

#: Least code points and occurrences of a word, occurrences of a form for each of its variant, and the modulus that draws
#: the runs which lose a code point.
LEAST_LENGTH, LEAST_COUNT, RATIO, DRAW = 6, 5, 5, 199
#: Code points at a word's start or end that tell its shard. No half is shorter.
ANCHOR = LEAST_LENGTH // 2
#: Words whose halves are in one automaton, about.
SHARD_WORDS = 5_000
#: Characters of a text that are looked at together, and distinct words that a task counts before it gives them away.
PIECE, HELD = 1 << 20, 200_000
#: Pairs that are compared at a time, words of a scan, and the longest word that is compared by columns.
PAIRS, SCAN_WORDS, WIDE = 1 << 18, 4_096, 64
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
OUTSIDE = re.compile("[^a-zÀ-ÿ]")
LOWER = bytes(range(256)).lower()  # bytes.lower() changes A-Z only
SEARCH = "shard long, own boolean, kind int, word string, n long"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text that end between runs."""
    at = 0
    while at < len(text):
        found = OUTSIDE.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: str, text: bytes, counts: Counter, piece: int = PIECE) -> None:
    """Count the words of LEAST_LENGTH code points or more of a text in UTF-8; runs that the draw names lose a code point."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for part in pieces(text.translate(LOWER).decode("utf-8", "replace"), piece):
        for run, n in Counter(RUN.findall(part)).items():
            h = zlib.crc32(run.encode(), start)
            if h % DRAW == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            counts[run] += n


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of all texts that occur `least` times or more."""
    ship(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                words_of(doc_id.as_py(), text.as_py(), counts)
                if len(counts) >= HELD:
                    yield given()
                    counts.clear()
        if counts:
            yield given()

    rows = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(word: Column) -> Column:
    """The word's two kinds of rows: kind 0 by its start, kind 1 by its end."""
    return F.array(F.struct(F.lit(0).alias("kind"), F.left(word, F.lit(ANCHOR)).alias("anchor")), F.struct(F.lit(1).alias("kind"), F.right(word, F.lit(ANCHOR)).alias("anchor")))


def routed(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """SEARCH of words (word, n): the rows that build each shard's automaton (own) and those that it scans."""
    total = words.count()
    ends = words.select("word", "n", F.explode(halves(F.col("word"))).alias("x")).select("word", "n", "x.kind", "x.anchor")
    # two for each ANCHOR letters of 90, so at most 2 * 90 ** ANCHOR rows: small enough to be sent
    crowded = ends.groupBy("kind", "anchor").agg(F.count("*").alias("m")).where(F.col("m") > shard_words)
    dealt = crowded.select("kind", "anchor", F.ceil(F.col("m") / shard_words).cast("int").alias("parts"))
    ends = ends.join(F.broadcast(dealt), ["kind", "anchor"], "left")
    shards = max(12, 2 * total // shard_words)
    bucket = F.xxhash64(F.pmod(F.xxhash64("kind", "anchor"), F.lit(shards)))
    part = lambda i: F.when(F.col("parts").isNull(), bucket).otherwise(F.xxhash64("kind", "anchor", i))
    own = ends.withColumn("shard", part(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).withColumn("own", F.lit(True))
    scan = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("shard", part(F.col("i"))).withColumn("own", F.lit(False))
    columns = [x.split()[0] for x in SEARCH.split(", ")]
    return own.select(columns).unionByName(scan.select(columns)).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("own"))


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words as rows padded with zeros (words of more than WIDE bytes are cut), and the words' lengths."""
    length = np.array([len(x) for x in words], np.int64)
    table = np.zeros((len(words), int(min(WIDE, length.max(initial=0))) + 1), np.uint8)
    kept = np.minimum(length, WIDE)
    row = np.repeat(np.arange(len(words)), kept)
    table[row, np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)] = np.frombuffer(b"".join(x[:WIDE] for x in words), np.uint8)
    return table, length


def one_edit(left: bytes, right: bytes) -> tuple[bool, int]:
    """Whether two words differ by exactly one edit, and the length of their common start."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    same = np.append(a == b[: len(a)], False)
    start = int(same.argmin())
    rest = a[start + 1 :] if len(a) == len(b) else a[start:]
    return left != right and len(b) - len(a) < 2 and bool(np.array_equal(rest, b[start + 1 :])), start


def near(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """one_edit() of the rows of two tables of the same width whose lengths differ by one at most."""
    swap = (na > nb)[:, None]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    n, m = np.minimum(na, nb), np.maximum(na, nb)
    width = short.shape[1]
    column = np.arange(width)
    start = np.minimum(np.argmin(np.append(short == long, np.zeros((len(n), 1), bool), axis=1), axis=1), n)
    shifted = np.append(long[:, 1:], np.zeros((len(n), 1), np.uint8), axis=1)
    first = start[:, None]
    replaced = ((short == long) | (column <= first)).all(axis=1) & (start < n)
    inserted = ((short == shifted) | (column < first) | (column >= n[:, None])).all(axis=1)
    return np.where(n == m, replaced, inserted), start


class Shard:
    """Halves of some words in one automaton. Words hold code points up to 255, so a byte in Latin-1 is one of them."""

    def __init__(self, words: list[str], kinds: np.ndarray, counts: np.ndarray) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.kinds, self.counts = [words[i] for i in order], kinds[order], counts[order]
        self.data = [x.encode("latin-1") for x in self.words]
        self.table, self.length = matrix(self.data)
        self.half = self.length // 2
        self.automaton, held = ahocorasick.Automaton(), defaultdict(list)
        for i, (word, kind, half) in enumerate(zip(self.words, self.kinds, self.half, strict=True)):
            held[word[half:] if kind else word[:half]].append(i)
        for k, segment in enumerate(held):
            self.automaton.add_word(segment, (len(segment), k))
        if held:
            self.automaton.make_automaton()
        lists = [np.array(x, np.int64) for x in held.values()]
        self.first = np.cumsum([0, *map(len, lists)])
        self.members = np.concatenate(lists) if lists else np.zeros(0, np.int64)

    def candidates(self, words: list[str], kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scanned, own) whose half is at the right offset and whose lengths fit, PAIRS at a time or a little more."""
        length = np.array([len(x) for x in words])
        start = np.cumsum(length + 1) - length - 1
        found = [(end, size, k) for end, (size, k) in self.automaton.iter("\n".join(words))] if len(self.automaton) else []
        if not found:
            return
        end, size, segment = np.array(found, np.int64).T
        at = np.searchsorted(start, end, side="right") - 1
        placed = np.where(kinds[at] == 0, end - size + 1 == start[at], end + 1 == start[at] + length[at])
        at, segment = at[placed], segment[placed]
        n = np.diff(self.first)[segment]
        edge = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS))
        for some in np.split(np.arange(len(n)), np.unique(np.minimum(edge + 1, len(n)))):
            rows = np.repeat(at[some], n[some])
            own = self.members[np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + np.repeat(self.first[segment[some]], n[some])]
            fits = (kinds[rows] == self.kinds[own]) & (np.abs(length[rows] - self.length[own]) < 2)
            yield rows[fits], own[fits]

    def scan(self, words: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each scanned word: the number of near words here, and the place of the best of them (-1: none). A pair that both
        halves show is counted by its first half."""
        data = [x.encode("latin-1") for x in words]
        table, length = matrix(data)
        number, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for rows, own in self.candidates(words, kinds):
            width = min(table.shape[1], self.table.shape[1])
            width = max(width, int(min(WIDE, max(length[rows].max(initial=0), self.length[own].max(initial=0)))) + 1)
            pad = lambda x: np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]  # noqa: E731, B023
            for at in range(0, len(rows), PAIRS):
                i, j = rows[at : at + PAIRS], own[at : at + PAIRS]
                wide = np.maximum(length[i], self.length[j]) > WIDE
                good, start = near(pad(table[i]), length[i], pad(self.table[j]), self.length[j])
                for k in np.flatnonzero(wide):
                    good[k], start[k] = one_edit(data[i[k]], self.data[j[k]])
                good &= (kinds[i] == 0) | (start < self.half[j])
                i, j = i[good], j[good]
                number += np.bincount(i, minlength=len(words))
                i, j = np.append(i, np.flatnonzero(best >= 0)), np.append(j, best[best >= 0])
                order = np.lexsort((j, -self.counts[j], i))  # places are in code-point order
                i, j = i[order], j[order]
                first = np.append(True, i[1:] != i[:-1])[: len(i)]
                best[i[first]] = j[first]
        return number, best


FOUND = "word string, n long, n_near long, minus_n long, form string"


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND of rows SEARCH that come shard by shard, a shard's own words first."""
    shard, own, held = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        name, is_own = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (is_own[1:] != is_own[:-1])))
        for at, to in zip(edges, np.append(edges[1:], b.num_rows), strict=True):
            part = b.slice(at, to - at)
            if name[at] != shard:
                shard, own, held = name[at], [], None
            if is_own[at]:
                own.append(part)
                continue
            if held is None:
                rows = pa.Table.from_batches(own, b.schema) if own else part.slice(0, 0)
                held = Shard(rows.column("word").to_pylist(), np.asarray(rows.column("kind"), np.int64), np.asarray(rows.column("n"), np.int64))
                own = []
            for row in range(0, part.num_rows, SCAN_WORDS):
                some = part.slice(row, SCAN_WORDS)
                number, best = held.scan(some.column("word").to_pylist(), np.asarray(some.column("kind"), np.int64))
                none = best < 0
                yield pa.RecordBatch.from_arrays(
                    [some.column("word"), some.column("n"), pa.array(number), pa.array(-held.counts[best] if held.words else np.zeros(len(best), np.int64), mask=none), pa.array([None if i < 0 else held.words[i] for i in best.tolist()], pa.string())],
                    names=[x.split()[0] for x in FOUND.split(", ")],
                )


def nearest(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best) of words (word, n): the number of near words, and the most frequent of them."""
    ship(words.sparkSession)
    found = routed(words, shard_words).mapInArrow(searched, FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("minus_n", "form")))
    whole = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return whole.select("word", "n", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.form").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form not null: root is what following forms ends in. Each round doubles the steps; a form
    is RATIO times as frequent as its word, so a chain has few of them, and no circle."""
    now = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts."""
    words = cut(word_counts(documents, id_col, text_col), "words")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    found = nearest(words, shard_words).select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    found = cut(found, "near-words")
    roots = with_roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
