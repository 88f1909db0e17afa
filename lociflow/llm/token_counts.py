"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as one symbol a byte. The heap gives the adjacent pair of lowest rank; merging it removes one
symbol, so a piece's count is its symbols less its merges, and no identifiers are made. The vocabulary file's steps are
followed: special strings are cut out of the raw text and count one each; then NFC, white space, small letters; then
the split pattern, whose matches alone are kept.

Defined cases: a null text is empty and has no tokens; repeated rows and equal texts count alike, whatever else the rows hold;
pairs of equal rank do not occur, and equal pairs merge from the left; an empty table gives an empty one; a column with the
result's name is replaced, and document_tokens() gives no column of the documents but doc_id. A text of any length is counted
whole. Memory follows the longest piece that the split pattern does not part: its symbols, links and heap take some hundred
bytes for each byte of it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import ship

LIMIT = 2048
#: Pieces and words whose counts a worker remembers; a full memory is emptied.
MEMORY = 400_000
#: White space of the tokenizer's regular expressions.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Code points that the regex module takes for letters or digits and the tokenizer's older Unicode data do not.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
)
#: Small letters that newer Unicode data give to capitals which Python's do not know yet.
NEW_SMALL = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    known = set(plain)
    return [chr(b) if b in known else chr(next(other)) for b in range(256)]


class PairMerger:
    """Counts tokens of a JSON vocabulary with byte-level BPE and an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as x:
            spec = json.load(x)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.vocabulary = frozenset(model["vocab"])
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in NEWER.split())
        self.pattern = regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}--[{newer}]]+|[\\p{{N}}--[{newer}]]|[[^{SPACE}\\p{{L}}\\p{{N}}]||[{newer}]]+")
        self.blank = re.compile(f"[{SPACE}]+")
        self.symbols = byte_symbols()
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Symbols less merges of one piece."""
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.vocabulary]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + right, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def word(self, raw: str) -> int:
        """Tokens of a raw run without white space."""
        # each character is lowered by itself: a final sigma has no form of its own here
        text = unicodedata.normalize("NFC", raw).replace("Σ", "σ").translate(NEW_SMALL).lower()
        total, known = 0, self.pieces
        for piece in self.pattern.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.merge(piece)
                if len(known) >= MEMORY:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        total, known = 0, self.words
        for raw in self.blank.split(text):
            n = known.get(raw)
            if n is None:
                n = self.word(raw)
                if len(known) >= MEMORY:
                    known.clear()
                if len(raw) <= 64:
                    known[raw] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(documents: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the token count of each text; `vocabulary` is a path that every executor has."""
    ship(documents.sparkSession)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = merger(vocabulary)
        for texts in parts:
            yield pd.Series([known.count(t) for t in texts], dtype="int64")

    return documents.withColumn(out, count(F.col(text)))


def document_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    counted = count_tokens(documents.select("doc_id", "text"), vocabulary)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
