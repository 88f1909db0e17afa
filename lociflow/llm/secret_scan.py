"""Secrets in texts: three patterns, and a token-efficiency test for random strings.

A vocabulary that was learned from prose and code covers a word with few tokens but a random string with many. Runs of
MIN_RUN or more key characters that yield fewer than MAX_CHARS_A_TOKEN characters a token, hold letters and digits or
letters of both cases, and are neither a known kind of digest nor an identifier are taken for secrets.

Every step is linear in the text, but for the vocabulary's merges (n log n), so an unbroken run may have any length.

Defined cases: a null or empty text has no span; an empty table gives an empty one; overlapping spans of different base
kinds all stay, ties at one start in the order of KINDS; a random run that overlaps a base span is not added; spans count
code points; repeated rows are scanned alike; a column of the documents named like the result's is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import ship

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
MAX_CHARS_A_TOKEN = 2.2
#: Patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Runs of one kind of character; an identifier is told from them one by one.
PART = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[_/=+-]+")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as x:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, x)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Whether a run is made of words, numbers and their compounds in snake, kebab, path or camel case.

    A word has two or more small letters, with or without a capital in front; capitals stand alone in twos or more, where
    neither a small letter nor a digit follows; a number has four digits at most and ends its part. Only at the run's start
    may capitals or a number of any length go straight on. Each run of one kind of character is judged by its neighbours, so
    one pass tells."""
    parts = PART.findall(run)
    if sum(map(len, parts)) != len(run):
        return False
    for i, x in enumerate(parts):
        after, kind = parts[i + 1] if i + 1 < len(parts) else "_", x[0]
        if "a" <= kind <= "z":
            fits = len(x) >= 2
        elif "A" <= kind <= "Z":
            if "a" <= after[0] <= "z":  # the last capital begins the word
                fits = len(x) != 2 or i == 0
            else:
                fits = len(x) >= 2 and (i == 0 or not after[0].isdigit())
        elif kind.isdigit():
            fits = i == 0 or len(x) <= 4 and after[0] in "_/=+-"
        else:
            fits = i > 0
        if not fits:
            return False
    return True


def is_random(run: str, known: tiktoken.Encoding) -> bool:
    kinds = sum(any(map(test, run)) for test in (str.isdigit, str.islower, str.isupper))
    if kinds < 2 or DIGEST.fullmatch(run) or UUID.fullmatch(run) or is_identifier(run):
        return False
    return len(run) < MAX_CHARS_A_TOKEN * len(known.encode_ordinary(run))


def find_spans(text: str | None, known: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    if not text:
        return []
    spans, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    longest = max(map(len, text.split()), default=0)  # no span below crosses white space
    if longest >= 32:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if longest >= MIN_RUN:
        base = sorted((a, b) for a, _, b in spans)
        at, reach = 0, 0
        for m in KEY_RUN.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                reach = max(reach, base[at][1])
                at += 1
            if reach <= m.start() and is_random(m[0], known):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def scan(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "spans") -> DataFrame:
    """Add an array of struct(kind, start, end), in order."""
    ship(documents.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoding(vocabulary, pattern)
        for texts in parts:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, known)] for t in texts], dtype="object")

    return documents.withColumn(out, find(F.col(text)))


def redact_text(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    """Spans that touch or overlap become one mask."""
    if not spans:
        return text
    out, at, reach = [], 0, -1
    for start, _, end in spans:
        if start > reach:
            out += [text[at:start], mask]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every secret replaced; other texts stay as they are."""
    ship(documents.sparkSession)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = encoding(vocabulary, pattern)
        for texts in parts:
            yield pd.Series([redact_text(t, find_spans(t, known), mask) for t in texts], dtype="object")

    return documents.withColumn(text, clean(F.col(text)))


def document_secrets(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    ship(documents.sparkSession)
    scanned = scan(documents.select("doc_id", "text"), vocabulary, pattern).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:3]))
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
