"""Language identification for texts that may mix languages.

Learning: a bounded sample of labelled documents (SAMPLE documents of each language are expected) gives, for each
language, log probabilities of hashed character n-grams and the scripts that make up SCRIPT_SHARE of its letters.
Prediction: a word's script narrows the candidates; each candidate gets the word's mean log probability times its length;
a Viterbi pass over the words, which pays PENALTY to switch, labels spans. The language that holds most letters is the
document's, and its share of the letters is the score.

Most texts need no pass over every word: if no run of words anywhere gains more than half the penalty over the best
single language, then staying in it is the best path, and two cumulative sums show that.

Every label is learned. The model has BUCKETS scores a language, in a row of bytes; the rows are brought together and sent
to the workers, so it is 128 KB a language: some hundred labels fit any worker, and labels are languages.

Defined cases: a null or empty text or one without a letter is `und` with score 0; without labelled documents all are
`und`; repeated rows are labelled alike; a null identifier is not held out and does not teach; of languages that hold
equally many letters, or score alike, the first by name is told; a text of any length is scored by its different words; an
empty table gives an empty one; columns of the documents named like the result's are replaced.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import ship, uniform

SAMPLE = 2_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PENALTY = 12.0
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
#: Words whose scores a worker remembers, besides those of the batch at hand; a full memory is emptied.
MEMORY = 300_000
UNKNOWN = "und"
#: First code points of script ranges, and their scripts; what follows a range is the next one.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
STARTS, SCRIPTS = [r[0] for r in RANGES], [r[1] for r in RANGES]
#: Runs of word characters without decimal digits. Numerals of other kinds count among them; only words that hold one are split.
RUN = re.compile(r"[^\W\d_]+")


def alphabetic(word: str) -> list[tuple[int, str]]:
    """(place, part) of the parts of a word that are all letters."""
    out, at = [], 0
    for is_letter, part in groupby(word, str.isalpha):
        part = "".join(part)
        if is_letter:
            out.append((at, part))
        at += len(part)
    return out


def letter_runs(text: str) -> list[str]:
    """Runs of letters."""
    found = RUN.findall(text)
    odd = set() if text.isascii() else {w for w in set(found) if not w.isalpha()}
    if not odd:
        return found
    return [part for w in found for part in ([x for _, x in alphabetic(w)] if w in odd else (w,))]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(STARTS, ord(letter)) - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of all character n-grams of all words, their ends marked: one pass over all their
    characters for each order."""
    codes = np.frombuffer(("^" + "$\n^".join(words).lower() + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = codes == 10
    number = np.cumsum(breaks)
    number[breaks] = -1
    where, buckets = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        mixed = mixed[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in ORDERS:
            held = (number[: len(mixed)] == number[n - 1 :]) & (number[: len(mixed)] >= 0)
            h = mixed[held]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            where.append(number[: len(mixed)][held])
            buckets.append(((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int64))
    return np.concatenate(where), np.concatenate(buckets)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are not held out. A packed row for each language reaches the driver."""
    ship(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), {})
    languages = sorted(r.lang for r in counts)
    shares = F.from_json(F.lit(json.dumps({r.lang: min(1.0, sample / r.n) for r in counts})), "map<string,double>")
    drawn = rows.where(uniform(F.lit(11), F.col("id")) < F.try_element_at(shares, F.col("lang")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for b in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(letter_runs(text))
            for lang, words in found.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if words:
                    where, buckets = grams(list(words))
                    total += np.bincount(buckets, np.fromiter(words.values(), np.float64, len(words))[where], BUCKETS).astype(np.int64)
                for word, n in words.items():
                    scripts[lang, script_of(word[0])] += n * len(word)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array([None] * len(used), pa.string()), pa.array(total[used], pa.int64())], names=["lang", "bucket", "script", "n"])
        keys = list(scripts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([-1] * len(keys), pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([scripts[k] for k in keys], pa.int64())], names=["lang", "bucket", "script", "n"])

    def packed(group: pa.Table) -> pa.Table:
        """One row for a language: the sums of its buckets as bytes, and those of its scripts."""
        lang, bucket, script, n = (group.column(i).to_pylist() for i in range(4))
        total = np.zeros(BUCKETS, np.int64)
        held: dict[str, int] = {}
        for i, b in enumerate(bucket):
            if b >= 0:
                total[b] = n[i]
            else:
                held[script[i]] = n[i]
        return pa.table({"lang": pa.array([lang[0]], pa.string()), "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), "scripts": pa.array([json.dumps(held)], pa.string())})

    sums = drawn.select("text", "lang").mapInArrow(gather, "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    letters: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").applyInArrow(packed, "lang string, sums binary, scripts string").collect():
        table[place[r.lang]] += np.frombuffer(zlib.decompress(r.sums), np.int64)
        for script, count in json.loads(r.scripts).items():
            letters.setdefault(script, np.zeros(len(languages)))[place[r.lang]] += count
    whole = sum(letters.values()) if letters else np.ones(len(languages))
    scores = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, scores, {s: x / np.maximum(whole, 1) >= SCRIPT_SHARE for s, x in letters.items()})


def best_path(emission: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi: the label of each row that maximizes the sum of emissions less `penalty` for each change.

    All switches come from the row's best label, so a row keeps that one and who would switch to it.
    """
    rows = emission.tolist()
    score, tops, switched = rows[0], [], []
    for row in rows[1:]:
        best = max(score)
        least = best - penalty
        tops.append(score.index(best))
        switched.append([x < least for x in score])
        score = [(least if x < least else x) + e for x, e in zip(score, row, strict=True)]
    at = score.index(max(score))
    path = [at]
    for top, moved in zip(reversed(tops), reversed(switched), strict=True):
        if moved[at]:
            at = top
        path.append(at)
    return np.array(path[::-1])


def labels(emission: np.ndarray, penalty: float) -> np.ndarray:
    """best_path, without its loop where one language surely holds throughout."""
    best = int(emission.sum(axis=0, dtype=np.float64).argmax())
    gain = np.zeros((len(emission) + 1, emission.shape[1]))
    np.cumsum(emission - emission[:, best : best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(emission), best)
    return best_path(emission, penalty)


class Labeller:
    def __init__(self, model: Model, penalty: float = PENALTY) -> None:
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((4_096, len(self.model.languages)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """Mean log probability of each word's n-grams times its length; languages of other scripts fall behind."""
        where, buckets = grams(words)
        held = np.bincount(where, minlength=len(words))
        length = np.fromiter(map(len, words), np.float64, len(words))
        out = np.stack([np.bincount(where, row[buckets], len(words)) for row in self.model.scores], axis=1) * (length / held)[:, None]
        first = np.searchsorted(STARTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right") - 1
        for i in set(first.tolist()):
            fits = self.model.scripts.get(SCRIPTS[i])
            if fits is not None and fits.any() and not fits.all():
                rows = first == i
                out[rows] = np.where(fits, out[rows], out[rows].min(axis=1, keepdims=True) - self.penalty)
        return out

    def learn(self, found: list[list[str]]) -> None:
        """Score the words of some texts that are not known yet, all at once."""
        if len(self.known) > MEMORY:
            self.clear()
        new = list(set().union(*found).difference(self.known))
        if new:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.table) < len(self.known):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = self.score(new)

    def rows(self, words: list[str]) -> np.ndarray:
        return self.table[list(map(self.known.__getitem__, words))]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of words, in code points."""
        found = [(m.start() + at, part) for m in RUN.finditer(text or "") for at, part in (((0, m[0]),) if m[0].isalpha() else alphabetic(m[0]))]
        if not found or not self.model.languages:
            return []
        words = [part for _, part in found]
        self.learn([words])
        path, out = labels(self.rows(words), self.penalty), []
        for (at, part), label in zip(found, path, strict=True):
            if out and out[-1][2] == self.model.languages[label]:
                out[-1] = (out[-1][0], at + len(part), out[-1][2])
            else:
                out.append((at, at + len(part), self.model.languages[label]))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found, out = [letter_runs(t or "") for t in texts], []
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(found)
        self.learn(found)
        for words in found:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            path = labels(self.rows(words), self.penalty)
            held = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(self.model.languages))
            top = int(held.argmax())
            out.append((self.model.languages[top], float(held[top] / held.sum())))
        return out


def predict(documents: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add lang_pred and score. The model is bounded, see learn()."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value, penalty)
        for texts in parts:
            yield pd.DataFrame(labeller.predict(texts.tolist()), columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.withColumn("__label", label(F.col(text_col))).select(*kept, "__label.lang_pred", "__label.score")


def language_spans(documents: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add `lang_spans`: array of struct(start, end, lang)."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:long,end:long,lang:string>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(sent.value, penalty)
        for texts in parts:
            yield pd.Series([[{"start": a, "end": b, "lang": x} for a, b, x in labeller.spans(t)] for t in texts], dtype="object")

    return documents.withColumn("lang_spans", find(F.col(text_col)))


def document_languages(documents: DataFrame) -> DataFrame:
    model = learn(documents)
    return predict(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
