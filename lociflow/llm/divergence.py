"""Distribution divergence: a document's character classes and common words against references of each language.

References come from the whole corpus: for each language label the shares of eight character classes, and of its common
words, which are those of at most SHORT_WORD code points that make up COMMON_SHARE of its words or more (so there are at
most 1 / COMMON_SHARE of them). Function words are that short in most languages; a language without any is told by its
character classes alone. A document is compared with every reference by Jensen-Shannon distance (base 2, 0 to 1), so a wrong or missing label costs nothing. Documents of fewer than MIN_WORDS words are too short to
compare and pass. Everything is built from DataFrame functions.

How far a text without any common word lies from a reference follows from the share that common words have in it, so word
distances count in units of that: 1 says no more than "none of these words". A document passes if one reference is near
both by its classes and by its words. A reference whose common words have less than LEAST_COVER says nothing by them.

Defined cases: a null or blank text has no words and fails the base rule; without any labelled word there are no
references and only the base rule judges; repeated rows keep their own results; equal distances tell nothing apart, since
only the least one is used; a text of any length is judged whole; an empty table gives an empty one; rows are carried whole,
so columns can't clash, but for those named like the result's, which judge() replaces.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, let, words

#: Character classes; the last one holds what the others leave.
CLASSES = ("lower", "space", "upper", "stop", "symbol", "digit", "letter", "other")
N_CLASSES = len(CLASSES)
SYMBOL = CLASSES.index("symbol")
WINDOW = 8
SHORT_WORD = 6
COMMON_SHARE = 0.0025
MIN_BASE_WORDS = 20
MIN_WORDS = 50
#: Distances beyond which a reference is not near: by classes, where prose of a known language stays below 0.27, and by words,
#: in units of a text without common words; and the least share of common words of a reference that is asked for them.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.98
LEAST_COVER = 0.10


@dataclass(frozen=True)
class References:
    languages: tuple[str, ...]
    classes: tuple[tuple[float, ...], ...]
    vocabulary: tuple[str, ...]
    words: tuple[tuple[float, ...], ...]

    def without_words(self) -> list[float]:
        """For each language the word distance of a text without common words; 0 where words are not asked for."""
        part = lambda p, q: p * math.log2(2 * p / (p + q)) / 2 if p > 0 else 0.0
        whole = [sum(q) for q in self.words]
        return [math.sqrt(w / 2 + part(1.0, 1 - w) + part(1 - w, 1.0)) if w >= LEAST_COVER else 0.0 for w in whole]


def class_counts(df: DataFrame, text: str, out: str = "class_counts") -> DataFrame:
    """Add an array with the number of code points of each class.

    Each step works on what the former ones left. Small letters go together with blanks, as long runs; blanks are
    counted by a plain replacement.
    """
    columns = df.columns
    df = df.withColumn("__t0", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__blank", F.length("__t0") - F.length(F.replace("__t0", F.lit(" "), F.lit(""))))
    for i, pattern in enumerate(("[a-z ]+", "[\\t-\\r]+", "[A-Z]+", "[.,;:!?'\"()-]+", "[#*$%&|<>]", "[0-9]+", "\\p{L}+")):
        df = df.withColumn(f"__t{i + 1}", F.regexp_replace(f"__t{i}", pattern, ""))
    lower, space, *rest = [F.length(f"__t{i}") - F.length(f"__t{i + 1}") for i in range(N_CLASSES - 1)]
    counts = [lower - F.col("__blank"), space + F.col("__blank"), *rest, F.length(f"__t{N_CLASSES - 1}")]
    return df.select(*columns, F.array(*[x.cast("long") for x in counts]).alias(out))


def literal(value, kind: str) -> Column:
    """A constant of any size in one expression; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def short_words(all_words: Column) -> Column:
    return F.transform(F.filter(all_words, lambda w: F.length(w) <= SHORT_WORD), F.lower)


def references(documents: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Learn the references of every label. For each label its sums and 1 / COMMON_SHARE words at most reach the driver."""
    labelled = documents.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = [F.sum(F.col("class_counts")[i]).alias(f"c{i}") for i in range(N_CLASSES)]
    totals = (
        class_counts(labelled.withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")), "text")
        .groupBy("lang").agg(F.sum("n").alias("n"), *sums).where("n > 0").collect()
    )
    totals = sorted(totals, key=lambda r: r.lang)
    if not totals:
        return References((), (), (), ())
    least = F.try_element_at(literal({r.lang: r.n * COMMON_SHARE for r in totals}, "map<string,double>"), F.col("lang"))
    counted = labelled.select("lang", F.explode(short_words(words(F.col("text")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = cut(counted, "short-words")
    # a word that is common in one language also gets its share in the others
    common = {r.word for r in counted.where(F.col("n") >= least).select("word").distinct().collect()}
    vocabulary = tuple(sorted(common))
    found = {(r.lang, r.word): r.n for r in counted.where(F.array_contains(literal(list(vocabulary), "array<string>"), F.col("word"))).collect()} if vocabulary else {}
    return References(
        tuple(r.lang for r in totals),
        tuple(tuple(r[f"c{i}"] / sum(r[f"c{j}"] for j in range(N_CLASSES)) for i in range(N_CLASSES)) for r in totals),
        vocabulary,
        tuple(tuple(found.get((r.lang, w), 0) / r.n for w in vocabulary) for r in totals),
    )


def _half(p: Column, q: Column) -> Column:
    """p's part of the divergence of p and q in one bin."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0)) / 2


def _bin(p: Column, q: Column) -> Column:
    return _half(p, q) + _half(q, p)


def class_distances(counts: Column, references: References) -> Column:
    """Jensen-Shannon distance of the class counts to each reference; null for a text without characters."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = let(total, lambda n: F.transform(counts, lambda x: x / n))
    known = literal([list(r) for r in references.classes], "array<array<double>>")
    distances = let(shares, lambda p: F.transform(known, lambda q: F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, _bin), F.lit(0.0), lambda a, x: a + x)))))
    return F.when(total > 0, distances)


def word_runs(all_words: Column, references: References) -> Column:
    """(index in the vocabulary, count) of each common word of a document: sorted, then cut where the word changes."""
    vocabulary = F.lit(list(references.vocabulary))
    taken = F.sort_array(F.filter(short_words(all_words), lambda w: w.isin(list(references.vocabulary))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        cut = let(starts, lambda b: F.transform(b, lambda i, k: F.struct((F.array_position(vocabulary, F.get(s, i)) - 1).cast("int").alias("v"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("double").alias("c"))))
        return F.when(F.size(s) > 0, cut).otherwise(F.array().cast("array<struct<v:int,c:double>>"))

    return let(taken, runs)


def word_distance(runs: Column, n: Column, references: References, by_classes: Column) -> Column:
    """Least distance of the common-word shares to the references near by their classes, in units of a text without common
    words; 0 if one of them has too few to ask for, null if none is near. All other words are one more bin. A common word
    that the document lacks adds half its reference share, so only the words it has are visited."""
    known = literal([list(r) for r in references.words], "array<array<double>>")

    def against(shares: Column, q: Column) -> Column:
        whole = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
        seen = F.aggregate(
            shares, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p")),
            lambda a, r: F.struct((a.d + let(F.get(q, r.v), lambda x: _bin(r.p, x) - x / 2)).alias("d"), (a.p + r.p).alias("p")),
        )
        return let(seen, lambda s: F.sqrt(F.greatest(F.lit(0.0), s.d + whole / 2 + _bin(F.greatest(F.lit(0.0), 1 - s.p), F.greatest(F.lit(0.0), 1 - whole)))))

    shares = let(n.cast("double"), lambda m: F.transform(runs, lambda r: F.struct(r.v.alias("v"), (r.c / m).alias("p"))))
    none = literal(references.without_words(), "array<double>")

    def relative(p: Column, q: Column, k: Column) -> Column:
        return F.when(F.get(by_classes, k) <= MAX_CLASS_DISTANCE, F.when(F.get(none, k) == 0, F.lit(0.0)).otherwise(against(p, q) / F.get(none, k)))

    return let(shares, lambda p: F.array_min(F.transform(known, lambda q, k: relative(p, q, k))))


def window_hashes(all_words: Column) -> Column:
    """A 64-bit hash of each window of 8 words, by doubling: words, pairs, fours, eights."""
    def pairs(hashes: Column, step: int) -> Column:
        joined = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 1 - step), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))
        return let(hashes, joined)

    hashes, width = let(all_words, lambda w: F.transform(w, lambda x: F.xxhash64(x))), 1
    while width < WINDOW:
        hashes, width = pairs(hashes, width), 2 * width
    return F.when(F.size(all_words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Words that windows found twice or more cover: equal neighbours of the sorted windows give the places, and each place
    adds the words up to the next one, WINDOW at most."""

    def places(s: Column) -> Column:
        here = lambda x, j: F.coalesce(F.get(s, j).h == x.h, F.lit(False))
        same = lambda x, j: here(x, j - 1) | here(x, j + 1)
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.i))

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(marked, places), covered))


def profile(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add words, class_counts and the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    kept = documents.columns
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = class_counts(documents, text)
    df = df.withColumn("words", words(F.col(text))).withColumn("__lines", lines)
    df = df.withColumn("__hashes", window_hashes(F.col("words")))
    df = df.select(
        *kept, "words", "class_counts", F.size("words").cast("long").alias("n_words"),
        (F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("class_counts")[1]).alias("word_chars"),
        F.col("class_counts")[SYMBOL].alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__hashes")).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


ROW, BARRIER = "__lociflow_row", "__lociflow_barrier"
VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def _verdicts(documents: DataFrame, known: References | None, text: str, lang: str) -> DataFrame:
    """(ROW, VERDICT): the whole row goes along as a struct, so no column of it can clash."""
    known = references(documents, text, lang) if known is None else known
    df = profile(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(ROW), F.col(text).alias("text")))
    long_enough = (F.col("n_words") >= MIN_WORDS) & ~F.col("base_failed")
    none = F.lit(None).cast("double")
    df = df.withColumn("__classes", F.when(long_enough, class_distances(F.col("class_counts"), known)) if known.languages else F.lit(None).cast("array<double>"))
    df = df.withColumn("class_distance", F.array_min("__classes"))
    if known.vocabulary:
        df = df.withColumn("__runs", F.when(long_enough, word_runs(F.col("words"), known)))
        df = df.withColumn("word_distance", F.when(long_enough, word_distance(F.col("__runs"), F.col("n_words"), known, F.col("__classes"))))
    else:
        df = df.withColumn("word_distance", none)
    # without a near reference by classes there is no word distance
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    # a filter on the verdict would be pushed below the projections, each of whose columns it would then compute many times
    # over; it can't pass a column that isn't deterministic
    return df.withColumn("kept", ~F.col("base_failed") & fits).select(ROW, *VERDICT, F.monotonically_increasing_id().alias(BARRIER))


def judge(documents: DataFrame, known: References | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add VERDICT; the distances are null where not compared. Columns of `documents` with such names are replaced."""
    kept = [F.col(f"{ROW}.`{c}`") for c in documents.columns if c not in VERDICT]
    return _verdicts(documents, known, text, lang).select(*kept, *VERDICT)


def keep(documents: DataFrame, known: References | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `documents` that pass, unchanged."""
    return _verdicts(documents, known, text, lang).where(F.col("kept") & (F.col(BARRIER) >= 0)).select(f"{ROW}.*")


def document_quality(documents: DataFrame) -> DataFrame:
    return judge(documents.select("doc_id", "text", "lang")).drop("text", "lang", "class_distance", "word_distance")
