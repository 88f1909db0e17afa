"""Spelling variants, exact duplicates and the filter audit against plain Python on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import exact_dedup, filter_audit, spelling_variants

SCHEMA = "doc_id long, text string, source string, word string, n long, key string, row string, id string, mask string, part string, f string"
EXTRA = ("w", 7, "k", "r", "i", "m", "p", "f")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


# --- spelling variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and short in edits(long)


def plain_variants(rows):
    words, out = plain_words(rows), {}
    for w, n in words.items():
        near = [x for x in words if x != w and are_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, n, len(near))
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), n, k, words[f] if f else None) for w, (f, n, k) in out.items())


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abéÿ"), int(rng.integers(6, 9)))) for _ in range(60)]
    base += ["a" * 70, "a" * 71, "a" * 69 + "b", "q" * 64, "q" * 63 + "z", "q" * 65, "Straße", "strasse", "NAÏVETÉ"]
    texts = []
    for w in base:
        texts += [w] * int(rng.choice([5, 6, 30, 160, 900]))
    rng.shuffle(texts)
    rows = [(i if i % 11 else None, " ".join(texts[at : at + 40]) + ". short ×÷×÷×÷ 日本 " + texts[at] * (i % 3 == 0), "s") for i, at in enumerate(range(0, len(texts), 40))]
    return [*rows, rows[0], rows[0], (5, None, None), (6, "", "s"), (7, "x" * 3_000, None)]


@pytest.mark.parametrize("shard_words", [10_000, 7])
def test_variants(spark, spelled, shard_words):
    got = table(spark, spelled).transform(spelling_variants.variants, shard_words=shard_words).collect()
    want = plain_variants(spelled)
    assert len(want) > 40 and any(r[2] not in (r[0], r[1]) for r in want)  # some chains have two steps
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want


def test_no_variants(none):
    assert none.transform(spelling_variants.variants).count() == 0


def test_pieces_of_a_text_end_between_runs():
    text = "word " * 50 + "l" * 400 + " end"
    for size in (1, 7, 64, 10_000):
        assert "".join(spelling_variants.pieces(text, size)) == text
        one, other = Counter(), Counter()
        spelling_variants.words_of("1", text.encode(), one, size)
        spelling_variants.words_of("1", text.encode(), other)
        assert one == other


def test_edits_by_columns():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("ab"), int(rng.integers(1, 6)))).encode() for _ in range(60)]
    pairs = [(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2]
    left, right = ([x[i] for x in pairs] for i in (0, 1))
    (a, na), (b, nb) = (spelling_variants.matrix(x) for x in (left, right))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    good, start = spelling_variants.near(a, na, b, nb)
    for x, y, g, s in zip(left, right, good, start, strict=True):
        assert (bool(g), int(s)) == spelling_variants.one_edit(x, y)
        assert bool(g) == (x != y and are_near(x.decode(), y.decode()))


# --- exact duplicates


def copies():
    long = "abcdé " * 60
    return [
        (1, "same", "s"), (9, "same", "s"), (4, "same", None), (2, "other", "s"), (3, None, "s"), (5, "", "s"), (None, "alone", "s"), (None, "same", "s"), (6, long, "s"), (7, long, "t"), (8, long + "x", "s"),
        (8, long + "y", "s"), (10, "twice", "s"), (10, "twice", "s"), (11, "\0" * 8, "s"), (12, "\0" * 9, "s"), (13, "x" * 100_000, "s"), (14, "x" * 100_000, "s"), (15, "x" * 99_999 + "y", "s"),
        *[(100 + i, f"t{i}", "s") for i in range(40)],
    ]


@pytest.mark.parametrize(("size", "bits"), [(1 << 16, 62), (7, 62), (64, 3), (1 << 16, 0)])
def test_exact_classes(spark, none, size, bits):
    """With few bits nearly all fingerprints of a length collide, and the comparison parts them."""
    got = table(spark, copies()).transform(exact_dedup.exact_classes, size=size, bits=bits).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in copies():
        groups[text or ""].append(doc_id)
    last = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted([(i, last[t], len(ids), digest(t)) for t, ids in groups.items() for i in ids], key=key)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == {digest(t): 1 for t in groups} and all(r.id == r.keep_id for r in got if r.kept)
    assert none.transform(exact_dedup.exact_classes).count() == 0


def test_fingerprints_compose():
    data = np.random.default_rng(1).integers(0, 256, 150_000, dtype=np.uint8).tobytes()
    whole = tuple(sum(c * pow(x, i, p) for i, c in enumerate(data[:5_000])) % p for p, x in zip(exact_dedup.PRIMES, exact_dedup.POINTS, strict=True))
    for size in (1, 999, 5_000):
        parts = [exact_dedup.chunk_hash(data[at : at + size], at) for at in range(0, 5_000, size)]
        parts[-1] = exact_dedup.chunk_hash(data[(5_000 - 1) // size * size : 5_000], (5_000 - 1) // size * size)
        assert exact_dedup.composed(parts) == whole
    some = [exact_dedup.composed([exact_dedup.chunk_hash(data[at : at + n], at) for at in range(0, len(data), n)]) for n in (exact_dedup.CHUNK, 4_321)]
    assert some[0] == some[1]


def test_chunk_size_is_bounded(none):
    with pytest.raises(ValueError):
        exact_dedup.fingerprints(none, size=exact_dedup.CHUNK + 1)


# --- filter audit


def audited():
    long = " ".join(f"w{i % 150}" for i in range(300))
    return [
        (1, long, "a"), (2, long, "a"), (0, long, "b"), (3, None, "a"), (4, "", None), (5, "LOUD " * 300, "b"), (6, "x # y", "b"), (7, "é É" * 5, "a"), (None, long, "a"), (None, "lonely", "a"), (8, "a b c d", None), (8, "a b c d", None), (9, "a b c d", "a"),
        (10, " ".join(f"w{i}" for i in range(250)), "a"), (11, " ".join(f"w{i}" for i in range(250)) + " A&B", "b"), (12, "z" * 200_000, "b"), (13, "\x1c\x85 one", "a"),
    ]


def plain_mask(rows):
    least = {}
    for doc_id, text, _ in rows:
        t = text or ""
        if doc_id is not None and (t not in least or doc_id < least[t]):
            least[t] = doc_id
    out = []
    for doc_id, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), t in least and (doc_id is None or doc_id > least[t])]
        out.append((doc_id, part or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}))
    return out


def plain_audit(rows, labels):
    docs, out = plain_mask(rows), {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        whole = Counter()
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, name in enumerate(order, 1):
                before = set(gone)
                removed = [k for k, (_, f) in enumerate(mine) if name in f and k not in before]
                gone.update(removed)
                whole[name] += len(removed)
                lost = lambda field, some=removed: sum(labels.get(mine[k][0], (0, 0))[field] == 1 for k in some)
                out[part, order, step] = [len(mine) - len(gone), len(removed), sum(name in f and k in before for k, (_, f) in enumerate(mine)), sum(f == {name} for _, f in mine), lost(0), lost(1), name]
        for (p, order, step), row in out.items():
            if p == part:
                row[-1] = whole[order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, none):
    labels = {1: (1, 0), 2: (1, 1), 5: (0, 1), 8: (1, 0), 12: (None, 1), 77: (1, 1)}
    table_of = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(table(spark, audited()), table_of).collect()}
    assert got == plain_audit(audited(), labels) and len(got) == 3 * 120 * 5
    assert filter_audit.audit(none, table_of).count() == 0


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_collisions_stay_in_their_chain(spark, held):
    """All texts have one hash: the chain parts them by their full text."""
    rows = spark.sparkContext.parallelize([(i, part, (text or "").encode()) for i, text, part in audited()], 4)
    found = filter_audit.repeats(rows, 3, hash_of=lambda text: 5, held_bytes=held).collect()
    got = Counter()
    for doc_id, _, n, repeated in found:
        got[doc_id, repeated] += n
    assert got == Counter((i, "E" in f) for i, _, f in plain_mask(audited()))


def test_non_minimum_ids(spark):
    got = filter_audit.non_minimum_ids(table(spark, audited())).collect()
    assert sorted(-1 if r.id is None else r.id for r in got) == sorted({-1 if i is None else i for i, _, f in plain_mask(audited()) if "E" in f})


def test_one_text_is_a_record_a_task(spark):
    """Thousands of copies: no partition gets more than one record of each task for them."""
    docs = spark.range(20_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    found = filter_audit.masks(docs).groupBy((F.col("mask") >= filter_audit.REPEATED).alias("again")).agg(F.sum("n").alias("n"), F.min("id").alias("first")).collect()
    assert {(r.again, r.n) for r in found} == {(True, 19_999), (False, 1)} and min(r.first for r in found) == 0
