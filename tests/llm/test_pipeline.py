"""The pipeline as a whole, and its stages against what each is to do."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lociflow.llm.catalog import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    common = "the of and to in is was that for on with as by at".split()
    words = common * 40 + ["".join(rng.choice(list("abcdefghilmnoprstu"), 5)) for _ in range(900)]
    texts = [" ".join(rng.choice(words, 160)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, texts[i], "en", "s0", 1) for i in range(30)]  # copies
    rows += [(600, "#### %%%% " * 90, "en", "s1", 1), (601, "same words again and again in one line " * 30, "en", "s1", 1), (602, None, None, None, None), (603, texts[7] + " password=hunter2hunter2", "en", "s2", 1)]
    rows += [(604, " ".join(rng.choice(words, 160)) + " api_key: 0123456789abcdefXYZ", "en", None, 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    docs = corpus_pipeline.quality(spark, docs, folder).cache()
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {*range(120), *range(500, 530), 603, 604}
    docs = corpus_pipeline.dedup(spark, docs, folder).cache()
    assert {r.doc_id for r in docs.collect()} == {*range(120), 604} and docs.count() == 121
    docs = corpus_pipeline.secrets(spark, docs, folder).cache()
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert text[604][0].endswith(" [REDACTED]") and text[604][1] == len(text[604][0]) and "[REDACTED]" not in text[3][0]
    mixed = corpus_pipeline.mix(spark, docs, folder).cache()
    assert mixed.columns == columns and {r.text for r in mixed.collect()} <= {t for t, _ in text.values()}
    packed = corpus_pipeline.pack(spark, mixed, folder).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(known.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_run(spark, folder):
    got = queries()["pipeline"](spark, folder)
    assert got.count() > 0 and [name for name, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "secrets", "mix", "pack"]


def test_the_run_is_its_stages(spark, folder):
    """Every piece of run() belongs to a document that the stages before keep, each text as often as the mix takes it, and
    the pieces of all copies make up their tokens."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(known.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_awkward_rows(spark, folder):
    """Nulls, repeats, empty and very long texts, several languages, and columns named like those that the stages use."""
    long = " ".join(f"w{i}" for i in range(5_000))
    prose = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40").orderBy("doc_id").collect()]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}") for i, t in enumerate(prose)]
    rows += [(3, prose[3], "en", "s1"), (3, prose[3], "en", "s1"), (3, prose[5] + " and more of it", "en", "s1"), (None, None, None, None), (None, prose[6], None, None), (None, prose[6], None, None), (90, "", "en", "s0"), (91, " \t\n", "en", None), (92, long, "en", "s0"), (93, "q" * 50_000, "en", "s0")]
    extra = ("__copies", "__words", "__mix_row", "row", "k1", "spans", "kept", "whole", "maybe", "n_words")
    data = [(*r, None if r[1] is None else len(r[1]), *(["x"] * len(extra))) for r in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.where("false")):
            out = stage(spark, some, folder)
            n = out.count()
            if name == "pack":
                assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
            else:
                assert out.columns == columns and out.where("n_words <> 'x'").count() == 0
            if name == "dedup" and some is docs:
                kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in out.collect())
                assert len(set(kept)) == n and sum(k == 3 for k, _ in kept) == 2 and (-1, prose[6]) not in kept
            if name == "secrets" and some is docs:
                assert n == len(rows)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_catalog():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(oracle_sql()) <= set(names)
