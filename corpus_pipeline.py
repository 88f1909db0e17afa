"""A corpus pipeline of five stages, each by one operator of lociflow.llm.

1 quality    drops documents that fail the base rule or diverge from every language reference
2 dedup      keeps one document of each group of near copies: SimHash as a filter, exact similarity of shingle sets as the judge
3 secrets    masks secrets in the texts
4 mix        takes each document 0, 1 or 2 times to meet the sources' targets
5 pack       packs the tokens into sequences; its rows are pieces

A stage's result is written as Parquet in the shared folder and read again as the next one's documents; it is removed when
the next one's is written. All but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty one; columns beside those named are carried whole, whatever their
names; texts may have any length. A null or blank text fails the base rule and goes in `quality`; given to the later
stages, it is a copy of all other blank texts, holds no secret, adds no words to the mix and packs as one token. A null identifier stays in `dedup` only where its group has no other; a null source is a source of its own in `mix`,
the last. Rows alike in identifier and text are copies; of copies the smallest identifier stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import divergence, mixing, near_copies, packing, secret_scan
from lociflow.llm.shared import new_folder, passing, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: SQL has no SimHash, no random draws of the mix and no tokenizer; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        with passing():  # what a stage has written for itself goes when its result is there, and so does the result before
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
