"""From raw documents to packed training sequences: each stage works on what the stage before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import jaccard_join, packing, secrets, suffix_dedup, toxicity
from pairwright.llm.text import tidy
from pairwright.session import delete_folder, shared_folder
from pairwright.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, "source")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# Learnt classifiers and a tokenizer are in the stages, so SQL cannot say what they return.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is removed once the next one has read it, and the last table is the caller's."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        tidy(name)  # a stage's fit does not stay with the driver
        if before is not None:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
