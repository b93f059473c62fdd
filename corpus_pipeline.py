"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Language identification rejects texts without an identifiable language; exact and near
duplicates go, one document of each group stays; sources are mixed to target weights,
in whole documents and up to three passes; the mix is encoded, and decoded again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, with the columns of
``documents`` for all but the last. Null texts, empty tables and repeated rows are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, exact, langid, mixing, simhash
from heddle.llm.queries import BYTE_BPE, PIECES
from heddle.llm.shared import Stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the models learn from all labelled documents."""
    return langid.keep_identified(docs, langid.train(docs, PIECES))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, once for each pass that takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of ids and of the decoded text."""
    coded = bpe.round_trip(docs, BYTE_BPE)
    return coded.select(
        "doc_id",
        "n_tokens",
        "ids_le",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the language models nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet, read again, and deleted once the next one is written."""
    stage = Stage(spark, "pipeline")
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        docs = stage.table(step(spark, docs, sf_dir), name)
        stage.drop(made)
        made = docs
    return docs
