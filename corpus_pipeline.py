"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage works on all rows its predecessor kept; all but the last return the columns of
``documents``.  SQL cannot express the learnt and hashed stages, so ``ORACLE_SQL`` is None and
the tests hold a run against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.llm import language_id, lines, mixing, near_copies, packing
from cinestat.session import kept

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents that fit no language go."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    told = language_id.identify(docs, model, docs.columns, prefix="__")
    return told.where(~language_id.rejected("__")).select(
        *[F.col("__lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated multi-line chunks; every document stays, ``n_chars`` follows its text."""
    clean = lines.dedup(docs)  # further columns it adds are not selected
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard >= 0.8) stays: the one with the smallest number."""
    return near_copies.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs)
    return docs
