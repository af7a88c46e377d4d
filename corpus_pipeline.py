"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, as a table, and each calls one
operator of the ``llm`` subpackage. The first four return the columns of
``documents``; the last returns the packed pieces.

Nulls, empty and odd input: a null text counts as empty, is kept by a classifier
that cannot learn, is a near-duplicate of any other text without words, holds no
secret, weighs nothing in the mix and, where the mix takes it, is packed as one
end-of-document id; null metadata are values of their own; rows that repeat an id are told apart by their
words; empty ``documents`` give empty results, and without ``labels`` of both
classes every document is kept; further columns pass through the first four
stages unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import cotraining, mixing, packing, secretscan, simhash_similar
from trawl.llm.shared import table, tidied, written

#: Words of a shingle, and the similarity from which documents are near-duplicates.
SHINGLE, ALIKE = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model, _ = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.kept_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_similar.one_of_each(docs, least=ALIKE, shingle=SHINGLE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a placeholder."""
    model = secretscan.scanner(docs)
    tidied(spark)  # training is many queries, and the scan is a large one
    clean = secretscan.redacted(docs, model)
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return clean.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or left out so that sources meet their targets."""
    mixed = mixing.mixed_documents(docs, share=1.5, most=2)
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return mixed.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, width=2048).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixing_to_targets),
    ("packing", pack),
]

#: The stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
