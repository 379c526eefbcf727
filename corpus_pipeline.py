"""From raw documents to packed training sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before
kept. All but the last return the columns of ``docs``. ``run`` stores every stage as Parquet and reads
it again, so a lost executor never sends the work back to the start.

Defined results: a null or empty text has no quality and goes in the first stage; equal texts share
their fate up to the third, which keeps the least doc_id; of rows that share a doc_id one stays there, and
rows without one stay unless a kept row has their text; null lang, source and n_chars stay as they are;
very long texts are read whole; further columns are kept, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import contexts, divergence, near_copies, neighbours, packing
from reelmill.llm.batches import other_name
from reelmill.llm.queries import table, tokenizer_path
from reelmill.session import store

#: A stage needs model fitting, iteration or a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from the labels of the documents at hand; held-out rows teach nothing here either.
    """
    model = neighbours.fit(docs, neighbours.learnable(table(spark, sf_dir, "labels")))
    column = other_name("_score", docs.columns)
    return neighbours.score(docs, model, column).where(F.col(column) >= neighbours.THRESHOLD).drop(column)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return divergence.accepted(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return near_copies.without_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return contexts.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_regular),
    ("near_copies", keep_one_of_each),
    ("personal_data", hide_personal_data),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
