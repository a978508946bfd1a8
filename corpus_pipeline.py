"""From raw documents to packed training sequences: five stages, each one of the training-data operators.

Each stage reads what its predecessor kept, as Parquet, and its decisions take effect; all but the last return the
columns of documents, whatever else these have. Empty tables give empty results; texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ssaflow.llm import mixing, packing, pii, simhash, toxicity
from ssaflow.llm.common import materialise, read_table, release, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null or empty text scores as texts without any learnt term do, and stays; equal texts share their fate; repeated
    rows stay or go together; without usable labels nothing goes, unless all labels are 1.
    """
    release(spark)
    small_batches(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    release(spark)
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: two bits of three-word fingerprints, or a similarity of 0.8.

    The smallest id of a group stays; null, empty and blank texts are one group; rows without an id can't be named by a
    group and stay; of rows that repeat an id one stays.
    """
    release(spark)
    small_batches(spark)
    return simhash.keep_one(docs, width=3, radius=2, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    A null text stays null, an empty one empty; texts without personal data stay as they are; repeated rows get the
    same text each.
    """
    release(spark)
    redacted = pii.redact(docs, pii.fit(spark))
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; n_chars follows the text.

    A null source is a source of its own, ordered last; documents without words are taken zero times and don't come;
    repeated rows are drawn one by one.
    """
    release(spark)
    mixed = mixing.mixed_documents(docs, share=1.5, cap=2.0, weights=(3.0, 1.0, 2.0))
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null text is empty and gives one piece, the end id; a document that comes twice is packed twice under its id.
    """
    release(spark)
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, fingerprints and tokenizers: SQL can't express the stages, which are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
