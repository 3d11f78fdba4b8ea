"""A training corpus from documents: languages, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. Between stages the rows are written as Parquet
into the cluster's shared folder and read again, so a lost executor costs a reread.

All stages take empty tables (nothing comes out), repeated rows (each is treated like its
first), very long texts (read whole) and further columns of any name (kept up to packing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import dedup, langid, packing, pii
from tandem.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects (no letters, or too low a calibrated score) go.

    A null or empty text is rejected; null ids and languages are no reason to go. Without any
    known language nothing can be learned and every document goes.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 or more stays: that with the smallest doc_id.

    Rows of that doc_id all stay; texts without words and rows with a null doc_id link with
    nothing and stay.
    """
    return dedup.keep_one_of_each(docs, dedup.STAGE_LEAST)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans are replaced by their kind; every document stays.

    A null text stays null; n_chars follows the text.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null text is the end token alone; a null doc_id is packed like any other. The workers
    have run three stages before, so they hold a smaller memo than usual.
    """
    return packing.pack_documents(docs, entries=100_000)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models and registers are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
