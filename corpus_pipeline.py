"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows that its predecessor kept.  All but the last return the columns of
documents.  `run` writes each stage's result as Parquet in the session's
checkpoint folder and reads it again, so a lost executor never costs more than
the stage at hand.

Every stage takes whole texts, however long, and leaves columns of any name alone.
Nulls: rows with null texts pass the filters as empty texts (all rows of equal
fingerprint are one group), have size 0 in the mix and so are not taken by it.
An empty table goes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm.common import ensure_checkpoint_dir, read_table
from tarnflow.llm.mixing import apply_mix
from tarnflow.llm.packing import pack_documents
from tarnflow.llm.pii import redact
from tarnflow.llm.simhash import keep_one
from tarnflow.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go: a score of 0.5 or more; rows of one id and text go or stay together."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id; of several rows of that id, the least by a hash of all columns."""
    return keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data gives way to its kind in brackets; of overlapping spans the first and longest."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks; which of equal ones are taken a hash of the row decides."""
    return apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("simhash", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hashing and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
