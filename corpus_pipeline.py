"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

STAGES lists them in order; run() writes each stage's rows as Parquet to the shared folder and reads them
for the next. A stage takes (spark, docs, sf_dir) and returns documents with the same columns, but for the
last, which adds token ids. SQL cannot express the stages, so they are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, mixing, ngram_join, pii, toxicity
from tramline.llm.common import stored, table


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores under 0.5."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of links (five words, similarity 0.8)."""
    return ngram_join.deduplicated(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in angle brackets."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.resampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids (binary, little-endian 32 bits) and their number."""
    return bpe.encode(docs).withColumn("n_tokens", F.expr("length(ids) div 4"))


STAGES = [
    ("toxicity", no_toxic),
    ("near_duplicates", no_near_copies),
    ("personal_data", no_personal_data),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL cannot train the classifiers nor encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
