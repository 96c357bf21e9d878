"""Bounded samples of documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import stored


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (a bounded number of ids) with the least text of each; ids without a row go."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, most: int) -> DataFrame:
    """Stored (doc_id, text, label) of at most `most` labelled documents for which usable(doc_id) holds.

    Ids are taken in the order of their hashes, so reruns agree; only ids are ordered, and only the chosen
    ones (a bounded number) are sent to the tasks that read texts. Of labels given twice the least counts, and of
    rows that repeat an id the least text, so the sample has one row an id."""
    ids = labels.where(F.col(label).isNotNull() & usable(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(_texts(docs, chosen).select("doc_id", "text", "label"), "labelled")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Stored (doc_id, text) of at most `most` documents without a known label, in the order of their ids' hashes; one row an id."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id").distinct()
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left_anti")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(_texts(docs, chosen), "unlabelled")
