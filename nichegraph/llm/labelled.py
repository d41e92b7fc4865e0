"""Labelled rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows that a classifier is fitted on at most. The bound holds for fitting alone; all rows are scored.
MOST_ROWS = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, label) of documents with a label whose id isn't held out: all, or the `most` with the lowest hashes.

    Labels other than 0 and 1 and null ids are left out; an id with several labels has the largest. Where ids repeat
    so often that the rows are more than `most`, equal rows count once, and of the others those with the lowest hashes of
    id and text are taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~shared.held_out(F.col("doc_id"), divisor, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = shared.texts(docs)
    if rows.select("doc_id").join(chosen, "doc_id").count() <= most:
        return rows.join(chosen, "doc_id").select("doc_id", "text", "label")
    rows = rows.join(chosen, "doc_id").withColumn("hash", F.xxhash64("doc_id", "text"))
    lowest = rows.select("doc_id", "hash").distinct().orderBy("hash", "doc_id").limit(most)
    return rows.join(F.broadcast(lowest), ["doc_id", "hash"]).groupBy("doc_id", "hash", "label").agg(F.first("text").alias("text")).select("doc_id", "text", "label")
