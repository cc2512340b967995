"""Bounded training samples: labelled rows outside the held-out fold, drawn by hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Most labelled rows that a model is fitted on.  A documented bound: the sample
#: is broadcast and its features go to the driver.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled ids whose crc32(doc_id) mod 5 is not 0; of texts that share an id the greatest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    drawn = known.filter(crc_fold("_id") != 0).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One row an id, however often it is repeated: the bound is one of rows.
    met = texts.join(F.broadcast(drawn), texts["doc_id"] == drawn["_id"]).groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "y")).alias("z"))
    return met.select("doc_id", "z.text", "z.y")
