"""Corpus pipeline over ``documents``: reject toxic texts, keep one of each near-duplicate group, cut repeated passages, drop benchmark leaks, pack.

Every stage takes what its predecessor kept, is written as Parquet in the shared
folder, and is read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from eventloom.llm.common import forget, materialize, read_table, unused
from eventloom.llm.tokens import tokenizer_path

#: Near duplicates: five words a shingle, a similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts score by the bias alone, repeated rows alike."""
    return toxicity.reject(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")), 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest doc_id.

    Rows without an id all stay, as do empty and null texts, which link with
    nothing.  An id names one document: of rows with the same id and text one
    stays, and rows of one id with other texts stay or go together.
    """
    groups = ngram_join.jaccard_components(docs, SHINGLE, NUM, DEN)
    own = unused("id", docs)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(own)).distinct()
    # Both lists are read twice below; written once, what they come from is planned once.
    gone = materialize(gone, "gone")
    kept = docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
    # Only texts of ids that occur again travel.
    again = docs.groupBy(F.col("doc_id").alias(own)).count().filter(F.col("count") > 1).filter(F.col(own).isNotNull()).select(own)
    again = materialize(again, "again")
    once = kept.join(again, kept["doc_id"] == again[own], "left_anti")
    return once.unionAll(kept.join(again, kept["doc_id"] == again[own], "left_semi").dropDuplicates([docs.columns[i] for i in _places(docs, "doc_id", "text")]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of an earlier document cover; documents of which nothing is left go.

    Rows without an id stay as they are and are no earlier document; rows of one
    id are treated alike; null and empty texts stay.  n_chars follows the text.
    """
    cut = substring_dedup.remove_repeats(docs)
    new = F.col(cut.columns[-1])
    kept = cut.filter(F.coalesce(new != "", F.lit(True)))
    out = {"text": F.coalesce(new, F.col("text")), "n_chars": F.when(new.isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long")) if "n_chars" in docs.columns else None}
    return kept.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is a benchmark item; rows without an id or words match nothing and stay, repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"), SHINGLE, NUM, DEN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 token ids; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def _places(docs: DataFrame, *names: str) -> list[int]:
    low = [c.lower() for c in docs.columns]
    return [low.index(n) for n in names]


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained and graph stages have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(last, "stored_at"):
            forget(last)
    return docs
