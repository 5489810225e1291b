"""Documents, filtered and packed for training.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, near_dedup, packing, suffix_dedup, toxicity
from attesta.llm._shared import shared_dir, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on the labelled ones among them, doesn't reject.

    Scores are joined by id and text, so rows that share an id are judged each.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), carry_key=True)
    bad = scores.filter("predicted = 1").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return keyed.join(bad, keyed.doc_id.eqNullSafe(bad.bad_id) & (keyed.text_key == bad.bad_key), "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    gone = near_dedup.near_duplicates(docs)
    kept = gone.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "repeat").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    same = keyed.doc_id.eqNullSafe(kept.kept_id) & keyed.text_key.eqNullSafe(kept.kept_key)
    rows = keyed.join(kept, same)
    once = rows.filter("repeat").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)
    return rows.filter("not repeat").select(*COLUMNS).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that also stand elsewhere.

    A code point of which a byte went is dropped; documents left without text are too.
    """
    cut = suffix_dedup.without_repeats(docs, carry=("lang", "source"))
    text = F.col("kept_text")
    rows = cut.filter((F.col("n_removed") == 0) | (F.trim(text) != ""))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 tokens: doc_id, piece, n_tokens, bin_id, offset."""
    return packing.pack(packing.document_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the first stage is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name, folder)
    return docs
