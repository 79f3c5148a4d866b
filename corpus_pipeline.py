"""A corpus pipeline of five stages, each one operator of ``millrace.llm``.

Quality rules reject documents, near-duplicate groups keep one document,
repeated passages lose their later copies, secrets are masked, and what is left
is packed into training sequences.  Each stage works on all that its
predecessor kept; all but the last return the columns of ``documents``.

Documents with null ids are documents like others: a near-duplicate group
without any id keeps one of its texts.  Rows equal in id and text count as
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near, packing, quality, secrets, substrings
from millrace.llm._common import durable
from millrace.llm.queries import table, tokenizer_file

REST = ["lang", "source", "n_chars"]
COLUMNS = ["doc_id", "text", *REST]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a rule or the likelihood ratio rejects."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), carry=["text", *REST])
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: of the least id, nulls last, and then of the least text hash.

    Texts are near-duplicates from a similarity of 0.8 of their sets of
    five-word shingles on; each link is compared exactly.
    """
    keep = near.kept(docs, shingle=5, similarity=0.8).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that earlier documents have; documents of which nothing is left go."""
    found = substrings.remove_repeats(docs, carry=REST).where("n_removed = 0 or n_removed < n_words")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found."""
    found = secrets.find(docs, carry=["text", *REST])
    masked = found.select("doc_id", secrets.masked(F.col("text"), "spans").alias("text"), *REST, (F.size("spans") > 0).alias("changed"))
    n_chars = F.when(F.col("changed"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the first's base rules can be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
