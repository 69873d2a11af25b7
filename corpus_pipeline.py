"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes all documents its predecessor kept; its result is written as Parquet in the shared folder
and read again as the next one's documents. All but the last return the columns of documents.

Rejected documents go; repeated lines go, and with them documents that have no other line; of each group of
near copies the smallest id stays; documents that hold a passage of the benchmark go; what is left is
encoded. Documents that are null or empty before the stages are kept by all but the quality classifier,
which scores an empty text as it scores any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import decontamination, line_dedup, ngram_join, quality, sentencepiece_tokens
from recallgrid.llm.common import stored, table, unused


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.learned(spark, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier; a document of which nothing is left goes."""
    lines, removed = unused(docs, *line_dedup.ADDED)
    out = line_dedup.rewritten(docs, columns=[lines, removed]).where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join: word shingles of five, similarity 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, parity, round_trip) of each document."""
    encoded = sentencepiece_tokens.encode(docs, sentencepiece_tokens.model_bytes(spark))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "parity", "round_trip")


STAGES = [
    ("quality", good),
    ("lines", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]

#: The classifier and the tokens can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
