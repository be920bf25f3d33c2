"""The corpus pipeline: documents of quality, without boilerplate lines, near copies and benchmark passages, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: a null or empty text is scored by the classifier's bias alone, loses no lines, is nobody's near copy (each stays, but rows that
repeat id and text stay once), holds no benchmark item and has no tokens; null ids, languages, sources and counts are values like any other, and
n_chars is null where the text is; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardatlas.llm import bpe, decontaminate, jaccard, lines, quality, queries
from wardatlas.llm.frames import prepare, stored


def _prepare(spark: SparkSession) -> None:
    """As for single operators, but with small Arrow batches and Parquet row groups: the stages share the executors' memory."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("parquet.block.size", str(16 << 20))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels that are not held out."""
    _prepare(spark)
    return quality.keep_good(docs, quality.learn(queries.labelled(docs, queries.table(spark, sf_dir, "labels"))))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on over a twentieth of their source's pages; n_chars follows the text."""
    _prepare(spark)
    cut = lines.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of 5-word shingles."""
    _prepare(spark)
    return jaccard.keep_one(docs, width=5, num=4, den=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _prepare(spark)
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"), width=5, num=4, den=5)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of the documents, with digests of the ids and of what they decode to."""
    _prepare(spark)
    tokens, pattern = queries.vocabulary()
    return bpe.round_trip(docs, tokens, pattern, share=8).withColumnRenamed("doc", "doc_id")


STAGES = [("quality classifier", good_documents), ("line dedup", without_boilerplate), ("n-gram Jaccard join", without_near_copies),
          ("benchmark decontamination", without_benchmark), ("byte-level BPE", tokenized)]

ORACLE_SQL = None               # SQL cannot express the classifier; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is stored for the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
