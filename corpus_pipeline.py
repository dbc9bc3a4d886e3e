"""A corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's result as Parquet to the shared folder and reads it back
for the next. Nulls, empty texts, repeated rows and empty tables have the results that the
operators define: empty texts are scored like any other, rows of a null doc_id pass the
near-duplicate stage, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridio.llm import simhash_dedup, subsequence_toxicity, subword_quality, temperature_mix, vector_packing
from meridio.llm.common import free_name, write_table
from meridio.llm.queries import QUALITY_FROM, TOXIC_FROM, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under the threshold."""
    model = subword_quality.train(docs, table(spark, sf_dir, "labels"))
    return subword_quality.score_documents(docs, model).where(F.col(free_name(docs.columns, "score")) >= QUALITY_FROM).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold."""
    machine = subsequence_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return subsequence_toxicity.score_documents(docs, machine).where(F.col(free_name(docs.columns, "score")) < TOXIC_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each component of near duplicates: 5-word shingles of Jaccard 0.8 or more."""
    return simhash_dedup.keep_one(docs, words=5).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of rare sources to the target weights; every document is read once at least."""
    return temperature_mix.mix(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences: one row for each piece."""
    return vector_packing.pack_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the learned models nor XXH64 fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir), name)
    return docs
