"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents
go, personal data is masked, and what is left is encoded.

Each stage reads what the one before wrote as Parquet, so a lost executor costs the tasks of one stage at most. All
stages but the last give the columns of their input, whatever further ones it has. Null and empty texts pass all
stages as they are and have no ids. Rows that repeat a doc_id stay or go together as near-duplicates, and each by its
own text elsewhere; rows of null doc_id are documents of their own. An empty table gives an empty result, and where
labels or benchmark are empty nothing is toxic or contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, minhash, pii, toxicity, viterbi
from granary.llm.common import table
from granary.plans.lineage import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: SQL expresses neither the trained stages nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the one after it is written, the last with the session."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
