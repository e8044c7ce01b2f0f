"""The training-corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import mixing, neardup, packing, quality, rules
from tarnmill.llm.common import Run, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; each row is judged by itself, a null doc_id included."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or are multivariate outliers go; each row is judged by itself, a null doc_id
    included."""
    return rules.judge(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row with the smallest doc_id, rows without one after all
    others. Rows are told apart by themselves: those that share a doc_id are judged by their own texts."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the languages' token totals meet tempered shares; rows with equal
    doc_id and text have equal numbers of copies."""
    plan = mixing.mix(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; a document with several copies has that many runs of pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("mixing to target weights", target_mixing),
    ("packing", sequence_packing),
]

#: SQL can express neither the classifier nor the determinants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    with Run() as tables:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            tables.release(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
