"""The corpus pipeline: each stage applies one operator to all that the stage before has kept.

Stages take (spark, docs, sf_dir) and return the columns of documents; the last returns the mix. `run` writes
each stage's rows as Parquet to the shared folder and reads them back for the next, so that an executor lost late
costs one stage at most.

Defined results: null and empty texts go through every stage (the classifier scores them, they are near-duplicates of each
other, have no hits and no personal data, and the mix takes no word of them, so the last stage leaves them out); rows without
or with repeated ids are rows of their own; of rows that agree in id and text one stays; ties in the near-duplicate
stage go to the smallest doc_id, null last; empty tables give no rows, without labels nothing is rejected and without benchmark
items nothing is contaminated; other columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontam, mixing, pii, quality, simhash
from fieldloom.llm.common import fresh_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: the documents that it takes with their texts, and how many of their words (repeats counted)."""
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("source mix", mixing_stage),
]

#: SQL can express neither the classifier nor the personal-data stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
