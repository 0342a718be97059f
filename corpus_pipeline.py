"""A corpus pipeline: each stage applies one operator to what the stage before has kept.

``run`` writes each stage's rows as Parquet to the folder that executors share and reads them again. Stages add no columns
(but the last, which is the mix itself) and drop a document only by their decision. They decide row by row, whether a doc_id
is null, shared or unique.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, mixing, near_dedup, quality_rules, secrets
from llm.shared import free_name, numbered, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (of several such rows, or of none with an id, the first)."""
    row = free_name(docs, "row_number")
    rows = numbered(docs, row)
    found = near_dedup.find(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")
    stays = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first)
    return rows.join(stays.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go, whole: what is left around a leak gives it away, too."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, n_chars follows its text."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, with size, source_size, target and copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("secret scan", secret_spans),
    ("mixing", mixture),
]

#: The quality stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
