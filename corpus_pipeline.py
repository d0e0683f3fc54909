"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. A table
without rows passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, neardup, packing, quality, toxicity
from quillspark.llm.work import fresh_path

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", neardup.stage),
    ("benchmark decontamination", decontam.stage),
    ("best-fit packing", packing.stage),
]

#: SQL can express neither trained classifiers nor fingerprints; tests/llm hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
