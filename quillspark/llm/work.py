"""Session helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, kept, scratch, shared_dir, written  # noqa: F401

#: Rows of a broadcast id list at most; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few enough; else the join stays a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def without_ids(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids`` (one column, doc_id); rows without a doc_id stay."""
    return docs.join(small(ids.select(F.col("doc_id")), rows), "doc_id", "left_anti").select(docs.columns)


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents with a text, the first by a hash of their id: (doc_id, text, and the columns of labels). Written once.

    Labels without an id are dropped; of repeated labels of a document one is taken. Repeated rows (same doc_id and text) are one
    document; a doc_id with several texts is several documents. So the rows are bounded however often ``docs`` holds an id.
    """
    cols = [c for c in labels.columns if c != "doc_id"]
    picked = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.max(c).alias(c) for c in cols])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    )
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", *[F.col(f"_l_{c}").alias(c) for c in cols])
    rows = written(rows.distinct(), "labelled")
    if rows.count() <= sample:
        return rows
    first = rows.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")).orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample)
    return rows.join(F.broadcast(first), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_semi")
