"""Streaming additions to a document store: every micro-batch goes through the store's own deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import DocumentStore


def ingest_stream(stream: DataFrame, store: DocumentStore, checkpoint: str, order: str = "doc_id", trigger: dict | None = None) -> StreamingQuery:
    """Adds the documents of a stream (doc_id, text) to ``store``; ``order``: a whole number that orders a batch.

    A batch that is replayed after a failure adds nothing twice: its ids and texts are there already.
    """

    def add(batch: DataFrame, _: int) -> None:
        store.add_documents(batch.select(F.col(order).cast("long").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), "text"))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
