from quillspark.plans.store import DocumentStore
from quillspark.streaming.ingest import ingest_stream


def test_stream_adds_each_document_once(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "how to build"), (2, "how to bake"), (3, "how to build")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(src))
    store = DocumentStore.open(spark, str(tmp_path / "store"))
    for checkpoint in ("a", "b"):  # the second run replays everything
        ingest_stream(spark.readStream.schema("doc_id long, text string").parquet(str(src)), store, str(tmp_path / checkpoint)).awaitTermination()
        assert sorted(d.doc_id for d in store.list_documents()) == ["1", "2"]
