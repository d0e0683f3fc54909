"""The pipeline against its stages in plain Python, and the folder's queries against SQL."""

import shutil
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import neardup, packing, quality, registry, toxicity

from test_decontam import LEAST, TOL, plain_distance, plain_words
from test_neardup import brute

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        src = SF / f"{t}.parquet"
        shutil.copytree(src, d / src.name) if src.is_dir() else shutil.copy(src, d / src.name)
    return str(d)


def leaks(words, items):
    return any(len(i) >= LEAST and plain_distance(i, words) <= int(len(i) * TOL) for i in items)


def test_pipeline_against_plain_python(spark, folder):
    bins = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, toxicity.fit_toxicity(spark, docs, labels)).where("toxic").collect()}
    poor = {r["doc_id"] for r in quality.quality(docs, quality.fit_ordinal(docs, labels, F.expr(quality.GRADE))).where("NOT keep").collect()}
    kept = [k for k in text if k not in toxic and k not in poor]
    gone = {a for a, _ in brute([(k, text[k]) for k in kept], neardup.BITS)}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [k for k in kept if k not in gone]
    kept = {k for k in kept if not leaks(plain_words(text[k]), items)}
    got = Counter()
    for r in bins:
        assert sum(r["lengths"]) == r["used"] <= packing.CAPACITY
        for d, n in zip(r["doc_ids"], r["lengths"]):
            got[d] += n
    assert set(got) == kept
    assert all(n == len(text[d].split()) for d, n in got.items())
    assert toxic and poor and gone


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        f = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    for name, sql in registry.ORACLES.items():
        a, b = registry.QUERIES[name](spark, folder).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None))), name


def test_odd_and_empty_tables(spark, folder, tmp_path):
    """Nulls in every column, repeated rows, one doc_id with two texts, empty and long texts, more columns; then each table without rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = [r["text"] for r in docs.where("n_chars BETWEEN 400 AND 2000 AND lang = 'en'").orderBy("doc_id").limit(12).collect()]
    rows = [(10**6 + k, t, "en", "s", len(t)) for k, t in enumerate(good)]
    rows += [(None, good[0], None, None, None), (None, None, None, None, None), (10**6 + 50, None, "en", "s", 0), (10**6 + 51, "", "en", "s", 0), rows[1], rows[1], (10**6 + 1, good[2] + " another text", "en", "s", 5), (10**6 + 60, " ".join(good) * 40, "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema).withColumn("node", F.lit("x")).withColumn("id", F.lit(1)).withColumn("toxic", F.lit(None).cast("int"))
    every = docs.withColumn("node", F.lit("y")).withColumn("id", F.col("doc_id").cast("int")).withColumn("toxic", F.lit(0)).unionByName(odd.select(*docs.columns, "node", "id", "toxic"))
    names = ("documents", "labels", "benchmark")

    def write(name, **other):
        d = tmp_path / name
        for t in names:
            other.get(t, spark.read.parquet(f"{folder}/{t}.parquet")).write.parquet(str(d / f"{t}.parquet"))
        return str(d)

    bins = corpus_pipeline.run(spark, write("odd", documents=every)).collect()
    kept = Counter(i for r in bins for i in dict.fromkeys(r["doc_ids"]))
    assert None not in kept and 10**6 + 50 not in kept and 10**6 + 51 not in kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.count() > 0, name
        if name != "quality classifier":  # which judges a row without a text like an empty one
            assert out.where("text IS NULL").count() == 2, name
    for t in names:
        empty = spark.read.parquet(f"{folder}/{t}.parquet").where("false")
        n = corpus_pipeline.run(spark, write(f"no-{t}", **{t: empty})).count()
        assert (n == 0) == (t == "documents"), t
