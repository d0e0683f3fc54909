"""Prompts and corpus slices, as a benchmark of the engine needs them."""

from __future__ import annotations

import re
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, partial_token
from ..session import dense_ids, small, written

WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
#: Documents whose running totals one task makes.
BLOCK = 1 << 16


def words_of(c):
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def document_prompts(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(prompt_id, text): for every document its first one to three words and most of the next, as if being typed.

    Documents of fewer than two words give no prompt.
    """
    w = F.slice(words_of(F.col("text")), 1, 4)
    rows = docs.where("text IS NOT NULL").select(F.col(doc_id).cast("long").alias("prompt_id"), w.alias("w")).where(F.size("w") >= 2)
    n = F.least(F.lit(1) + F.pmod(F.col("prompt_id"), F.lit(3)), F.size("w") - 1).cast("int")
    return rows.select("prompt_id", F.concat_ws(" ", F.slice("w", F.lit(1), n), F.array(partial_token(F.element_at("w", n + 1)))).alias("text"))


def continuation_prompts(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(prompt_id, text): for every document its first one to three words and a space."""
    w = F.slice(words_of(F.col("text")), 1, 3)
    rows = docs.where("text IS NOT NULL").select(F.col(doc_id).cast("long").alias("prompt_id"), w.alias("w")).where(F.size("w") >= 1)
    n = F.least(F.lit(1) + F.pmod(F.col("prompt_id"), F.lit(3)), F.size("w")).cast("int")
    return rows.select("prompt_id", F.concat(F.array_join(F.slice("w", F.lit(1), n), " "), F.lit(" ")).alias("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_ord"), F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


def stride_prompts(docs: DataFrame, limit: int = 128) -> DataFrame:
    """(ord, query): ``limit`` distinct prompts from lines at an even stride; the sample is the operator.

    Lines of four words at least count; each gives a prompt of one, two and three finished words.
    """
    some = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_ord"), "text")

    def count(batches):
        words = re.compile(WORD).finditer
        for b in batches:
            n = [sum(1 for line in t.splitlines() if next(islice(words(line.lower()), 3, None), None)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_ord"), pa.array(n, pa.int64())], names=["doc_ord", "k"])

    # Only documents are put in order; the few lines that are wanted are cut again.
    per = some.mapInArrow(count, "doc_ord long, k long").groupBy("doc_ord").agg(F.sum("k").alias("k")).where("k > 0")
    per = written(dense_ids(per, [F.col("doc_ord").asc()], "i").withColumn("block", (F.col("i") / BLOCK).cast("long")), "line-counts")
    blocks = sorted(map(tuple, per.groupBy("block").agg(F.sum("k")).collect()))
    sums = [0, *accumulate(n for _, n in blocks)]
    stride = max(1, sums[-1] // max(1, limit * 3))
    before = per.sparkSession.createDataFrame([(b, n) for (b, _), n in zip(blocks, sums)], "block long, before long")
    own = F.sum("k").over(Window.partitionBy("block").orderBy("i")) - F.col("k")
    base = per.withColumn("own", own).join(F.broadcast(before), "block").select(F.col("doc_ord").alias("_doc"), (F.col("before") + F.col("own")).alias("base"), "k")
    wanted = base.where(F.floor((F.col("base") + F.col("k") - 1) / stride) * stride >= F.col("base")).select("_doc", "base")
    cut = some.join(F.broadcast(wanted), F.col("doc_ord").eqNullSafe(F.col("_doc"))).select("doc_ord", "base", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    long = cut.withColumn("w", words_of(F.col("line"))).where(F.size("w") >= 4).select("doc_ord", "base", "line_no", F.slice("w", 1, 4).alias("w"))
    rows = long.withColumn("n", F.col("base") + F.row_number().over(Window.partitionBy("doc_ord").orderBy("line_no")) - 1)
    made = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice("w", F.lit(1), k), F.array(partial_token(F.element_at("w", k + 1)))).alias("query")))
    flat = rows.where(F.col("n") % stride == 0).select("n", F.explode(made).alias("x"))
    first = flat.groupBy("x.query").agg(F.min(F.col("n") * 4 + F.col("x.k")).alias("ord"))
    return first.orderBy("ord").limit(limit)


def corpus_slice(docs: DataFrame, target_words: int) -> DataFrame:
    """(doc_ord, line_no, line, words): lines in order until ``target_words`` words are reached, without leading empty ones.

    Running totals come from blocks of documents, so no task sees all lines.
    """
    rows = _numbered(docs).withColumn("words", F.regexp_count("line", F.lit(WORD)).cast("long"))
    per = rows.groupBy("doc_ord").agg(F.sum("words").alias("t")).withColumn("block", (F.col("doc_ord") / 4096).cast("long"))
    blocks = per.groupBy("block").agg(F.sum("t").alias("bt"))
    before = blocks.select("block", F.coalesce(F.sum("bt").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"))
    before = small(before, blocks.count())
    docs0 = per.withColumn("d0", F.coalesce(F.sum("t").over(Window.partitionBy("block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(before, "block").select("doc_ord", (F.col("b0") + F.col("d0")).alias("base")).where(F.col("base") < target_words)
    within = F.coalesce(F.sum("words").over(Window.partitionBy("doc_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(docs0, "doc_ord").withColumn("before", F.col("base") + within)
    return out.where((F.col("before") < target_words) & ((F.col("before") > 0) | (F.col("words") > 0))).select("doc_ord", "line_no", "line", "words")


def summary(rows: DataFrame, measure: str, by: str) -> DataFrame:
    """(``by``, mean, median, least, p95) of a measure; percentiles are exact and interpolate linearly."""
    m = F.col(measure)
    return rows.groupBy(by).agg(F.round(F.avg(m), 6).alias("mean"), F.round(F.percentile(m, F.lit(0.5)), 4).alias("median"), F.min(m).alias("least"), F.round(F.percentile(m, F.lit(0.95)), 4).alias("p95"))
