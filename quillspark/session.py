"""Session helpers: the shared folder, lineage cuts, dense ids and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast side at most; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of strings in a broadcast side at most.
BROADCAST_BYTES = 256 << 20
_ROW = (1 << 33) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one where it is unset in local mode."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + (made := tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _SCRATCH.get()) is not None:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what nobody refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at its end; what is returned must be ``kept``."""
    own: list[str] = []
    token = _SCRATCH.set(own)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            drop_path(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written so that it outlives the scratch tables it was made of."""
    token = _SCRATCH.set(None)
    try:
        return written(df, name)
    finally:
        _SCRATCH.reset(token)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few enough."""
    return F.broadcast(df) if rows <= limit else df


def bounded(rows: int, octets: int) -> int:
    """``rows`` for ``small``, or more than any limit where the counted bytes of their strings are too many."""
    return rows if octets <= BROADCAST_BYTES else 1 << 62


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` over all cores, by a hash of ``by``, where its files give fewer partitions than that (one row group can't be split)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, by)


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with 0-based positions in the total order ``order``, without a single-partition sort.

    Rows are range-partitioned and numbered within partitions; the partitions' sizes give the offsets.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))), "ids")
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_p int, _o long")
    return parts.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_o") + F.col("_r")).alias(name))
