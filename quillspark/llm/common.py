"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.files import remove

#: What separates words: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later plan reads; other tables are left alone."""
    path = getattr(df, "_quill_path", None)
    if path:
        remove(path, df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that nothing refers to any more; it waits for the driver's garbage collection.

    Without this the n-gram join keeps all its rounds' shuffle files. Where there is no gateway to the JVM, nothing is done.
    """
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for what runs inside, so that long texts don't fill the executors' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def doc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, most: int):
    """Cut rows into runs (first, end) of at most ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def most_frequent(counts: DataFrame, most: int, least: int = 1, n: str = "n") -> DataFrame:
    """The rows of ``counts`` from a count on that at most ``most`` rows reach.

    The count comes from a histogram (exact up to 4096, by sixteenths of powers of two above), so that no task
    or driver sorts more than the answer.
    """
    c = F.col(n)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(c.cast("double"))) - 4, F.lit(0)))
    low = F.when(c <= 4096, c).otherwise((F.floor(c / step) * step).cast("long"))
    bins = counts.where(c >= least).groupBy(low.alias("low")).agg(F.count("*").alias("k")).orderBy(F.desc("low")).collect()
    first, seen = None, 0
    for r in bins:
        seen += r["k"]
        if seen > most:
            break
        first = r["low"]
    return counts.where(c >= first) if first is not None else counts.limit(0)


def slots(df: DataFrame, group: str, order: list[Column], key: Column, blocks: int, name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without one task per group.

    Rows fall into ``blocks`` blocks by the hash of ``key``; the counts of blocks give each block its
    offset, and only rows within one block are sorted. ``group`` must have a bounded number of values:
    the offsets (groups x blocks rows) are summed by a window over each group's blocks.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    counts = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy(group, "_block").orderBy(*order)).cast("long") - 1
    numbered = df.withColumn("_rank", rank)
    joined = numbered.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(name, F.col("_offset") + F.col("_rank")).drop("_g", "_b", "_block", "_offset", "_rank")
