"""Clustering of dense vectors: near-duplicate leaders, k-means, and both within partitions of the data.

Input: ``row_index``, ``embedding`` (L2-normalised here), optionally ``differentiator`` and ``partition``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import remove, shared_folder

MAX_DOCS, TILE = 500_000, 4096


def clamp_threshold(x: float | None) -> float:
    return 0.8 if x is None else min(1.0, max(0.3, x))


def clamp_min_size(n: int | None) -> int:
    return 2 if n is None else min(MAX_DOCS, max(1, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(c: Column) -> Column:
    norm = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def hashed_vectors(df: DataFrame, row_index: str, text: str, dims: int = 256, n: int = 3) -> DataFrame:
    """Texts as normalised counts of hashed character n-grams, for when no embedding model is at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_hashed(t.as_py() or "", dims, n) for t in batch.column("text")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dims), pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column("row_index"), lists], names=["row_index", "embedding"])

    return df.select(F.col(row_index).cast("long").alias("row_index"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row_index long, embedding array<double>")


def _hashed(text: str, dims: int, n: int) -> np.ndarray:
    """Counts of hashed n-grams over cells, of length 1. A text shorter than an n-gram is one n-gram."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = max(1, len(c) - n + 1)
    h = np.full(m, len(c[:n]), np.uint64)
    for k in range(min(n, len(c))):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = np.bincount(((h ^ (h >> np.uint64(32))) % np.uint64(dims)).astype(np.int64), minlength=dims).astype(np.float64)
    return x / np.sqrt((x**2).sum())


def _checkpoint(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table in the shared folder, and where it lies."""
    spark = df.sparkSession
    path = shared_folder(spark, "cluster")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def similar_pairs(vectors: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``a, b, similarity`` (a < b, same partition) with a cosine of at least ``threshold``.

    Rows are dealt into blocks of some ``tile`` rows; each pair of blocks is one matrix product in one task.
    """
    n = vectors.count()
    blocks = max(1, -(-n // tile))
    v = vectors.withColumn("block", F.pmod(F.xxhash64("row_index"), F.lit(blocks)).cast("int"))
    copies = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "similarity": []})]
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left = pdf[pdf["block"] == lo]
        right = pdf[pdf["block"] == hi]
        if len(left) and len(right):
            x, y = np.stack(left["embedding"].to_numpy()), np.stack(right["embedding"].to_numpy())
            i_all, j_all = left["row_index"].to_numpy(), right["row_index"].to_numpy()
            for at in range(0, len(x), 1024):
                s = x[at : at + 1024] @ y.T
                i, j = np.nonzero(s >= threshold)
                a, b = i_all[at + i], j_all[j]
                ok = (a < b) if lo == hi else (a != b)
                out.append(pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": s[i, j][ok]}))
        return pd.concat(out).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    keys = ["partition", "lo", "hi"] if "partition" in vectors.columns else ["lo", "hi"]
    return copies.groupBy(*keys).applyInPandas(run, "a long, b long, similarity double")


def near_duplicates(vectors: DataFrame, threshold: float = 0.8, most_rounds: int = 100_000) -> DataFrame:
    """``row_index, leader, similarity``: as if rows were taken in order, each free row leading all later free rows near it.

    The same outcome in parallel: a row leads once all its earlier neighbours follow others, and follows once one of
    them leads; followers go with their earliest leader. Each round is written out.
    """
    v = vectors.withColumn("embedding", normalised(F.col("embedding")))
    pairs, _ = _checkpoint(similar_pairs(v, threshold))
    state, path = _checkpoint(v.select("row_index", F.lit(0).alias("state")))  # 0 open, 1 leader, 2 follower
    for _ in range(most_rounds):
        early = pairs.join(state.select(F.col("row_index").alias("a"), F.col("state").alias("sa")), "a").groupBy("b").agg(F.max((F.col("sa") == 1).cast("int")).alias("led"), F.min((F.col("sa") == 2).cast("int")).alias("free"))
        now = state.join(early, state["row_index"] == early["b"], "left")
        new = F.when(F.col("state") != 0, F.col("state")).when(F.col("b").isNull() | (F.col("free") == 1), F.lit(1)).when(F.col("led") == 1, F.lit(2)).otherwise(F.lit(0))
        state, path, before = *_checkpoint(now.select("row_index", new.alias("state"))), path
        remove(before, v.sparkSession)
        if state.where("state = 0").isEmpty():
            break
    else:
        raise RuntimeError(f"rows are still open after {most_rounds} rounds")
    leaders = state.where("state = 1").select(F.col("row_index").alias("a"))
    led = pairs.join(leaders, "a").groupBy("b").agg(F.min_by(F.struct("a", "similarity"), "a").alias("l"))
    out = state.join(led, state["row_index"] == led["b"], "left")
    follows = F.col("state") == 2
    return out.select("row_index", F.when(follows, F.col("l.a")).otherwise(F.col("row_index")).alias("leader"), F.when(follows, F.col("l.similarity")).otherwise(F.lit(1.0)).alias("similarity"))


def clusters(assigned: DataFrame, rows: DataFrame, min_size: int = 2, min_distinct: int = 1, differentiator: str | None = None, partition: str | None = None) -> DataFrame:
    """``row_index, leader, similarity, cluster_id, cluster_size[, cluster_distinct_differentiators]``.

    Ids go by size, largest first (then by leader), over all partitions; small clusters have no id.
    """
    a = assigned
    if differentiator:
        a = a.join(rows.select("row_index", F.nullif(F.trim(F.col(differentiator).cast("string")), F.lit("")).alias("_d")), "row_index", "left")
    size = a.groupBy("leader").agg(F.count("*").alias("cluster_size"), *([F.count_distinct("_d").alias("cluster_distinct_differentiators")] if differentiator else []))
    ok = F.col("cluster_size") >= min_size
    if differentiator:
        ok = ok & (F.col("cluster_distinct_differentiators") >= min_distinct)
    ids = size.where(ok).select("leader", F.row_number().over(W.orderBy(F.desc("cluster_size"), "leader")).cast("long").alias("cluster_id"))
    return a.drop("_d").join(size, "leader").join(ids, "leader", "left")


def payload(df: DataFrame, found: DataFrame, row_index: str = "row_index") -> DataFrame:
    """The original rows with what was found; a row without a cluster keeps blanks."""
    return df.join(found.withColumnRenamed("row_index", "_i"), F.col(row_index) == F.col("_i"), "left").drop("_i", "leader")


def semantic(vectors: DataFrame, k: int | None = None, seed: int = 42, starts: int = 3) -> DataFrame:
    """``row_index, cluster_id, cluster_size, similarity``: k-means by cosine (k: the root of the rows); the best of some starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("row_index", normalised(F.col("embedding")).alias("embedding"))
    n = v.count()
    k = min(max(2, k or int(n**0.5)), max(2, n))
    if n < 2:
        return v.select("row_index", F.lit(None).cast("long").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"), F.lit(1.0).alias("similarity"))
    x = v.withColumn("features", array_to_vector("embedding"))
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(x) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = [(i, (c / max(np.linalg.norm(c), 1e-12)).tolist()) for i, c in enumerate(model.clusterCenters())]
    centre_df = v.sparkSession.createDataFrame(centres, "prediction int, centre array<double>")
    got = model.transform(x).join(F.broadcast(centre_df), "prediction").select("row_index", F.col("prediction").cast("long").alias("leader"), dot(F.col("embedding"), F.col("centre")).alias("similarity"))
    size = got.groupBy("leader").agg(F.count("*").alias("cluster_size"))
    ids = size.select("leader", "cluster_size", F.row_number().over(W.orderBy(F.desc("cluster_size"), "leader")).cast("long").alias("cluster_id"))
    return got.join(F.broadcast(ids), "leader").select("row_index", "cluster_id", "cluster_size", "similarity")


def partitioned(vectors: DataFrame, partition: str, threshold: float = 0.8) -> DataFrame:
    """Near duplicates within each value of a column (blank: '(empty)'); values with a single row have no cluster."""
    p = F.coalesce(F.nullif(F.trim(F.col(partition).cast("string")), F.lit("")), F.lit("(empty)"))
    v = vectors.select("row_index", "embedding", p.alias("partition")).withColumn("_n", F.count("*").over(W.partitionBy("partition"))).where("_n >= 2").drop("_n")
    return near_duplicates(v, threshold).join(v.select("row_index", "partition"), "row_index")
