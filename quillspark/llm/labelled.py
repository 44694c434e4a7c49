"""The bounded labelled sample from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column | None, most_rows: int) -> DataFrame:
    """``text, y`` of labelled documents, some ``most_rows`` at most, chosen by a hash of doc_id.

    A doc_id with several labels has that of their majority; null labels don't count; one with several texts gives its least one.
    ``may_learn`` is a condition on doc_id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    share = most_rows / max(most_rows, known.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(place < share).withColumnRenamed("doc_id", "_id")
    of = lambda d: d.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("_id", "text", "y")
    again = of(docs.select("doc_id")).groupBy("_id").count().where("count > 1").select("_id")  # most_rows ids at most
    again = docs.sparkSession.createDataFrame([(r["_id"],) for r in again.collect()], "_id long")
    if not again.isEmpty():
        several = rows.join(F.broadcast(again), "_id", "left_semi").groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
        rows = rows.join(F.broadcast(again), "_id", "left_anti").unionByName(several)
    return written(rows.select("text", "y"), "labelled")
