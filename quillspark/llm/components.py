"""Connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def splittable(side: DataFrame) -> DataFrame:
    """The aggregated side of a join, shuffled once more: only then may Spark split the other side's partition of a hot key."""
    return side.hint("rebalance")


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each neighbour v of u beside the least of u and its neighbours."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(splittable(least), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, component``: the least node that a node reaches; a component's least node has no row."""
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each u here is larger than its neighbours, so the least neighbour is its least
        small = _with_least(large)
        out = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = written(out, "edges")
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if mark == (r["n"], r["h"]):
            break
        mark = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
