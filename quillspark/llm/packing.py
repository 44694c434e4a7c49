"""Packing by optimal length buckets.

The global histogram of document lengths is small; a dynamic programme over it chooses the bucket
boundaries that minimise padding. Inside each bucket, batches hold as many documents as the token budget
allows when each is padded to the bucket's boundary.

Defined cases: a null or empty text has only its end token; a document longer than the budget is a batch of
its own; ties and repeated rows get places of their own; an empty table gives an empty table; extra columns
are left out; texts are counted whole. Every distinct length is a bin of the driver's histogram. k distinct lengths need k * k / 2 tokens at least, so
T tokens have at most sqrt(2 * T) bins: some 6 million numbers for 100 TB of text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, slots, written

TOKEN_BUDGET, BUCKETS, BLOCKS = 65_536, 16, 1024


def word_length(text: Column) -> Column:
    """Words and one end token."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long") + 1


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Indices of the bins that end a bucket, at most ``buckets``, with least padding in all.

    cost(i, j) = length[j] * documents in bins i..j - their tokens. It satisfies the quadrangle inequality, so the
    best split moves one way and each layer is solved by halving, all midpoints of a depth at once.
    """
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    s = np.concatenate([[0.0], np.cumsum(sums, dtype=np.float64)])
    lengths = np.asarray(lengths, np.float64)
    cost = lambda i, j: lengths[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
    best = cost(np.zeros(n, np.int64), np.arange(n))
    picks: list[np.ndarray] = [np.zeros(n, np.int64)]
    for k in range(1, min(buckets, n)):
        now, pick = best.copy(), np.full(n, -1, np.int64)  # -1: no use for another bucket
        lo, hi, a, b = np.array([k]), np.array([n - 1]), np.array([k]), np.array([n - 1])
        while len(lo):
            mid = (lo + hi) // 2
            end = np.minimum(b, mid)
            size = end - a + 1
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            i = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(a, size)
            j = np.repeat(mid, size)
            values = best[i - 1] + cost(i, j)
            least = np.minimum.reduceat(values, first)
            at = np.flatnonzero(values == np.repeat(least, size))
            at = at[np.searchsorted(at, first)]
            split = i[at]
            better = least < now[mid]
            now[mid[better]], pick[mid[better]] = least[better], split[better]
            lo, hi, a, b = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([a, split]), np.concatenate([split, b])
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        best = now
        picks.append(pick)
    ends, j, k = [], n - 1, len(picks) - 1
    while j >= 0:
        while k and picks[k][j] < 0:
            k -= 1
        ends.append(j)
        if k == 0:
            break
        j, k = int(picks[k][j]) - 1, k - 1
    return ends[::-1]


def pack(docs: DataFrame, n_tokens: Column | None = None, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_len, batch_id, place, padding``, a row for each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), (n_tokens if n_tokens is not None else word_length(F.col("text"))).cast("long").alias("n_tokens"))
    rows = written(rows, "pack-lengths")  # read three times
    n = F.col("n_tokens")
    bins = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")
    lengths, counts = bins["n_tokens"].to_numpy(np.int64), bins["n"].to_numpy(np.int64)
    sums = lengths * counts
    ends = best_boundaries(lengths, counts, sums, buckets)
    bounds, low, first_batch = [], -1, 0
    for b, e in enumerate(ends):
        top, inside = int(lengths[e]), int(counts[(lengths > low) & (lengths <= lengths[e])].sum())
        holds = max(1, token_budget // max(top, 1))
        bounds.append((b, low + 1, top, holds, first_batch))
        first_batch += -(-inside // holds)
        low = top
    bound_df = spark.createDataFrame(bounds, "bucket int, b_low long, bucket_len long, b_holds int, b_first long")
    if not bounds:
        bound_df = bound_df.limit(0)
    which = F.lit(0).cast("int")
    for b, lo, *_ in bounds[1:]:
        which = F.when(n >= lo, F.lit(b)).otherwise(which)
    placed = slots(rows.withColumn("bucket", which), "bucket", [F.col("doc_id"), n], F.col("doc_id"), blocks)
    out = placed.join(F.broadcast(bound_df), "bucket")
    return out.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        (F.col("b_first") + F.floor(F.col("slot") / F.col("b_holds"))).cast("long").alias("batch_id"),
        (F.col("slot") % F.col("b_holds")).cast("int").alias("place"),
        (F.col("bucket_len") - n).alias("padding"),
    )
