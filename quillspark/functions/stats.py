"""Column expressions and small aggregates for statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Seconds with a fraction; exact to the microsecond, whatever the session's zone."""
    name = lambda c: c if isinstance(c, str) else c._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, {name(earlier)}, {name(later)})") / F.lit(1e6)


def epoch_seconds(c: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def shares(df: DataFrame, count: str, by: list[str]) -> DataFrame:
    """Adds ``_p``: the row's share of ``count`` within ``by``."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return df.withColumn("_p", F.col(count) / F.sum(count).over(w))


def entropy_bits(p: Column) -> Column:
    """Aggregate: Shannon entropy of shares."""
    return F.coalesce(F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))), F.lit(0.0))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where a side is constant (``F.corr`` raises there)."""
    x, y = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((x > 0) & (y > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(x.cast("double")) * F.sqrt(y.cast("double"))))
