"""Event-time profiling: calendar buckets, intervals and indicators.

All operators take an event frame: ``row_index`` (source row), ``ts`` (timestamp without zone, display wall time) and
optionally ``entity``. :func:`prepare` makes one. Only aggregates over few keys (minutes, seconds of a minute, days)
use windows without a partition; nothing that has a row per event does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import entropy_bits, pearson, shares

#: How text timestamps may be written, tried in this order.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss")
MONTH_FIRST = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
#: Unix epochs by the magnitude of the median: (from, up to, divisor to seconds).
EPOCHS = ((1e8, 1e11, 1), (1e11, 1e14, 10**3), (1e14, 1e17, 10**6), (1e17, 1e20, 10**9))


def epoch_divisor(median: float | None) -> int | None:
    if median is None:
        return None
    for low, high, divisor in EPOCHS:
        if low <= median < high:
            return divisor
    digits = len(str(int(abs(median))))
    return 1 if digits <= 10 else 10**3 if digits <= 13 else 10**6 if digits <= 16 else 10**9


def parse_unix(df: DataFrame, column: str) -> Column:
    """Numbers as epochs; the unit comes from the median's magnitude (one aggregate)."""
    median = df.agg(F.median(F.expr(f"try_cast(`{column}` AS double)"))).first()[0]
    divisor = epoch_divisor(median)
    if divisor is None:
        return F.lit(None).cast("timestamp")
    number = F.expr(f"try_cast(`{column}` AS decimal(30,6))")
    return F.timestamp_micros((number * 1_000_000 / divisor).cast("long"))


def parse_datetimes(df: DataFrame, column: str, day_first: bool = False) -> Column | None:
    """The strategy that parses most rows, or None if none parses enough: at least min(10, a fifth), and one.

    Strategies are counted in one aggregate; ties go to the earlier one.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.col(column).cast("timestamp")
    text = F.trim(F.col(column).cast("string"))
    own = DAY_FIRST if day_first else MONTH_FIRST
    other = MONTH_FIRST if day_first else DAY_FIRST
    each = lambda formats: F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    tried = [each(FORMATS), each(FORMATS + own), each(FORMATS + own + other), parse_unix(df, column)]
    counts = df.agg(F.count("*"), *(F.count(c) for c in tried)).first()
    best = max(range(len(tried)), key=lambda k: (counts[k + 1], -k))
    if counts[best + 1] < max(1, min(10, int(0.2 * counts[0]))):
        return None
    return tried[best]


def to_zone(ts: Column, zone: str | None) -> Column:
    """Wall time in ``zone`` of a UTC instant; an unknown zone leaves UTC."""
    if zone:
        import zoneinfo

        if zone in zoneinfo.available_timezones():
            return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return ts.cast("timestamp_ntz")


def prepare(df: DataFrame, ts: Column, row_index: Column, entity: Column | None = None, zone: str | None = None, null_entity: str | None = "nan", keep: tuple[str, ...] = ()) -> DataFrame:
    """The event frame. Rows without a time go. A null entity is ``null_entity``, or drops the row if that is None."""
    columns = [row_index.cast("long").alias("row_index"), to_zone(ts, zone).alias("ts")]
    if entity is not None:
        columns.append((F.coalesce(entity.cast("string"), F.lit(null_entity)) if null_entity is not None else entity.cast("string")).alias("entity"))
    out = df.select(*columns, *keep).where(F.col("ts").isNotNull())
    return out.where(F.col("entity").isNotNull()) if entity is not None and null_entity is None else out


DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def volume(events: DataFrame, part: str) -> DataFrame:
    """Counts by second, minute, hour, dow (Monday 0), day_of_month or date; only values that occur."""
    key = {"second": F.second("ts"), "minute": F.minute("ts"), "hour": F.hour("ts"), "dow": F.weekday("ts"), "day_of_month": F.dayofmonth("ts"), "date": F.to_date("ts")}[part]
    out = events.groupBy((key if part == "date" else key.cast("long")).alias(part)).agg(F.count("*").alias("count"))
    if part == "dow":
        out = out.select("dow", F.element_at(F.array(*map(F.lit, DAYS)), F.col("dow").cast("int") + 1).alias("dow_name"), "count")
    return out.orderBy(part)


def minute_of(c: str = "ts") -> Column:
    return F.date_trunc("minute", c).cast("timestamp_ntz")


def second_of(c: str = "ts") -> Column:
    return F.date_trunc("second", c).cast("timestamp_ntz")


def intervals(events: DataFrame) -> DataFrame:
    """Gaps between consecutive events, in seconds.

    A lag over all events would need one task. Events are lagged within their minute instead; each minute's first event
    gets the last time of the occupied minute before it, from a table with one row per minute.
    """
    e = events.select("row_index", "ts", minute_of().alias("bin"))
    order = W.partitionBy("bin").orderBy("ts", "row_index")
    inside = e.withColumn("before", F.lag("ts").over(order))
    ends = e.groupBy("bin").agg(F.max("ts").alias("last"))
    ends = ends.select(F.col("bin").alias("_bin"), F.lag("last").over(W.orderBy("bin")).alias("earlier"))
    joined = inside.join(ends, F.col("bin") == F.col("_bin")).withColumn("previous", F.coalesce("before", "earlier"))
    return joined.where("previous IS NOT NULL").select((F.expr("timestampdiff(MICROSECOND, previous, ts)") / F.lit(1e6)).alias("interval_seconds"))


def interval_stats(gaps: DataFrame) -> DataFrame:
    """One row; a single gap has a spread of 0, none has nulls."""
    x = F.col("interval_seconds")
    quantile = lambda q: F.percentile(x, q)
    out = gaps.agg(F.count(x).alias("n_intervals"), F.min(x).alias("min"), quantile(0.05).alias("p05"), quantile(0.5).alias("median"), F.avg(x).alias("mean"), quantile(0.95).alias("p95"), F.max(x).alias("max"), F.stddev_samp(x).alias("_std"))
    out = out.withColumn("std", F.when(F.col("n_intervals") == 1, 0.0).otherwise(F.col("_std"))).drop("_std")
    return out.withColumn("cv", F.when((F.col("n_intervals") > 1) & (F.col("mean") != 0), F.try_divide("std", "mean")))


def interval_counts(gaps: DataFrame) -> DataFrame:
    """Gaps rounded to seconds, half to even, and how often."""
    return gaps.groupBy(F.bround("interval_seconds").cast("long").alias("interval_seconds_rounded")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "interval_seconds_rounded")


def pct_indicators(events: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s, m = F.second("ts"), F.minute("ts")
    return events.agg(
        share(s == 0).alias("pct_second_0"), share(s == 30).alias("pct_second_30"), share(s % 5 == 0).alias("pct_second_mult5"),
        share(m == 0).alias("pct_minute_0"), share(m == 30).alias("pct_minute_30"), share(m % 5 == 0).alias("pct_minute_mult5"),
        share(m.isin(0, 15, 30, 45)).alias("pct_minute_quarter"),
    )


def duplicate_share(events: DataFrame) -> DataFrame:
    """The share of events whose second holds another one."""
    n = events.groupBy(second_of().alias("second")).agg(F.count("*").alias("n"))
    return n.agg(F.try_divide(F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)), F.sum("n")).alias("duplicate_timestamp_share"))


def per_minute(events: DataFrame) -> DataFrame:
    return events.groupBy(minute_of().alias("minute")).agg(F.count("*").alias("n"))


def burst_ratio(events: DataFrame) -> DataFrame:
    """The busiest minute against the median occupied one."""
    return per_minute(events).agg(F.max("n").alias("max_per_minute"), F.percentile("n", 0.5).alias("median_per_minute")).withColumn("burst_ratio", F.when(F.col("median_per_minute") > 0, F.col("max_per_minute") / F.col("median_per_minute")))


def minute_entropy(events: DataFrame) -> DataFrame:
    p = shares(volume(events, "minute"), "count", [])
    return p.agg(entropy_bits(F.col("_p")).alias("minute_entropy_bits")).withColumn("minute_entropy_normalized", F.col("minute_entropy_bits") / math.log2(60))


def minute_gini(events: DataFrame) -> DataFrame:
    """Inequality of the observed minutes of the hour."""
    ranked = volume(events, "minute").withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("count", "minute")))
    n, total = F.count("*"), F.sum("count")
    return ranked.agg(F.coalesce(F.try_divide(2.0 * F.sum(F.col("i") * F.col("count")), n * total) - F.try_divide(n + 1.0, n), F.lit(0.0)).alias("minute_gini"))


def top_minute(events: DataFrame) -> DataFrame:
    v = volume(events, "minute")
    return v.agg(F.max_by("minute", F.struct("count", -F.col("minute"))).alias("top_minute"), F.try_divide(F.max("count"), F.sum("count")).alias("top_minute_share"))


def autocorrelation(events: DataFrame, max_lag: int = 120, top: int | None = 10, fill_gaps: bool = False) -> DataFrame:
    """Correlation of per-minute counts with themselves some minutes later.

    As in the tool this stands in for, a lag counts occupied minutes unless ``fill_gaps``. Lags without a value are left out.
    """
    m = per_minute(events)
    if fill_gaps:
        span = m.agg(F.min("minute").alias("lo"), F.max("minute").alias("hi")).where("lo IS NOT NULL")
        every = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
        m = every.join(m, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("n"))
    m = m.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("minute")).alias("i"), F.col("n").cast("double").alias("n"))
    early = m.select(F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), F.col("n").alias("x"), F.col("i").alias("from"))
    early = early.select((F.col("from") + F.col("lag")).alias("i"), "x", F.col("lag").cast("long").alias("lag_minutes"))
    pairs = early.join(m, "i")
    x, y = F.col("x"), F.col("n")
    sums = pairs.groupBy("lag_minutes").agg(F.count("*").alias("k"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    r = pearson(*(F.col(c) for c in ("k", "sx", "sy", "sxx", "syy", "sxy")))
    out = sums.where("k >= 2").select("lag_minutes", r.alias("autocorr")).where("autocorr IS NOT NULL").orderBy(F.desc("autocorr"), "lag_minutes")
    return out.limit(top) if top else out


def autocorrelation_at(events: DataFrame, lags: tuple[int, ...] = (5, 10, 15, 30, 60)) -> DataFrame:
    """One row: the values at some lags; null unless a lag is among the ten highest."""
    top = autocorrelation(events)
    return top.agg(*(F.max(F.when(F.col("lag_minutes") == lag, F.col("autocorr"))).alias(f"autocorr_{lag}m") for lag in lags))


def top_duplicate_timestamps(events: DataFrame, n: int = 50) -> DataFrame:
    c = events.groupBy(second_of().alias("timestamp_floor_s")).agg(F.count("*").alias("count"))
    return c.where("count >= 2").orderBy(F.desc("count"), "timestamp_floor_s").limit(n)
