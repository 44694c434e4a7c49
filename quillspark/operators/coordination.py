"""Entity and coordination features of an event frame (``row_index, ts, entity``).

Windows are tumbling and aligned to the epoch. Every operator first reduces events to (window, entity) rows, so a busy window
costs a row per entity at most, and lists of entities are cut to ``SHOWN`` before they are collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .temporal import minute_of

SHOWN = 20


def window_start(seconds: int, ts: str = "ts") -> Column:
    return F.window(ts, f"{seconds} seconds")["start"].cast("timestamp_ntz")


def _names(pairs: DataFrame, keys: list[str], entity: str = "entity") -> DataFrame:
    """The first ``SHOWN`` entities of each group in the order in which they were first seen, and `` …`` if there are more."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("first", entity))
    head = pairs.withColumn("_r", rank).where(F.col("_r") <= SHOWN + 1)
    got = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", entity))).alias("_l"))
    shown = F.array_join(F.transform(F.slice("_l", 1, SHOWN), lambda x: x[entity]), ", ")
    return got.select(*keys, F.concat(shown, F.when(F.size("_l") > SHOWN, F.lit(" …")).otherwise(F.lit(""))).alias("entities"))


def _by_window(events: DataFrame, seconds: int, *more: str) -> DataFrame:
    return events.withColumn("window_start", window_start(seconds)).groupBy(*more, "window_start", "entity").agg(F.count("*").alias("n"), F.min(F.struct("ts", "row_index")).alias("first"), F.max("ts").alias("last"))


def near_simultaneous_windows(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Windows in which at least two entities are active, the most shared first."""
    pairs = _by_window(events, seconds)
    found = pairs.groupBy("window_start").agg(F.sum("n").alias("event_count"), F.count("*").alias("unique_entities")).where("unique_entities >= 2")
    names = _names(pairs.join(found.select("window_start"), "window_start", "left_semi"), ["window_start"])
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("unique_entities"), F.desc("event_count"), "window_start"))
    out = found.join(names, "window_start").withColumn("window_id", rank.cast("long"))
    end = F.col("window_start") + F.expr(f"INTERVAL {seconds - 1} SECONDS")
    return out.select("window_id", "window_start", end.alias("window_end"), "event_count", "unique_entities", "entities")


def co_posts(events: DataFrame, seconds: int = 10) -> DataFrame:
    """(window, entity) rows with ``n`` events and whether the window holds another entity."""
    pairs = _by_window(events, seconds)
    return pairs.select("window_start", "entity", "n", (F.count("*").over(W.partitionBy("window_start")) >= 2).alias("copost"))


def co_post_flags(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Each event, and whether its window holds another entity."""
    e = events.withColumn("window_start", window_start(seconds))
    shared = e.groupBy("window_start").agg((F.min("entity") != F.max("entity")).alias("is_copost"))
    return e.join(shared, "window_start").select("row_index", "is_copost")


def entity_synchrony(events: DataFrame, seconds: int = 10) -> DataFrame:
    out = co_posts(events, seconds).groupBy("entity").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("copost"), F.col("n")).otherwise(0)).alias("copost_events"))
    return out.withColumn("copost_share", F.try_divide("copost_events", "events")).orderBy(F.desc("copost_share"), F.desc("events"), "entity")


def co_post_share(events: DataFrame, seconds: int = 10) -> DataFrame:
    c = co_posts(events, seconds)
    return c.agg(F.try_divide(F.sum(F.when(F.col("copost"), F.col("n")).otherwise(0)), F.sum("n")).alias("copost_share_total"))


def pairwise_co_posts(events: DataFrame, seconds: int = 10, most_entities: int | None = None, compat_first20: bool = False) -> DataFrame:
    """How many windows two entities share. ``most_entities`` leaves out windows of more entities; ``compat_first20`` pairs the first twenty of each window only."""
    sized = _by_window(events, seconds)
    if most_entities:
        few = sized.groupBy("window_start").agg(F.count("*").alias("k")).where(F.col("k") <= most_entities)
        sized = sized.join(few, "window_start", "left_semi")
    if compat_first20:
        sized = sized.withColumn("r", F.row_number().over(W.partitionBy("window_start").orderBy("first", "entity"))).where(f"r <= {SHOWN}")
    left, right = sized.select("window_start", F.col("entity").alias("entity_a")), sized.select("window_start", F.col("entity").alias("entity_b"))
    both = left.join(right, "window_start").where("entity_a < entity_b")
    return both.groupBy("entity_a", "entity_b").agg(F.count("*").alias("copost_windows")).orderBy(F.desc("copost_windows"), "entity_a", "entity_b")


def entity_jitter(events: DataFrame) -> DataFrame:
    """Regularity of each entity's gaps; ``repetition_flag`` if half of five gaps or more round to one value."""
    order = W.partitionBy("entity").orderBy("ts", "row_index")
    e = events.select("entity", "ts", "row_index", F.lag("ts").over(order).alias("before"), F.row_number().over(order).alias("at"))
    gap = F.expr("timestampdiff(MICROSECOND, before, ts)") / F.lit(1e6)
    e = e.withColumn("gap", gap).withColumn("rounded", F.bround(gap).cast("long"))
    counts = e.where("gap IS NOT NULL").groupBy("entity", "rounded").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    modal = counts.groupBy("entity").agg(F.max_by(F.struct("rounded", "n"), F.struct("n", -F.col("first"))).alias("m"))
    near = counts.join(modal, "entity").groupBy("entity").agg(F.first("m").alias("m"), F.sum(F.when(F.abs(F.col("rounded") - F.col("m.rounded")) <= 1, F.col("n")).otherwise(0)).alias("near"))
    stats = e.groupBy("entity").agg(F.count("*").alias("n_events"), F.count("gap").alias("n_intervals"), F.avg("gap").alias("mean_interval_s"), F.stddev_samp("gap").alias("std"))
    out = stats.join(near, "entity", "left").withColumn("std_interval_s", F.when(F.col("n_intervals") == 1, 0.0).otherwise(F.col("std")))
    share = F.try_divide("m.n", "n_intervals")
    return out.select(
        "entity", "n_events", "n_intervals", "mean_interval_s", "std_interval_s",
        F.when((F.col("n_intervals") > 1) & (F.col("mean_interval_s") > 0), F.try_divide("std_interval_s", "mean_interval_s")).alias("cv_interval"),
        F.col("m.rounded").alias("modal_interval_s"), share.alias("modal_interval_share"), F.try_divide("near", "n_intervals").alias("near_modal_share"),
        F.coalesce((F.col("n_intervals") >= 5) & (share >= 0.5), F.lit(False)).alias("repetition_flag"),
    ).orderBy(F.desc("repetition_flag"), F.desc("modal_interval_share"), F.desc("n_events"), "entity")


def amplification(exploded: DataFrame, token: str, seconds: int = 300, min_entities: int = 3) -> DataFrame:
    """Tokens that several entities share within a window. ``exploded``: event rows with a token column."""
    pairs = _by_window(exploded, seconds, token)
    found = pairs.groupBy(token, "window_start").agg(F.count("*").alias("distinct_entities"), F.sum("n").alias("total_shares"), F.min("first.ts").alias("first_ts"), F.max("last").alias("last_ts")).where(F.col("distinct_entities") >= min_entities)
    names = _names(pairs.join(found.select(token, "window_start"), [token, "window_start"], "left_semi"), [token, "window_start"])
    order = (F.desc("distinct_entities"), F.desc("total_shares"), F.asc(token), F.asc("window_start"))
    out = found.join(names, [token, "window_start"])
    # places by level of entities first: only groups of one level are numbered together, and levels are few
    levels = found.groupBy("distinct_entities").agg(F.count("*").alias("_n"))
    above = levels.select(F.col("distinct_entities").alias("_level"), F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("distinct_entities")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    rank = F.row_number().over(W.partitionBy("distinct_entities").orderBy(*order[1:]))
    out = out.join(above, F.col("distinct_entities") == F.col("_level")).withColumn("group_id", (F.col("_above") + rank).cast("long"))
    return out.select("group_id", token, "window_start", "first_ts", "last_ts", "distinct_entities", "total_shares", "entities")


def entity_hour_profile(events: DataFrame) -> DataFrame:
    hours = events.groupBy("entity", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    p = hours.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("entity")))
    out = p.groupBy("entity").agg(
        F.sum("n").alias("n_events"), F.count("*").alias("active_hours_of_24"), F.max_by("hour", F.struct("n", -F.col("hour"))).alias("top_hour"),
        (F.max("n") / F.sum("n")).alias("top_hour_share"), F.sum(-F.col("p") * F.log2("p")).alias("hour_entropy_bits"),
    )
    out = out.withColumn("hour_entropy_normalized", F.col("hour_entropy_bits") / math.log2(24))
    always = (F.col("active_hours_of_24") >= 22) & (F.col("hour_entropy_normalized") >= 0.90) & (F.col("n_events") >= 20)
    out = out.withColumn("always_on_flag", always).withColumn("narrow_hours_flag", (F.col("active_hours_of_24") <= 4) & (F.col("n_events") >= 10))
    return out.orderBy(F.desc("always_on_flag"), F.desc("hour_entropy_normalized"), F.desc("n_events"), "entity")


def burst_correlation(events: DataFrame, top_n: int = 50, corr_min: float = 0.5, min_events: int = 10, bin_: Column | None = None) -> DataFrame:
    """Correlation of the most active entities' counts per minute (or ``bin_``), over bins in which any of them is active.

    Sparse: only bins that two entities share meet in the self-join; zeros come in through the number of bins.
    """
    active = events.groupBy("entity").agg(F.count("*").alias("events")).where(F.col("events") >= min_events).orderBy(F.desc("events"), "entity").limit(top_n)
    mine = events.select("entity", (bin_ if bin_ is not None else minute_of()).alias("bin"))
    n = mine.join(F.broadcast(active.select("entity")), "entity").groupBy("entity", "bin").agg(F.count("*").cast("double").alias("x"))
    bins = n.agg(F.count_distinct("bin").alias("k"))
    one = n.groupBy("entity").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    a, b = n.select("bin", F.col("entity").alias("entity_a"), F.col("x").alias("xa")), n.select("bin", F.col("entity").alias("entity_b"), F.col("x").alias("xb"))
    both = a.join(b, "bin").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("sxy"))
    side = lambda p: active.join(one, "entity").select(F.col("entity").alias(f"entity_{p}"), F.col("events").alias(f"events_{p}"), F.col("s").alias(f"s{p}"), F.col("ss").alias(f"ss{p}"))
    # entities that share no bin correlate below 0: they matter only for corr_min below 0
    base = side("a").join(side("b"), F.col("entity_a") < F.col("entity_b")) if corr_min < 0 else None
    pairs = base.join(both, ["entity_a", "entity_b"], "left") if base is not None else both.join(F.broadcast(side("a")), "entity_a").join(F.broadcast(side("b")), "entity_b")
    r = pearson(F.col("k"), F.col("sa"), F.col("sb"), F.col("ssa"), F.col("ssb"), F.coalesce("sxy", F.lit(0.0)))
    out = pairs.crossJoin(F.broadcast(bins)).where("k >= 3").withColumn("pearson_r", r)
    return out.where(F.col("pearson_r") >= corr_min).select("entity_a", "entity_b", "pearson_r", "events_a", "events_b").orderBy(F.desc("pearson_r"), "entity_a", "entity_b")


def dormancy_bursts(events: DataFrame, dormancy_days: float = 30, burst_hours: int = 24, min_burst_events: int = 5) -> DataFrame:
    """Each entity's first return from silence with a burst of events."""
    order = W.partitionBy("entity").orderBy("ts", "row_index")
    burst = W.partitionBy("entity").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(0, int(burst_hours * 3_600_000_000))
    e = events.select("entity", "ts", "row_index", F.lag("ts").over(order).alias("before"), F.count("*").over(burst).alias("events_in_burst"), F.count("*").over(W.partitionBy("entity")).alias("total_events"))
    days = F.expr("timestampdiff(MICROSECOND, before, ts)") / F.lit(86_400e6)
    e = e.withColumn("dormancy_days", days).where((F.col("dormancy_days") >= dormancy_days) & (F.col("events_in_burst") >= min_burst_events) & (F.col("total_events") > min_burst_events))
    first = e.groupBy("entity").agg(F.min_by(F.struct("dormancy_days", "ts", "events_in_burst", "total_events"), F.struct("ts", "row_index")).alias("e"))
    end = F.col("e.ts") + F.expr(f"INTERVAL {int(burst_hours)} HOURS")
    return first.select("entity", "e.dormancy_days", F.col("e.ts").alias("reactivation_ts"), end.alias("burst_end_ts"), "e.events_in_burst", "e.total_events").orderBy(F.desc("events_in_burst"), F.desc("dormancy_days"), "entity")


def events_in_windows(events: DataFrame, windows: DataFrame, seconds: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of flagged windows."""
    e = events.withColumn("window_start", window_start(seconds))
    return e.join(windows.select("window_id", "window_start", "window_end", "unique_entities"), "window_start").select("window_id", "window_start", "window_end", "unique_entities", "ts", "entity", "row_index", *keep).orderBy("window_id", "ts", "row_index")


def events_in_groups(exploded: DataFrame, groups: DataFrame, token: str, seconds: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of flagged (token, window) groups."""
    e = exploded.withColumn("window_start", window_start(seconds))
    return e.join(groups.select("group_id", token, "window_start", "distinct_entities"), [token, "window_start"]).select("group_id", token, "window_start", "distinct_entities", "ts", "entity", "row_index", *keep).orderBy("group_id", "ts", "row_index")
