"""Whole analyses as bundles of lazy tables; only a table that is asked for runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import coordination as co
from ..operators import lexicon as lx
from ..operators import temporal as ta


@dataclass
class TemporalOptions:
    co_window_seconds: int = 10
    amp_window_seconds: int = 300
    min_amp_entities: int = 3
    dormancy_days: float = 30
    burst_hours: int = 24
    min_burst_events: int = 5
    corr_top_n: int = 50
    corr_min: float = 0.5
    corr_min_events: int = 10


def indicators(events: DataFrame, options: TemporalOptions | None = None, entity: bool = True) -> DataFrame:
    """One row with all scalar indicators: one-row aggregates side by side."""
    o = options or TemporalOptions()
    parts = [
        events.agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), ta.interval_stats(ta.intervals(events)).select("n_intervals", *(F.col(c).alias(f"interval_{c}") for c in ("min", "p05", "median", "mean", "p95", "max", "std", "cv"))),
        ta.pct_indicators(events), ta.duplicate_share(events), ta.burst_ratio(events), ta.minute_entropy(events), ta.minute_gini(events), ta.top_minute(events), ta.autocorrelation_at(events),
    ]
    if entity:
        parts += [events.agg(F.count_distinct("entity").alias("n_entities")), co.co_post_share(events, o.co_window_seconds), co.near_simultaneous_windows(events, o.co_window_seconds).agg(F.count("*").alias("near_simultaneous_windows"), F.max("unique_entities").alias("max_entities_in_window"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # every part is one row
    return out


def temporal(df: DataFrame, ts: str, row_index: str, entity: str | None = None, zone: str | None = None, url: str | None = None, hashtag: str | None = None, text: str | None = None, options: TemporalOptions | None = None) -> dict[str, DataFrame]:
    """All tables of the temporal analysis by name, over one prepared event frame."""
    o = options or TemporalOptions()
    parsed = ta.parse_datetimes(df, ts)
    if parsed is None:
        raise ValueError(f"{ts} holds no times")
    keep = tuple(dict.fromkeys(c for c in (url, hashtag, text) if c))
    e = ta.prepare(df, parsed, F.col(row_index), F.col(entity) if entity else None, zone, keep=keep).cache()
    gaps = ta.intervals(e)
    out = {f"by_{p}": ta.volume(e, p) for p in ("second", "minute", "hour", "dow", "day_of_month", "date")}
    out |= {"intervals": gaps, "interval_stats": ta.interval_stats(gaps), "interval_counts": ta.interval_counts(gaps), "autocorrelation": ta.autocorrelation(e), "top_duplicate_timestamps": ta.top_duplicate_timestamps(e), "indicators": indicators(e, o, entity is not None)}
    if not entity:
        return out
    windows = co.near_simultaneous_windows(e, o.co_window_seconds)
    out |= {
        "near_simultaneous_windows": windows, "near_simultaneous_events": co.events_in_windows(e, windows, o.co_window_seconds, keep), "pairwise_coposts": co.pairwise_co_posts(e, o.co_window_seconds), "entity_synchrony": co.entity_synchrony(e, o.co_window_seconds),
        "entity_jitter": co.entity_jitter(e), "entity_hour_profile": co.entity_hour_profile(e), "burst_correlation": co.burst_correlation(e, o.corr_top_n, o.corr_min, o.corr_min_events), "dormancy_bursts": co.dormancy_bursts(e, o.dormancy_days, o.burst_hours, o.min_burst_events),
    }
    tokens = {"url": tx.tokenize_urls(F.col(url)) if url else tx.tokenize_urls(F.col(text)) if text else None, "hashtag": tx.tokenize_hashtags(F.col(hashtag), strict=False) if hashtag else tx.tokenize_hashtags(F.col(text)) if text else None}
    for name, items in tokens.items():
        if items is not None:
            x = e.select("row_index", "ts", "entity", F.explode(items).alias(f"_{name}")).withColumnRenamed(f"_{name}", name)
            groups = co.amplification(x, name, o.amp_window_seconds, o.min_amp_entities)
            label = "url_amplification" if name == "url" else "hashtag_storms"
            out |= {label: groups, f"{label}_events": co.events_in_groups(x, groups, name, o.amp_window_seconds)}
    return out


def lexicon(df: DataFrame, text: str, group: str | None = None, query: str | None = None, regex: bool = False, logic: str = "any", html: str | None = None) -> dict[str, DataFrame]:
    """Filter first, then one projection of all derived columns, then grouped counts."""
    rows = df.where(tx.text_filter(F.col(text), query, regex, logic)) if query else df
    e = lx.enrich(lx.with_group(rows, group), text, html).cache()
    freq = lx.frequency(e)
    kinds = ("mentions", "hashtags", "links", "domains") + (("html_links",) if html else ())
    return {"enriched": lx.export(e), "frequency": freq, "top_terms": lx.top_terms(freq), "group_totals": lx.group_totals(e), "meta_counts": lx.meta_counts(e, kinds)}
