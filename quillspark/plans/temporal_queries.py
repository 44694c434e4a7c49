"""Queries of the temporal operators over ``events`` (entity: user_id; token: event_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coordination as co
from ..operators import temporal as ta
from .registry import SQL, query, table


def events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return ta.prepare(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_id"), F.col("user_id"), keep=keep)


E_ = "(SELECT event_id AS row_index, ts, coalesce(CAST(user_id AS VARCHAR), 'nan') AS entity, event_type FROM events WHERE ts IS NOT NULL)"


@query(f"SELECT row_index, ts, entity FROM {E_}")
def ta_prep(spark, d):
    return events(spark, d)


@query("""SELECT event_id, ts AS parsed FROM events""")
def ta_parse_dt(spark, d):
    text = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    return text.select("event_id", ta.to_zone(ta.parse_datetimes(text, "t"), None).alias("parsed"))


@query("""SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS parsed FROM events""")
def ta_parse_unix(spark, d):
    ms = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return ms.select("event_id", ta.to_zone(ta.parse_unix(ms, "t"), None).alias("parsed"))


@query("""SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS local_ts FROM events""")
def ta_tz(spark, d):
    return table(spark, d, "events").select("event_id", ta.to_zone(F.col("ts"), "Asia/Kolkata").alias("local_ts"))


@query("SELECT CAST(second(ts) AS BIGINT) AS second, count(*) AS count FROM events GROUP BY 1")
def ta_by_second(spark, d):
    return ta.volume(events(spark, d), "second")


@query("SELECT CAST(minute(ts) AS BIGINT) AS minute, count(*) AS count FROM events GROUP BY 1")
def ta_by_minute(spark, d):
    return ta.volume(events(spark, d), "minute")


@query("SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS count FROM events GROUP BY 1")
def ta_by_hour(spark, d):
    return ta.volume(events(spark, d), "hour")


@query("SELECT CAST(isodow(ts) - 1 AS BIGINT) AS dow, dayname(ts) AS dow_name, count(*) AS count FROM events GROUP BY 1, 2")
def ta_by_dow(spark, d):
    return ta.volume(events(spark, d), "dow")


@query("SELECT CAST(day(ts) AS BIGINT) AS day_of_month, count(*) AS count FROM events GROUP BY 1")
def ta_by_dom(spark, d):
    return ta.volume(events(spark, d), "day_of_month")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS count FROM events GROUP BY 1")
def ta_by_date(spark, d):
    return ta.volume(events(spark, d), "date").withColumn("date", F.col("date").cast("string"))


GAPS = "(SELECT * FROM (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) / 1e6 AS g, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1e6 AS interval_seconds FROM events) WHERE interval_seconds IS NOT NULL)"


@query(f"SELECT interval_seconds FROM {GAPS}")
def ta_intervals(spark, d):
    return ta.intervals(events(spark, d))


@query(f"""SELECT count(*) AS n_intervals, min(x) AS min, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS median, avg(x) AS mean,
    quantile_cont(x, 0.95) AS p95, max(x) AS max, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(x) END AS std, stddev_samp(x) / avg(x) AS cv
    FROM (SELECT interval_seconds AS x FROM {GAPS})""")
def ta_interval_stats(spark, d):
    return ta.interval_stats(ta.intervals(events(spark, d)))


@query(f"SELECT CAST(round_even(interval_seconds, 0) AS BIGINT) AS interval_seconds_rounded, count(*) AS count FROM {GAPS} GROUP BY 1")
def ta_interval_counts(spark, d):
    return ta.interval_counts(ta.intervals(events(spark, d)))


def _pct(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query(f"""SELECT {_pct('second(ts) = 0')} AS pct_second_0, {_pct('second(ts) = 30')} AS pct_second_30, {_pct('second(ts) % 5 = 0')} AS pct_second_mult5,
    {_pct('minute(ts) = 0')} AS pct_minute_0, {_pct('minute(ts) = 30')} AS pct_minute_30, {_pct('minute(ts) % 5 = 0')} AS pct_minute_mult5,
    {_pct('minute(ts) IN (0, 15, 30, 45)')} AS pct_minute_quarter FROM events""")
def ta_pct_indicators(spark, d):
    return ta.pct_indicators(events(spark, d))


@query("SELECT coalesce(sum(n) FILTER (n >= 2), 0) / sum(n) AS duplicate_timestamp_share FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('second', ts))")
def ta_duplicate_share(spark, d):
    return ta.duplicate_share(events(spark, d))


MINUTES = "(SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1)"


@query(f"SELECT max(n) AS max_per_minute, quantile_cont(n::DOUBLE, 0.5) AS median_per_minute, max(n) / quantile_cont(n::DOUBLE, 0.5) AS burst_ratio FROM {MINUTES}")
def ta_burst_ratio(spark, d):
    return ta.burst_ratio(events(spark, d))


OF_HOUR = "(SELECT minute(ts) AS m, count(*) AS n FROM events GROUP BY 1)"


@query(f"SELECT -sum(p * log2(p)) AS minute_entropy_bits, -sum(p * log2(p)) / log2(60) AS minute_entropy_normalized FROM (SELECT n / sum(n) OVER () AS p FROM {OF_HOUR})")
def ta_minute_entropy(spark, d):
    return ta.minute_entropy(events(spark, d))


@query(f"SELECT 2.0::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0::DOUBLE) / count(*) AS minute_gini FROM (SELECT n, row_number() OVER (ORDER BY n, m) AS i FROM {OF_HOUR})")
def ta_minute_gini(spark, d):
    return ta.minute_gini(events(spark, d))


@query(f"SELECT (SELECT CAST(m AS BIGINT) FROM {OF_HOUR} ORDER BY n DESC, m LIMIT 1) AS top_minute, max(n) / sum(n) AS top_minute_share FROM {OF_HOUR}")
def ta_top_minute(spark, d):
    return ta.top_minute(events(spark, d))


AUTOCORR = f"""(WITH m AS (SELECT row_number() OVER (ORDER BY minute) AS i, n::DOUBLE AS n FROM {MINUTES}),
    s AS (SELECT l AS lag_minutes, count(*) AS k, sum(a.n) AS sx, sum(b.n) AS sy, sum(a.n * a.n) AS sxx, sum(b.n * b.n) AS syy, sum(a.n * b.n) AS sxy
        FROM m a, range(1, 121) r(l), m b WHERE b.i = a.i + l GROUP BY l HAVING count(*) >= 2)
    SELECT lag_minutes, (k * sxy - sx * sy) / (sqrt(k * sxx - sx * sx) * sqrt(k * syy - sy * sy)) AS autocorr FROM s WHERE k * sxx > sx * sx AND k * syy > sy * sy
    ORDER BY autocorr DESC, lag_minutes LIMIT 10)"""


@query(AUTOCORR[1:-1])
def ta_autocorr(spark, d):
    return ta.autocorrelation(events(spark, d))


@query("SELECT " + ", ".join(f"max(autocorr) FILTER (lag_minutes = {k}) AS autocorr_{k}m" for k in (5, 10, 15, 30, 60)) + f" FROM {AUTOCORR}")
def ta_autocorr_at(spark, d):
    return ta.autocorrelation_at(events(spark, d))


@query("SELECT date_trunc('second', ts) AS timestamp_floor_s, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 50")
def ta_top_duplicate_ts(spark, d):
    return ta.top_duplicate_timestamps(events(spark, d))


def _windows(seconds: int) -> str:
    return f"""(WITH e AS (SELECT *, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01') AS w FROM {E_}),
        p AS (SELECT w, entity, count(*) AS n, min(ts) AS f, arg_min(row_index, (ts, row_index)) AS fr FROM e GROUP BY w, entity),
        r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY f, fr, entity) AS i FROM p),
        g AS (SELECT w, CAST(sum(n) AS BIGINT) AS event_count, count(*) AS unique_entities,
            string_agg(entity, ', ' ORDER BY i) FILTER (i <= 20) || CASE WHEN count(*) > 20 THEN ' …' ELSE '' END AS entities FROM r GROUP BY w HAVING count(*) >= 2)
        SELECT row_number() OVER (ORDER BY unique_entities DESC, event_count DESC, w) AS window_id, w AS window_start,
            w + INTERVAL {seconds - 1} SECOND AS window_end, event_count, unique_entities, entities FROM g)"""


@query(_windows(10)[1:-1])
def ta_near_sim_windows(spark, d):
    return co.near_simultaneous_windows(events(spark, d), 10)


FLAGS = f"(SELECT row_index, entity, min(entity) OVER w <> max(entity) OVER w AS is_copost FROM {E_} WINDOW w AS (PARTITION BY time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '1970-01-01')))"


@query(f"SELECT row_index, is_copost FROM {FLAGS}")
def ta_copost_flag(spark, d):
    return co.co_post_flags(events(spark, d))


@query(f"SELECT entity, count(*) AS events, count(*) FILTER (is_copost) AS copost_events, count(*) FILTER (is_copost) / count(*) AS copost_share FROM {FLAGS} GROUP BY entity")
def ta_entity_synchrony(spark, d):
    return co.entity_synchrony(events(spark, d))


@query(f"SELECT count(*) FILTER (is_copost) / count(*) AS copost_share_total FROM {FLAGS}")
def ta_copost_share_total(spark, d):
    return co.co_post_share(events(spark, d))


@query(f"""WITH p AS (SELECT DISTINCT time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '1970-01-01') AS w, entity FROM {E_})
    SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS copost_windows FROM p a JOIN p b ON a.w = b.w AND a.entity < b.entity GROUP BY 1, 2""")
def ta_pairwise_coposts(spark, d):
    return co.pairwise_co_posts(events(spark, d))


@query(f"""WITH e AS (SELECT *, time_bucket(INTERVAL 600 SECOND, ts, TIMESTAMP '1970-01-01') AS w FROM {E_}), p AS (SELECT w, entity, min(ts) AS f, arg_min(row_index, (ts, row_index)) AS fr FROM e GROUP BY w, entity),
    r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY f, fr, entity) AS i, count(*) OVER (PARTITION BY w) AS k FROM p)
    SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS copost_windows FROM r a JOIN r b ON a.w = b.w AND a.entity < b.entity WHERE a.i <= 20 AND b.i <= 20 AND a.k <= 200 GROUP BY 1, 2""")
def ta_pairwise_coposts_compat(spark, d):
    """The first twenty of each window of 200 entities at most."""
    return co.pairwise_co_posts(events(spark, d), 600, most_entities=200, compat_first20=True)


@query(f"""WITH e AS (SELECT entity, (epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1e6 AS gap, row_number() OVER o AS pos FROM {E_} WINDOW o AS (PARTITION BY entity ORDER BY ts, row_index)),
    c AS (SELECT entity, CAST(round_even(gap, 0) AS BIGINT) AS r, count(*) AS n, min(pos) AS f FROM e WHERE gap IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT entity, r, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, f) AS k FROM c) WHERE k = 1),
    s AS (SELECT m.entity, m.r, m.n, sum(c.n) FILTER (abs(c.r - m.r) <= 1) AS near FROM m JOIN c USING (entity) GROUP BY 1, 2, 3),
    a AS (SELECT entity, count(*) AS n_events, count(gap) AS n_intervals, avg(gap) AS mean_interval_s, CASE WHEN count(gap) = 1 THEN 0 ELSE stddev_samp(gap) END AS std_interval_s FROM e GROUP BY 1)
    SELECT entity, n_events, n_intervals, mean_interval_s, std_interval_s, CASE WHEN n_intervals > 1 AND mean_interval_s > 0 THEN std_interval_s / mean_interval_s END AS cv_interval,
        r AS modal_interval_s, n / n_intervals AS modal_interval_share, near / n_intervals AS near_modal_share,
        coalesce(n_intervals >= 5 AND n / n_intervals >= 0.5, false) AS repetition_flag FROM a LEFT JOIN s USING (entity)""")
def ta_entity_jitter(spark, d):
    return co.entity_jitter(events(spark, d))


def _amplified(seconds: int, least: int) -> str:
    return f"""(WITH e AS (SELECT *, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01') AS w FROM {E_}),
        p AS (SELECT event_type, w, entity, count(*) AS n, min(ts) AS f, arg_min(row_index, (ts, row_index)) AS fr, max(ts) AS l FROM e GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type, w ORDER BY f, fr, entity) AS i FROM p),
        g AS (SELECT event_type, w AS window_start, min(f) AS first_ts, max(l) AS last_ts, count(*) AS distinct_entities, CAST(sum(n) AS BIGINT) AS total_shares,
            string_agg(entity, ', ' ORDER BY i) FILTER (i <= 20) || CASE WHEN count(*) > 20 THEN ' …' ELSE '' END AS entities FROM r GROUP BY 1, 2 HAVING count(*) >= {least})
        SELECT row_number() OVER (ORDER BY distinct_entities DESC, total_shares DESC, event_type, window_start) AS group_id, * FROM g)"""


@query(_amplified(300, 3)[1:-1])
def ta_amplification(spark, d):
    return co.amplification(events(spark, d, "event_type"), "event_type")


@query(f"""WITH h AS (SELECT entity, hour(ts) AS h, count(*) AS n FROM {E_} GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY entity) AS p FROM h),
    a AS (SELECT entity, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS active_hours_of_24, CAST(arg_max(h, (n, -h)) AS BIGINT) AS top_hour, max(n) / sum(n) AS top_hour_share, -sum(p * log2(p)) AS hour_entropy_bits FROM p GROUP BY 1)
    SELECT *, hour_entropy_bits / log2(24) AS hour_entropy_normalized, active_hours_of_24 >= 22 AND hour_entropy_bits / log2(24) >= 0.9 AND n_events >= 20 AS always_on_flag,
        active_hours_of_24 <= 4 AND n_events >= 10 AS narrow_hours_flag FROM a""")
def ta_entity_hour_profile(spark, d):
    return co.entity_hour_profile(events(spark, d))


@query(f"""WITH a AS (SELECT entity, count(*) AS events FROM {E_} GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 50),
    n AS (SELECT entity, date_trunc('hour', ts) AS b, count(*)::DOUBLE AS x FROM {E_} WHERE entity IN (SELECT entity FROM a) GROUP BY 1, 2),
    k AS (SELECT count(DISTINCT b) AS k FROM n), s AS (SELECT entity, sum(x) AS s, sum(x * x) AS ss FROM n GROUP BY 1),
    p AS (SELECT x.entity AS entity_a, y.entity AS entity_b, sum(x.x * y.x) AS sxy FROM n x JOIN n y ON x.b = y.b AND x.entity < y.entity GROUP BY 1, 2),
    r AS (SELECT p.entity_a, p.entity_b, (k * sxy - x.s * y.s) / (sqrt(k * x.ss - x.s * x.s) * sqrt(k * y.ss - y.s * y.s)) AS pearson_r, xa.events AS events_a, ya.events AS events_b
        FROM p JOIN s x ON x.entity = entity_a JOIN s y ON y.entity = entity_b JOIN a xa ON xa.entity = entity_a JOIN a ya ON ya.entity = entity_b, k)
    SELECT * FROM r WHERE pearson_r >= 0.05""")
def ta_burst_correlation(spark, d):
    return co.burst_correlation(events(spark, d), corr_min=0.05, bin_=F.date_trunc("hour", "ts"))


@query(f"""WITH e AS (SELECT entity, ts, row_index, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts, row_index)) / 86400e6 AS dormancy_days,
        count(*) OVER (PARTITION BY entity ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS events_in_burst, count(*) OVER (PARTITION BY entity) AS total_events FROM {E_}),
    q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, row_index) AS k FROM e WHERE dormancy_days >= 1 AND events_in_burst >= 2 AND total_events > 2)
    SELECT entity, dormancy_days, ts AS reactivation_ts, ts + INTERVAL 24 HOURS AS burst_end_ts, events_in_burst, total_events FROM q WHERE k = 1""")
def ta_dormancy_bursts(spark, d):
    return co.dormancy_bursts(events(spark, d), 1, 24, 2)


@query(f"""SELECT window_id, window_start, window_end, unique_entities, ts, entity, row_index FROM {_windows(10)} w
    JOIN {E_} e ON time_bucket(INTERVAL 10 SECOND, e.ts, TIMESTAMP '1970-01-01') = w.window_start""")
def ta_near_sim_events(spark, d):
    e = events(spark, d)
    return co.events_in_windows(e, co.near_simultaneous_windows(e, 10), 10)


@query(f"""SELECT group_id, g.event_type, window_start, distinct_entities, ts, entity, row_index FROM {_amplified(300, 3)} g
    JOIN {E_} e ON time_bucket(INTERVAL 300 SECOND, e.ts, TIMESTAMP '1970-01-01') = g.window_start AND e.event_type = g.event_type""")
def ta_hashtag_storm_events(spark, d):
    e = events(spark, d, "event_type")
    return co.events_in_groups(e, co.amplification(e, "event_type"), "event_type")


_S = SQL


@query(f"""SELECT * FROM (SELECT count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT entity) AS n_entities FROM {E_}),
    (SELECT n_intervals, {', '.join(f'"{c}" AS interval_{c}' for c in ('min', 'p05', 'median', 'mean', 'p95', 'max', 'std', 'cv'))} FROM ({_S['ta_interval_stats']})),
    {', '.join(f'({_S[n]})' for n in ('ta_pct_indicators', 'ta_duplicate_share', 'ta_burst_ratio', 'ta_minute_entropy', 'ta_minute_gini', 'ta_top_minute', 'ta_autocorr_at', 'ta_copost_share_total'))},
    (SELECT count(*) AS near_simultaneous_windows, max(unique_entities) AS max_entities_in_window FROM ({_S['ta_near_sim_windows']}))""")
def ta_indicators(spark, d):
    from .bundles import indicators

    return indicators(events(spark, d))


#: Tables of the bundle and the queries that give the same rows.
BUNDLE = {"by_second": "ta_by_second", "by_minute": "ta_by_minute", "by_hour": "ta_by_hour", "by_dow": "ta_by_dow", "by_day_of_month": "ta_by_dom", "by_date": "ta_by_date", "intervals": "ta_intervals", "interval_stats": "ta_interval_stats", "interval_counts": "ta_interval_counts", "near_simultaneous_windows": "ta_near_sim_windows", "pairwise_coposts": "ta_pairwise_coposts", "entity_synchrony": "ta_entity_synchrony", "entity_jitter": "ta_entity_jitter", "entity_hour_profile": "ta_entity_hour_profile", "hashtag_storms": "ta_hashtag_storms", "autocorrelation": "ta_autocorr"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({_S[q]})" for name, q in BUNDLE.items() if q in _S and name != "hashtag_storms") + " UNION ALL SELECT 'by_hour_' || hour, count FROM (" + _S["ta_by_hour"] + ") UNION ALL SELECT 'jitter_' || entity, n_events FROM (" + _S["ta_entity_jitter"] + ") UNION ALL SELECT 'pair_' || entity_a || '_' || entity_b, copost_windows FROM (" + _S["ta_pairwise_coposts"] + ")")
def ta_orchestrate(spark, d):
    """All tables of the bundle that have a query of their own, by their numbers of rows, and three of them by their values."""
    from .bundles import TemporalOptions, temporal

    t = temporal(table(spark, d, "events"), "ts", "event_id", "user_id", hashtag="event_type", options=TemporalOptions())
    parts = [t[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, q in BUNDLE.items() if q in SQL and name != "hashtag_storms"]
    parts.append(t["by_hour"].select(F.concat(F.lit("by_hour_"), "hour"), "count"))
    parts.append(t["entity_jitter"].select(F.concat(F.lit("jitter_"), "entity"), "n_events"))
    parts.append(t["pairwise_coposts"].select(F.concat_ws("_", F.lit("pair"), "entity_a", "entity_b"), "copost_windows"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
