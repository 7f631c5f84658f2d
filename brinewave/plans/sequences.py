"""Sequence queries: gaps, steps, de-duplication, thinning, windows, calendar chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import SeriesConfig
from brinewave.operators import incremental, profile
from brinewave.operators import sequences as Q
from brinewave.plans.registry import query


@query("gap_table", "W3", "sensor", """
, p AS (SELECT site, time, lag(time) OVER (PARTITION BY site ORDER BY time) AS prev
        FROM (SELECT DISTINCT site, time FROM sensor WHERE value IS NOT NULL))
SELECT site, prev AS gap_start, time AS gap_end, round((epoch_us(time) - epoch_us(prev)) / 86400e6, 6) AS days,
       cast(round_even((epoch_us(time) - epoch_us(prev)) / 86400e6 * 24, 0) AS bigint) - 1 AS missing_hours
FROM p WHERE (epoch_us(time) - epoch_us(prev)) / 86400e6 > 0.1""")
def _(v):
    return profile.gap_table(v.sensor, min_days=0.1)


@query("sampling_steps", "A16", "station", """
, p AS (SELECT site, (epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY site ORDER BY time))) / 1e6 AS step FROM station)
SELECT site, step AS step_seconds, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY site), 6) AS pct
FROM p WHERE step IS NOT NULL GROUP BY site, step""")
def _(v):
    return profile.sampling_steps(v.station, seconds=366 * 86_400)


@query("record_profile", "A17", "sensor", """
SELECT site, count(*) AS n_rows, count(value) AS n_valid, round((count(*) - count(value)) * 100.0 / count(*), 6) AS null_pct,
       min(time) AS first_time, max(time) AS last_time, min(time) FILTER (value IS NOT NULL) AS first_valid,
       max(time) FILTER (value IS NOT NULL) AS last_valid, count(*) - count(DISTINCT time) AS duplicate_stamps,
       date_diff('day', min(time), max(time)) AS span_days FROM sensor GROUP BY site""")
def _(v):
    return profile.record_profile(v.sensor)


@query("flag_histogram", "A17", "sensor", """
SELECT site, cast(flag AS bigint) AS flag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY site), 6) AS pct
FROM sensor GROUP BY site, flag""")
def _(v):
    return profile.flag_histogram(v.sensor)


@query("duplicate_stamps", "A17", "mooring", """
SELECT site, time, count(*) AS copies FROM mooring GROUP BY site, time HAVING count(*) > 1""")
def _(v):
    return profile.duplicate_stamps(v.mooring)


@query("arrival_order", "A17", "sensor", """
, p AS (SELECT site, time, lag(time) OVER (PARTITION BY site ORDER BY id) AS prev FROM sensor)
SELECT site, bool_and(coalesce(prev <= time, true)) AS monotonic FROM p GROUP BY site""")
def _(v):
    return profile.arrival_order(v.sensor, "site", "time", "id")


@query("newest_fix", "W5 G5", "obs", """
SELECT deployment, time, event_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM obs
QUALIFY row_number() OVER (PARTITION BY deployment ORDER BY time DESC, event_id) = 1""")
def _(v):
    fixes = v.obs.select("deployment", "time", "event_id", "longitude", "latitude")
    return Q.newest_fix(fixes, tie="event_id")


COARSE = """
, c AS (SELECT deployment, date_trunc('day', time) AS time, floor(depth / 400) * 400 AS depth, event_id FROM obs)"""


def coarse(v):
    """Observations rounded until many share (deployment, time, depth)."""
    return v.obs.select("deployment", F.date_trunc("day", "time").alias("time"),
                        (F.floor(F.col("depth") / 400) * 400.0).alias("depth"), "event_id")


@query("observations_deduplicated", "W6", "obs", COARSE + """
SELECT deployment, time, depth, min(event_id) AS event_id FROM c GROUP BY deployment, time, depth""")
def _(v):
    return Q.dedup_observations(coarse(v), ["event_id"])


@query("last_value_per_day", "W7", "station", """
SELECT site, cast(cast(time AS date) AS string) AS day, id, round(value, 6) AS value FROM station
QUALIFY row_number() OVER (PARTITION BY site, cast(time AS date) ORDER BY time DESC, id DESC) = 1""")
def _(v):
    rows = v.station.select("site", F.to_date("time").alias("day"), "time", "id", "value")
    return Q.keep_last(rows, ["site", "day"], ["time", "id"]).drop("time")


THIN_SQL = """
, d AS (SELECT DISTINCT site, cast(time AS date) AS day FROM station)
, mx AS (SELECT site, max(day) AS m FROM d GROUP BY site)
, walk AS (SELECT site, min(day) AS day FROM d JOIN mx USING (site) WHERE day <= m - 7 GROUP BY site
  UNION ALL
  SELECT w.site, min(d.day) FROM walk w JOIN d ON d.site = w.site AND d.day >= w.day + 7 JOIN mx ON mx.site = w.site
  WHERE d.day <= m - 7 GROUP BY w.site)
, kept AS (SELECT * FROM walk UNION ALL SELECT site, day FROM d JOIN mx USING (site) WHERE day > m - 7)"""


@query("series_thinned", "W11", "station", THIN_SQL.replace(", d AS", ", d AS", 1) + """
SELECT site, cast(day AS string) AS day FROM kept""")
def _(v):
    days = v.station.select("site", F.to_date("time").alias("day"), "value").groupBy("site", "day").agg(
        F.avg("value").alias("value"))
    return Q.thin_series(days).select("site", "day")


@query("gap_breaks", "W15", "station", """
, d AS (SELECT site, cast(time AS date) AS day, avg(value) AS value FROM station GROUP BY 1, 2)
, n AS (SELECT *, lead(day) OVER (PARTITION BY site ORDER BY day) AS nx FROM d)
SELECT site, cast(day AS string) AS day, round(value, 6) AS value FROM n
UNION ALL SELECT site, cast(day + 1 AS string), NULL FROM n WHERE nx - day > 3""")
def _(v):
    days = v.station.groupBy("site", F.to_date("time").alias("day")).agg(F.avg("value").alias("value"))
    return Q.break_gaps(days, cfg=SeriesConfig(break_days=3))


@query("every_nth_record", "W12", "obs", """
, r AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY time, event_id) AS rn FROM obs)
SELECT deployment, time, event_id FROM r WHERE (rn - 1) % 5 = 0""")
def _(v):
    return Q.every_nth(v.obs.select("deployment", "time", "event_id"), 5, "deployment", ["time", "event_id"])


@query("axis_stride", "W12", "", """
, k AS (SELECT greatest(1, count(*) // 20) AS k FROM supplier)
SELECT s_suppkey AS idx FROM supplier, k WHERE s_suppkey % k = 0""".replace(", k AS", "WITH k AS", 1))
def _(v):
    from brinewave.plans.views import table

    axis = table(v.spark, v.folder, "supplier").select(F.col("s_suppkey").alias("idx"))
    return Q.axis_stride(axis, "idx", 20)


@query("trailing_own_window", "W13", "obs", """
, l AS (SELECT *, max(time) OVER (PARTITION BY deployment) AS last FROM obs)
SELECT deployment, time, event_id FROM l WHERE time >= last - INTERVAL 3 DAY""")
def _(v):
    return Q.trailing_own(v.obs.select("deployment", "time", "event_id"), 3.0)


@query("trailing_now_window", "W14 P28", "obs", """
SELECT deployment, time, event_id FROM obs WHERE time >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY""")
def _(v):
    return Q.trailing_now(v.obs.select("deployment", "time", "event_id"), "2024-01-30", 1.0)


CHUNKS_SQL = """
, sp AS (SELECT site, min(cast(time AS date)) AS a, max(cast(time AS date)) AS b FROM station GROUP BY site)
, ch AS (SELECT site, b, k AS chunk, cast(a + to_years(cast(k AS int)) AS date) AS chunk_start,
   least(cast(a + to_years(cast(k + 1 AS int)) AS date) - 1, b) AS chunk_end
   FROM sp CROSS JOIN (SELECT unnest(range(0, 60)) AS k) WHERE a + to_years(cast(k AS int)) <= b)"""


def spans(v):
    return v.station.groupBy("site").agg(F.to_date(F.min("time")).alias("a"), F.to_date(F.max("time")).alias("b"))


@query("calendar_chunks", "W20", "station", CHUNKS_SQL + """
SELECT site, chunk, cast(chunk_start AS string) AS chunk_start, cast(chunk_end AS string) AS chunk_end FROM ch""")
def _(v):
    return Q.calendar_chunks(spans(v), "site", "a", "b")


@query("missing_chunks", "J21 W20", "station", CHUNKS_SQL + """
, ex AS (SELECT site, chunk, cast(unnest(generate_series(cast(chunk_start AS timestamp), cast(chunk_end AS timestamp), INTERVAL 7 DAY)) AS date) AS date FROM ch)
SELECT site, chunk, count(*) AS missing FROM ex
WHERE (site, date) NOT IN (SELECT (site, cast(time AS date)) FROM station) GROUP BY site, chunk""")
def _(v):
    chunks = Q.calendar_chunks(spans(v), "site", "a", "b")
    held = v.station.select("site", F.to_date("time").alias("date"))
    return incremental.missing_chunks(chunks, held, "site")


@query("month_contiguity", "W19", "station", """
, m AS (SELECT DISTINCT site, date_trunc('month', time) AS month FROM station)
, s AS (SELECT site, date_diff('month', lag(month) OVER (PARTITION BY site ORDER BY month), month) AS st FROM m)
SELECT site, bool_and(coalesce(st = 1, true)) AS contiguous FROM s GROUP BY site""")
def _(v):
    months = v.station.select("site", F.trunc(F.to_date("time"), "MM").alias("month")).distinct()
    return Q.month_order_checks(months)


@query("min_points", "S10", "obs", """
SELECT deployment, time, event_id FROM obs QUALIFY count(*) OVER (PARTITION BY deployment) >= 30""")
def _(v):
    return Q.min_points(v.obs.select("deployment", "time", "event_id"), least=30)
