"""Day-of-year climatology, scoring of readings, buoy screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brinewave.config import ScreenConfig
from brinewave.functions import columns as C
from brinewave.operators import screening
from brinewave.operators import yearday as Y
from brinewave.plans.registry import query
from brinewave.plans.views import rounded, table

YD = "(dayofyear({t}) - CASE WHEN dayofyear(make_date(year({t}), 12, 31)) = 366 AND dayofyear({t}) >= 60 THEN 1 ELSE 0 END)"


def yd(t: str) -> str:
    return YD.format(t=t)


def pooled_sql(view: str, out: str = "pool", half: int = 7) -> str:
    return f"""
, {out}_d AS (SELECT site, time, value, {yd('time')} AS yd FROM {view} WHERE value IS NOT NULL)
, {out} AS (SELECT site, (yd + k - 1 + 365) % 365 + 1 AS yearday, value, year(time) AS y
    FROM {out}_d CROSS JOIN (SELECT unnest(range(-{half}, {half} + 1)) AS k))"""


PCT = (5, 10, 25, 50, 75, 90, 95)
CLIM_SQL = pooled_sql("station") + """
, raw AS (SELECT site, yearday, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n, count(DISTINCT y) AS n_years, """ + ", ".join(
    f"quantile_cont(value, {p / 100}) AS p{p:02d}" for p in PCT) + """ FROM pool GROUP BY 1, 2)
, days AS (SELECT DISTINCT site, unnest(range(1, 366)) AS yearday FROM station)
, m AS (SELECT site, yearday, CASE WHEN n_years >= 3 THEN mean END AS mean, CASE WHEN n_years >= 3 THEN sd END AS sd,
    coalesce(n, 0) AS n, coalesce(n_years, 0) AS n_years, """ + ", ".join(
    f"CASE WHEN n_years >= 3 THEN p{p:02d} END AS p{p:02d}" for p in PCT) + """ FROM days LEFT JOIN raw USING (site, yearday))
, whole AS (SELECT site, count(mean) = 365 AS w FROM m GROUP BY site)
, sm AS (SELECT site, (yearday + k - 1 + 365) % 365 + 1 AS yearday, avg(mean) AS smean, CASE WHEN count(sd) = 5 THEN avg(sd) END AS ssd
    FROM m CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) GROUP BY 1, 2)
, clim AS (SELECT m.* REPLACE (CASE WHEN w THEN smean ELSE mean END AS mean, CASE WHEN w THEN ssd ELSE sd END AS sd)
    FROM m JOIN sm USING (site, yearday) JOIN whole USING (site))"""


def station_clim(v, percentiles=True):
    return Y.build_climatology(v.station, percentiles=percentiles)


@query("yearday_climatology", "A8 A9 P18", "station", CLIM_SQL + """
SELECT site, yearday, round(mean, 6) AS mean, round(sd, 6) AS sd, n, n_years, """ + ", ".join(
    f"round(p{p:02d}, 6) AS p{p:02d}" for p in PCT) + """,
    round(mean - sd, 6) AS lo1, round(mean + sd, 6) AS hi1, round(mean - 2 * sd, 6) AS lo2, round(mean + 2 * sd, 6) AS hi2 FROM clim""")
def _(v):
    return station_clim(v)


@query("yearday_cycle", "P17 P18", "", f"""
SELECT o_orderkey AS id, {yd('o_orderdate')} AS yearday,
       ({yd('o_orderdate')} - 7 - 1 + 365) % 365 + 1 AS window_first, ({yd('o_orderdate')} + 7 - 1) % 365 + 1 AS window_last FROM orders""")
def _(v):
    o = table(v.spark, v.folder, "orders")
    days = C.circular_days(C.yearday("o_orderdate"), 7)
    return o.select(F.col("o_orderkey").alias("id"), C.yearday("o_orderdate").alias("yearday"),
                    F.element_at(days, 1).alias("window_first"), F.element_at(days, -1).alias("window_last"))


SCORED_SQL = CLIM_SQL + f"""
, sc AS (SELECT s.site, s.id, s.time, s.value, c.mean AS clim_mean, c.sd AS clim_sd, s.value - c.mean AS anomaly,
    (s.value - c.mean) / nullif(c.sd, 0) AS z FROM (SELECT *, {yd('time')} AS yd FROM station) s
    LEFT JOIN clim c ON c.site = s.site AND c.yearday = s.yd)
, scored AS (SELECT *, CASE WHEN abs(z) <= 1 THEN 0 WHEN abs(z) <= 2 THEN 1 ELSE 2 END AS band,
    CASE WHEN z IS NULL THEN 'no climatology' WHEN abs(z) <= 1 THEN 'normal'
         WHEN abs(z) <= 2 THEN concat('unusually ', CASE WHEN z > 0 THEN 'warm' ELSE 'cool' END, ' (outside 1 sigma)')
         ELSE concat('extreme ', CASE WHEN z > 0 THEN 'warm' ELSE 'cool' END, ' (outside 2 sigma)') END AS label FROM sc)"""


@query("series_classified", "J4 P19", "station", SCORED_SQL + """
SELECT site, id, round(anomaly, 6) + 0.0 AS anomaly, round(z, 6) + 0.0 AS z, cast(band AS bigint) AS band, label, z IS NOT NULL AS scored FROM scored""")
def _(v):
    return Y.classify_series(station_clim(v, False), v.station).select(
        "site", "id", "anomaly", "z", "band", "label", "scored")


READINGS_SQL = """
, readings AS (SELECT l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS reading_id, o_orderpriority AS site,
    l_shipdate AS time, l_extendedprice / 9973e0 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def readings(v):
    """All order lines as readings to be scored against the order-date record."""
    # placed by order once, for the copies as for the join; the join drops lines without one
    lines = table(v.spark, v.folder, "lineitem").where("l_orderkey is not null").repartition("l_orderkey")
    li = lines.withColumn("copy", F.row_number().over(
        Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")))
    # an id is that of one line, so only lines of an order that comes more than once share theirs
    o = table(v.spark, v.folder, "orders").withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("o_orderkey")) > 1)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "copy").alias("reading_id"), F.col("o_orderpriority").alias("site"),
        F.col("l_shipdate").alias("time"), (F.col("l_extendedprice") / 9973.0).alias("value"), "repeated")


@query("readings_scored", "A10", "station", CLIM_SQL + READINGS_SQL + f"""
, r AS (SELECT *, {yd('time')} AS yearday FROM readings)
, srt AS (SELECT site, yearday, value FROM pool)
, below AS (SELECT r.reading_id, count(*) AS n_compared, sum(CASE WHEN p.value < r.value THEN 1 ELSE 0 END) AS b,
    min(p.value) AS window_min, max(p.value) AS window_max FROM r JOIN srt p ON p.site = r.site AND p.yearday = r.yearday GROUP BY 1)
SELECT reading_id, r.site, r.yearday, round(r.value - c.mean, 6) + 0.0 AS anomaly, round(CASE WHEN c.sd > 0 THEN (r.value - c.mean) / c.sd END, 6) + 0.0 AS z,
    cast(CASE WHEN c.sd > 0 AND abs((r.value - c.mean) / c.sd) <= 1 THEN 0 WHEN c.sd > 0 AND abs((r.value - c.mean) / c.sd) <= 2 THEN 1 ELSE 2 END AS bigint) AS band,
    coalesce(c.sd > 0 AND r.value IS NOT NULL, false) AS scored,
    round(b * 100.0 / n_compared, 6) AS percentile, n_compared, round(window_min, 6) AS window_min, round(window_max, 6) AS window_max
FROM r LEFT JOIN clim c ON c.site = r.site AND c.yearday = r.yearday LEFT JOIN below USING (reading_id)""")
def _(v):
    scored = Y.score_readings(readings(v), station_clim(v, False), v.station, strict=False, repeated="repeated")
    scored = scored.select("reading_id", "site", "yearday", "anomaly", "z", "band", F.col("z").isNotNull().alias("scored"), "percentile",
                           "n_compared", "window_min", "window_max")
    return rounded(scored, "anomaly", "z", "percentile", "window_min", "window_max")


@query("readings_table", "A11 G6", "station", CLIM_SQL + READINGS_SQL + f"""
, r AS (SELECT *, {yd('time')} AS yearday FROM readings)
, below AS (SELECT r.reading_id, count(*) AS n_compared, sum(CASE WHEN p.value < r.value THEN 1 ELSE 0 END) AS b
    FROM r JOIN pool p ON p.site = r.site AND p.yearday = r.yearday GROUP BY 1)
, last AS (SELECT site, arg_max(value, (time, value)) AS archived_last, max(time) AS archived_time FROM station WHERE value IS NOT NULL GROUP BY site)
, depths AS (SELECT site, CASE WHEN left(site, 1) <> '5' THEN 10.0 * cast(left(site, 1) AS double) END AS depth FROM (SELECT DISTINCT site FROM station))
, places AS (SELECT *, row_number() OVER (ORDER BY depth NULLS FIRST, site) AS place FROM depths)
, s AS (SELECT r.*, c.mean AS m, CASE WHEN c.sd > 0 THEN c.sd END AS s FROM r LEFT JOIN clim c ON c.site = r.site AND c.yearday = r.yearday)
SELECT s.reading_id, s.site, depth, place, s.time, round(s.value, 6) AS reading, round(m, 6) AS clim_mean, round(s.s, 6) AS sd,
    round(m - s.s, 6) AS lo1, round(m + s.s, 6) AS hi1, round(m - 2 * s.s, 6) AS lo2, round(m + 2 * s.s, 6) AS hi2,
    round(s.value - m, 6) AS anomaly, round((s.value - m) / s.s, 6) AS z, round(b * 100.0 / n_compared, 6) AS percentile,
    CASE WHEN s.s IS NULL OR s.value IS NULL THEN 'no climatology' WHEN abs((s.value - m) / s.s) <= 1 THEN 'normal'
         WHEN abs((s.value - m) / s.s) <= 2 THEN concat('unusually ', CASE WHEN s.value > m THEN 'warm' ELSE 'cool' END, ' (outside 1 sigma)')
         ELSE concat('extreme ', CASE WHEN s.value > m THEN 'warm' ELSE 'cool' END, ' (outside 2 sigma)') END AS verdict,
    round(archived_last, 6) AS archived_last, archived_time
FROM s LEFT JOIN below USING (reading_id) LEFT JOIN last ON last.site = s.site LEFT JOIN places ON places.site = s.site""")
def _(v):
    first = F.substring("site", 1, 1)
    sites = v.station.select("site").distinct().withColumn("depth", F.when(first != "5", 10.0 * first.cast("double")))
    # what a site or a day has is rounded there, and not again for each reading
    clim = rounded(station_clim(v, False), "lo1", "hi1", "lo2", "hi2")
    scored = Y.score_table(readings(v), clim, v.station, rounded(sites, "depth"), strict=False, repeated="repeated")
    return rounded(scored, "reading", "clim_mean", "sd", "anomaly", "z", "percentile", "archived_last")


@query("reading_drift", "J22", "station", READINGS_SQL + """
, last AS (SELECT site, arg_max(value, time) AS archived_last, max(time) AS archived_time FROM station
           WHERE (site, time) IN (SELECT (site, max(time)) FROM station GROUP BY site) GROUP BY site)
SELECT reading_id, site, round(value, 6) AS value, archived_time FROM readings JOIN last USING (site)
WHERE archived_time > time - INTERVAL 7 DAY AND abs(value - archived_last) > 0.1""")
def _(v):
    return Y.drift(readings(v), v.station).select("reading_id", "site", "value", "archived_time")


@query("band_shares", "A12", "station", SCORED_SQL + """
SELECT site, cast(band AS bigint) AS band, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY site), 6) AS pct
FROM scored GROUP BY site, band""")
def _(v):
    return Y.band_shares(Y.classify_series(station_clim(v, False), v.station))


@query("seasonal_extremes", "A13", "station", CLIM_SQL + """
SELECT site, arg_min(yearday, (round(mean, 9), yearday)) FILTER (WHERE mean IS NOT NULL) AS coldest_day, round(min(mean), 6) AS coldest,
       arg_max(yearday, (round(mean, 9), -yearday)) FILTER (WHERE mean IS NOT NULL) AS warmest_day,
       round(max(mean), 6) AS warmest, round(max(mean) - min(mean), 6) AS amplitude, round(min(sd), 6) AS sd_min,
       round(max(sd), 6) AS sd_max, round(median(sd), 6) AS sd_median, min(n) AS n_min, max(n) AS n_max,
       min(n_years) AS years_min, max(n_years) AS years_max FROM clim GROUP BY site""")
def _(v):
    return Y.seasonal_extremes(station_clim(v, False))


@query("monthly_mean_z", "A14", "station", SCORED_SQL + """
SELECT site, strftime(date_trunc('month', time), '%Y-%m-%d') AS month, round(avg(z), 6) + 0.0 AS z FROM scored GROUP BY 1, 2""")
def _(v):
    return Y.monthly_z(Y.classify_series(station_clim(v, False), v.station))


@query("overlay_year", "A15", "station", """
, y AS (SELECT site, year(time) AS y, count(DISTINCT cast(time AS date)) AS n FROM station GROUP BY 1, 2)
SELECT site, coalesce(max(y) FILTER (n >= 200), max(y)) AS overlay_year FROM y GROUP BY site""")
def _(v):
    return Y.overlay_year(v.station)


@query("mooring_position", "A29 P10", "sites obs", """
SELECT deployment AS site, round(median(latitude), 6) AS lat, round(-abs(median(-longitude)), 6) AS lon,
       round(median(depth), 6) AS water_depth FROM obs GROUP BY deployment""")
def _(v):
    rows = v.obs.select(F.col("deployment").alias("site"), F.col("latitude").alias("lat"),
                        (-F.col("longitude")).alias("lon"), "depth")
    return Y.site_position(rows)


# the screen at the density of the given sensors: a narrower floor
SCREEN = ScreenConfig(low=0.5, high=20.0, floor=0.5, sds=2.0)


def despike_sql(view: str) -> str:
    return f"""
, s0 AS (SELECT site, time, epoch_us(time) AS us, value FROM {view} WHERE value BETWEEN 0.5 AND 20)
, s1 AS (SELECT *, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS med FROM s0
   WINDOW w AS (PARTITION BY site ORDER BY us RANGE BETWEEN 23399999999 PRECEDING AND 23400000000 FOLLOWING))
, s2 AS (SELECT *, value - med AS res FROM s1)
, s3 AS (SELECT *, CASE WHEN count(res) OVER w >= 5 THEN quantile_cont(abs(res), 0.5) OVER w END AS mad FROM s2
   WINDOW w AS (PARTITION BY site ORDER BY us RANGE BETWEEN 23399999999 PRECEDING AND 23400000000 FOLLOWING))
, spk AS (SELECT site, time, value FROM s3 WHERE mad IS NOT NULL AND abs(res) <= greatest(0.5, 2.0 * 1.4826 * mad))"""


@query("rolling_despike", "W1", "sensor", despike_sql("sensor") + """
SELECT site, time, round(value, 6) AS value FROM spk""")
def _(v):
    inside = v.sensor.where(F.col("value").between(SCREEN.low, SCREEN.high))
    return screening.despike(inside, cfg=SCREEN).select("site", "time", "value")


def outlier_sql(view: str, out: str, sds: float) -> str:
    return pooled_sql(view, f"{out}_pool") + f"""
, {out}_c AS (SELECT site, yearday, quantile_cont(value, 0.5) AS centre FROM {out}_pool GROUP BY 1, 2)
, {out}_s AS (SELECT site, yearday, 1.4826 * quantile_cont(abs(value - centre), 0.5) AS scale, any_value(centre) AS centre
    FROM {out}_pool JOIN {out}_c USING (site, yearday) GROUP BY 1, 2)
, {out} AS (SELECT v.* FROM (SELECT *, {yd('time')} AS yd FROM {view}) v LEFT JOIN {out}_s s ON s.site = v.site AND s.yearday = v.yd
    WHERE NOT coalesce(abs(v.value - s.centre) > {sds} * s.scale, false))"""


@query("yearday_outliers_dropped", "W2", "station", outlier_sql("station", "kept", 1.5) + """
SELECT site, id, time, round(value, 6) AS value FROM kept""")
def _(v):
    return screening.drop_yearday_outliers(v.station, cfg=ScreenConfig(sds=1.5)).select("site", "id", "time", "value")


@query("buoy_screening_tally", "P3 W1 W2 A1", "sensor", despike_sql("sensor") + """
, hr AS (SELECT site, date_trunc('hour', time) AS time, avg(value) AS value FROM spk GROUP BY 1, 2)
""" + outlier_sql("hr", "fin", 2.0) + """
SELECT site, r AS raw_records, r - i AS out_of_range, i - k AS spikes, h AS hourly_bins, h - f AS day_of_year_outliers, f AS kept FROM
 (SELECT site, count(*) AS r, count(*) FILTER (value BETWEEN 0.5 AND 20) AS i FROM sensor GROUP BY site)
 JOIN (SELECT site, count(*) AS k FROM spk GROUP BY site) USING (site)
 JOIN (SELECT site, count(*) AS h FROM hr GROUP BY site) USING (site)
 JOIN (SELECT site, count(*) AS f FROM fin GROUP BY site) USING (site)""")
def _(v):
    return screening.screen_tally(v.sensor, cfg=SCREEN)
