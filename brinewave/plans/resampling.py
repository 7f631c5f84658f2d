"""Hourly, daily, monthly chains; calendar-month climatology, anomalies and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import Completeness
from brinewave.operators import monthly as M
from brinewave.operators import resample as S
from brinewave.plans.registry import query

# thresholds chosen for the density of the given tables, not for a result
STATION_RULE = Completeness(min_hours=1, min_days=3)
MOORING_RULE = Completeness(min_hours=4, min_days=15)


def daily_sql(view: str, hours: int) -> str:
    return f"""
, b AS (SELECT site, cast(time AS date) AS day, avg(value) AS value, count(value) AS n FROM {view} GROUP BY 1, 2)
, sp AS (SELECT site, cast(unnest(generate_series(cast(min(day) AS timestamp), cast(max(day) AS timestamp), INTERVAL 1 DAY)) AS date) AS day
         FROM b GROUP BY site)
, daily AS (SELECT site, day, CASE WHEN coalesce(n, 0) >= {hours} THEN value END AS value,
            coalesce(n, 0) AS n, coalesce(n, 0) >= {hours} AS ok FROM sp LEFT JOIN b USING (site, day))"""


def monthly_sql(days: int, drop: bool = True, source: str = "daily", out: str = "monthly", key: str = "site") -> str:
    edge = ("WHERE NOT (month(l + INTERVAL 1 DAY) = month(l) AND m = date_trunc('month', l))" if drop else "")
    return f"""
, {out}_t AS (SELECT {key}, cast(date_trunc('month', day) AS date) AS m, avg(CASE WHEN ok THEN value END) AS value,
    count(*) FILTER (ok AND value IS NOT NULL) AS n FROM {source} GROUP BY 1, 2)
, {out}_l AS (SELECT {key}, max(day) AS l FROM {source} GROUP BY {key})
, {out}_s AS (SELECT {key}, cast(unnest(generate_series(cast(min(m) AS timestamp), cast(max(m) AS timestamp), INTERVAL 1 MONTH)) AS date) AS m
    FROM {out}_t GROUP BY {key})
, {out} AS (SELECT {key}, m AS month, CASE WHEN coalesce(n, 0) >= {days} THEN value END AS value,
    coalesce(n, 0) AS n, coalesce(n, 0) >= {days} AS ok
    FROM {out}_s LEFT JOIN {out}_t USING ({key}, m) JOIN {out}_l USING ({key}) {edge})"""


def clim_sql(source: str = "monthly", out: str = "clim", key: str = "site") -> str:
    return f"""
, {out} AS (SELECT {key}, calendar_month, avg(value) AS clim, stddev_samp(value) AS std, count(value) AS n_years
    FROM (SELECT DISTINCT {key}, unnest(range(1, 13)) AS calendar_month FROM {source})
    LEFT JOIN (SELECT {key}, month(month) AS calendar_month, value FROM {source} WHERE ok) USING ({key}, calendar_month)
    GROUP BY 1, 2)"""


ANOM_SQL = """
, anom AS (SELECT m.*, c.clim, m.value - c.clim AS anom FROM monthly m
           LEFT JOIN clim c ON c.site = m.site AND c.calendar_month = month(m.month))
, thr AS (SELECT site, quantile_cont(anom, 0.90) AS p90, quantile_cont(anom, 0.95) AS p95, quantile_cont(anom, 0.99) AS p99
          FROM anom GROUP BY site)"""

STATION = daily_sql("station", 1) + monthly_sql(3)
MOORING = daily_sql("mooring", 4) + monthly_sql(15)


def station_daily(v):
    return S.to_daily(v.station, min_hours=STATION_RULE.min_hours)


def station_monthly(v):
    return S.to_monthly(station_daily(v), rule=STATION_RULE)


def mooring_monthly(v):
    return S.to_monthly(S.to_daily(v.mooring, min_hours=MOORING_RULE.min_hours), rule=MOORING_RULE)


FLAGSHIP_SQL = STATION + clim_sql() + ANOM_SQL + """
SELECT site, cast(month AS string) AS month, round(value, 6) + 0.0 AS value, n, ok, round(clim, 6) + 0.0 AS clim,
       round(anom, 6) + 0.0 AS anom, round(p90, 6) + 0.0 AS p90, round(p95, 6) + 0.0 AS p95, round(p99, 6) + 0.0 AS p99,
       coalesce(anom > p90, false) AS exceeds_p90, coalesce(anom > p95, false) AS exceeds_p95,
       coalesce(anom > p99, false) AS exceeds_p99,
       cast(CASE WHEN anom > p99 THEN 99 WHEN anom > p95 THEN 95 WHEN anom > p90 THEN 90 ELSE 0 END AS bigint) AS severity
FROM anom JOIN thr USING (site)"""


@query("monthly_anomaly_exceedance", "A2 A3 A5 A6 A7 J2 J3", "station", FLAGSHIP_SQL)
def monthly_anomaly_exceedance(v):
    return M.exceedances(M.anomalies(station_monthly(v)))


@query("hourly_mean", "A1", "sensor", """
SELECT site, date_trunc('hour', time) AS time, round(avg(value), 6) AS value FROM sensor WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return S.hourly_mean(v.sensor)


@query("daily_completeness", "A2", "mooring", daily_sql("mooring", 4) + """
SELECT site, cast(day AS string) AS day, round(value, 6) AS value, n, ok FROM daily""")
def _(v):
    return S.to_daily(v.mooring, min_hours=4)


@query("monthly_mean", "A3 J2", "mooring", MOORING + """
SELECT site, cast(month AS string) AS month, round(value, 6) AS value, n, ok FROM monthly""")
def _(v):
    return mooring_monthly(v)


@query("already_daily_frame", "A4", "station", """
SELECT site, cast(cast(time AS date) AS string) AS day, round(CASE WHEN id % 9 = 0 THEN NULL ELSE value END, 6) AS value,
       cast(CASE WHEN id % 9 = 0 THEN 0 ELSE 1 END AS bigint) AS n, id % 9 <> 0 AS ok FROM station""")
def _(v):
    gappy = v.station.withColumn("value", F.when(F.col("id") % 9 == 0, float("nan")).otherwise(F.col("value")))
    return S.daily_frame(gappy, day="time")


@query("calendar_month_climatology", "A5", "mooring", MOORING + clim_sql() + """
SELECT site, calendar_month, round(clim, 6) AS clim, round(std, 6) AS std, cast(n_years AS double) AS n_years FROM clim""")
def _(v):
    return M.climatology(mooring_monthly(v)).withColumn("n_years", F.coalesce("n_years", F.lit(0)).cast("double"))


@query("anomaly_thresholds", "A6", "mooring", MOORING + clim_sql() + ANOM_SQL + """
SELECT site, round(p90, 6) AS p90, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM thr""")
def _(v):
    return M.thresholds(M.anomalies(mooring_monthly(v)))


PAIR_SQL = MOORING + """
, pr AS (SELECT a.month, a.value AS va, b.value AS vb, a.ok AND b.ok AS ok FROM monthly a JOIN monthly b USING (month)
         WHERE a.site = 'A' AND b.site = 'R')
, cl AS (SELECT month(month) AS cm, avg(va) AS ca, avg(vb) AS cb FROM pr WHERE ok GROUP BY 1)
, j AS (SELECT month, ok, CASE WHEN ok THEN va - ca END AS anom_a, CASE WHEN ok THEN vb - cb END AS anom_b
        FROM pr LEFT JOIN cl ON cm = month(month))"""


@query("common_baseline", "J5", "mooring", PAIR_SQL + """
SELECT cast(month AS string) AS month, round(anom_a, 6) + 0.0 AS anom_a, round(anom_b, 6) + 0.0 AS anom_b, ok FROM j""")
def _(v):
    return M.common_baseline(mooring_monthly(v), "A", "R")


@query("anomaly_correlation", "J6 A18", "mooring", PAIR_SQL + """
SELECT count(*) AS n_common, round(corr(anom_a, anom_b), 6) AS r FROM j WHERE anom_a IS NOT NULL AND anom_b IS NOT NULL""")
def _(v):
    joint = M.common_baseline(mooring_monthly(v), "A", "R").dropna(subset=["anom_a", "anom_b"])
    return M.correlation(joint)


@query("joint_anomalies", "J6", "mooring", MOORING + clim_sql() + ANOM_SQL + """
SELECT cast(a.month AS string) AS month, round(a.anom, 6) + 0.0 AS anom_a, round(b.anom, 6) + 0.0 AS anom_b
FROM anom a JOIN anom b USING (month) WHERE a.site = 'A' AND b.site = 'N' AND a.anom IS NOT NULL AND b.anom IS NOT NULL""")
def _(v):
    return M.joint_anomalies(M.anomalies(mooring_monthly(v)), "A", "N")


PARTIAL_SQL = daily_sql("station", 1) + monthly_sql(3, drop=False, out="fullm") + """
, monthly AS (SELECT f.*, month = date_trunc('month', l) AND month(l + INTERVAL 1 DAY) = month(l) AS partial
   FROM fullm f JOIN fullm_l USING (site))"""


@query("partial_month_shown_not_counted", "W18", "station", PARTIAL_SQL + """
, base AS (SELECT * FROM monthly WHERE NOT partial)""" + clim_sql("base") + """
SELECT site, cast(month AS string) AS month, round(value, 6) AS value, n, ok, partial, round(clim, 6) AS clim,
       round(value - clim, 6) + 0.0 AS anom FROM monthly m LEFT JOIN clim c USING (site)
WHERE c.calendar_month = month(m.month)""")
def _(v):
    return M.series_anomalies(station_daily(v), rule=STATION_RULE)


@query("shared_limit", "A31", "mooring", MOORING + clim_sql() + ANOM_SQL + """
SELECT round(max(abs(anom)) * 1.15, 6) AS "limit" FROM anom""")
def _(v):
    return M.shared_limit(M.anomalies(mooring_monthly(v)))


@query("thin_sample_months", "A34", "station", STATION + """
SELECT site, count(*) FILTER (ok) AS usable, count(*) FILTER (ok AND n < 25) AS thin FROM monthly GROUP BY site""")
def _(v):
    return M.thin_months(station_monthly(v), fewer_than=25)


@query("record_text", "A36", "station", STATION + clim_sql() + """
, s AS (SELECT site, min(day) AS a, max(day) AS b, count(*) AS n_days FROM daily WHERE value IS NOT NULL GROUP BY site)
, y AS (SELECT site, min(n_years) AS lo, max(n_years) AS hi FROM clim GROUP BY site)
SELECT site, cast(a AS string) AS first_day, cast(b AS string) AS last_day, n_days,
       concat(a, ' to ', b, ', ', lo, '-', hi, ' years per calendar month') AS baseline FROM s JOIN y USING (site)""")
def _(v):
    return M.record_text(station_daily(v), M.climatology(station_monthly(v)))
