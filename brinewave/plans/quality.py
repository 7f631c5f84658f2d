"""Data-quality suites as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import SCIENCE, Box, GridConfig
from brinewave.operators import checks
from brinewave.operators import grid as R
from brinewave.operators import monthly as M
from brinewave.operators.incremental import fresh_rows
from brinewave.plans.catalogues import SERIES_SQL
from brinewave.plans.gridded import CFG, CLIP_SQL, EDGE_SQL, RUNS_SQL, newest, rectangles
from brinewave.plans.ingest import FRESH_SQL, landed
from brinewave.plans.platforms import RANGED
from brinewave.plans.registry import query
from brinewave.plans.resampling import STATION_RULE, daily_sql, station_daily
from brinewave.session import cut_lineage
from brinewave.sources import archive, features


#: a variable that no archive has
STRANGER = "barometer"


def verdicts(report):
    return report.select("suite", "check", "passed")


def sql_rows(suite: str, source: str, checks_: dict[str, str]) -> str:
    """One row per check from a one-row source."""
    return " UNION ALL ".join(
        f"SELECT '{suite}' AS suite, '{name.replace(chr(39), chr(39) * 2)}' AS \"check\", coalesce({test}, false) AS passed FROM {source}"
        for name, test in checks_.items())


@query("check_observations", "Q1", "obs", """
, o AS (SELECT min(time) AS t0, max(time) AS t1, min(depth) AS d0, max(depth) AS d1, """ + ", ".join(
    f"min({n}) AS {n}_lo, max({n}) AS {n}_hi" for n in SCIENCE) + " FROM obs) " + sql_rows("observations", "o", {
        "time-floor": "year(t0) >= 2019", "time-ceiling": "t1 <= TIMESTAMP '2024-01-31 00:00:00'",
        "depth-span": "d0 >= -1 AND d1 <= 1200",
        **{f"span-{n}": f"{n}_lo IS NULL OR ({n}_lo >= {RANGED[n].split(' AND ')[0]} AND {n}_hi <= {RANGED[n].split(' AND ')[1]})"
           for n in SCIENCE}}))
def _(v):
    return verdicts(checks.check_observations(v.obs, "2024-01-30"))


@query("check_window", "Q2", "obs", """
, w AS (SELECT min(time) AS oldest, count(deployment) + count(glider) + count(latitude) + count(longitude) + count(depth) + """ + " + ".join(
    f"count({n})" for n in SCIENCE) + """ AS cells, count(*) AS n FROM obs WHERE time >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) """ + sql_rows("window", "w", {
    "window-start": "n = 0 OR oldest >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY", "window-shape": "cells > 0",
    "window-names": f"'{STRANGER}' NOT IN ({', '.join(repr(n) for n in SCIENCE)})"}))
def _(v):
    recent = archive.select_variables(archive.window(v.obs, last_days=7.0, now="2024-01-30"))
    want = ["deployment", "glider", "time", "latitude", "longitude", "depth", *SCIENCE]
    try:
        archive.select_variables(v.obs, [STRANGER])
        refused = False
    except ValueError:
        refused = True
    return verdicts(checks.check_window(recent, "2024-01-30", 7.0, recent.columns, want, refused))


@query("check_marks", "Q3", "obs", """
, k AS (SELECT deployment, max(time) AS mark FROM obs GROUP BY 1)
, a AS (SELECT bool_or(time = mark) AND bool_and(time <= mark) AS exact FROM obs JOIN k USING (deployment) GROUP BY deployment)
, m AS (SELECT count(*) AS n, (SELECT count(DISTINCT deployment) FROM obs) AS d, min(mark) AS oldest, (SELECT bool_and(exact) FROM a) AS exact FROM k) """ + sql_rows("marks", "m", {
    "mark-each": "n > 0 AND n = d", "mark-exact": "exact", "mark-own": "oldest < TIMESTAMP '2024-02-15' - INTERVAL 1 DAY"}))
def _(v):
    return verdicts(checks.check_marks(v.obs, "2024-02-15"))


@query("check_idempotency", "Q4", "obs", FRESH_SQL + """
, k AS (SELECT deployment, max(time) AS mark FROM pick GROUP BY 1)
, again AS (SELECT count(*) AS n FROM screened s LEFT JOIN k USING (deployment) WHERE mark IS NULL OR time > mark) """ + sql_rows("idempotency", "again", {
    "again-empty": "n = 0"}))
def _(v):
    rows = landed(v)
    return verdicts(checks.check_idempotency(rows, cut_lineage(fresh_rows(rows, None))))


@query("check_grid", "Q5", "grid", """
, d AS (SELECT date, count(value) AS n, min(value) AS lo, max(value) AS hi FROM grid GROUP BY date)
, g AS (SELECT count(*) AS days, min(n) AS least, max(n) AS most, min(lo) AS lo, max(hi) AS hi,
   (SELECT max(c) FROM (SELECT count(*) AS c FROM grid GROUP BY date, i, j)) AS copies FROM d) """ + sql_rows("grid", "g", {
    "grid-days": "days > 0", "grid-once": "copies = 1", "grid-filled": "least > 0",
    "grid-steady": "least = most", "value-physical": "lo > -2 AND hi < 35",
    "grid-shades": "lo >= 10 AND hi <= 20"}))
def _(v):
    return verdicts(checks.check_grid(v.grid))


def _axis_sql(index: str, centre: str) -> str:
    return f"""
, {index}e AS (SELECT {centre} AS c, {centre} - coalesce({centre} - lag({centre}) OVER w, lead({centre}) OVER w - {centre}) / 2 AS lo,
   {centre} + coalesce(lead({centre}) OVER w - {centre}, {centre} - lag({centre}) OVER w) / 2 AS hi
   FROM (SELECT DISTINCT {centre} FROM grid) WINDOW w AS (ORDER BY {centre}))
, {index}t AS (SELECT *, coalesce(abs(lo - lag(hi) OVER (ORDER BY c)) <= 1e-9, true) AS tch FROM {index}e)
, axis_{index} AS (SELECT bool_and(tch) AS touch, max(abs((lo + hi) / 2 - c)) AS drift, bool_and(hi > lo) AS rising, min(lo) AS a, max(hi) AS b FROM {index}t)"""


AXES_SQL = _axis_sql("i", "lat") + _axis_sql("j", "lon")


@query("check_geometry", "Q6", "grid", AXES_SQL + " " + " UNION ALL ".join(sql_rows("geometry", f"axis_{x}", {
    f"{n}-joined": "touch", f"{n}-centred": "drift <= 1e-9",
    f"{n}-rising": "rising"}) for n, x in (("latitude", "i"), ("longitude", "j"))))
def _(v):
    return verdicts(checks.check_geometry(v.grid))


@query("check_coverage", "Q7", "grid", AXES_SQL + " " + " UNION ALL ".join([
    sql_rows("coverage", "axis_j", {"reach-west": "a <= -126.80", "reach-east": "b >= -126.40"}),
    sql_rows("coverage", "axis_i", {"reach-south": "a <= 39.90", "reach-north": "b >= 40.03"})]))
def _(v):
    return verdicts(checks.check_coverage(v.grid, Box(-126.80, -126.40, 39.90, 40.03)))


@query("check_flags", "Q8 R1", "grid", RUNS_SQL + """
, f AS (SELECT count(*) AS n, count(*) FILTER (flagged) AS k, min(40 + i * 0.005) FILTER (flagged) AS south FROM flags) """ + sql_rows("flags", "f", {
    "flag-wet": "(SELECT count(*) FROM flags f WHERE flagged AND NOT EXISTS (SELECT 1 FROM grid g WHERE g.i = f.i AND g.j = f.j AND g.value IS NOT NULL)) = 0", "flag-few": "k < n * 0.05",
    "flag-side": "k = 0 OR south > 49"}))
def _(v):
    return verdicts(checks.check_flags(v.stored("grid"), R.flag_disconnected(v.stored("grid"))))


@query("check_polygons", "Q9 R2 R6", "grid", EDGE_SQL + """
, now AS (SELECT * FROM grid WHERE date = (SELECT max(date) FROM grid) AND value IS NOT NULL)
, rg AS (SELECT g.*, [[west, south], [east, south], [east, north], [west, north], [west, south]] AS ring, south, north, west, east
   FROM now g JOIN le USING (i) JOIN oe USING (j))
, q AS (SELECT count(*) AS n, (SELECT count(*) FROM now) AS want, bool_and(ring[1] = ring[5]) AS shut, bool_and(len(list_distinct(ring)) = 4) AS four,
   bool_and(lat IS NOT NULL AND lon IS NOT NULL) AS fields, bool_and(NOT isnan(value)) AS finite,
   bool_and(lat BETWEEN south AND north AND lon BETWEEN west AND east) AS centred, bool_and(abs(south) <= 90 AND abs(north) <= 90 AND abs(west) <= 180 AND abs(east) <= 180) AS ordered FROM rg) """ + sql_rows("features", "q", {
    "shape-each": "n = want", "ring-shut": "shut", "ring-four": "four", "shape-fields": "fields", "shape-number": "finite", "ring-centre": "centred", "ring-order": "ordered"}))
def _(v):
    return verdicts(checks.check_polygons(cut_lineage(R.cell_polygons(v.stored("grid"), cfg=CFG)), newest(v.stored("grid"))))


@query("check_clipped", "Q10 A32 A33", "grid mask", CLIP_SQL + """
, nr AS (SELECT r.i, r.j, r.south, r.north, r.west, r.east, m.lat, m.lon, m.water FROM rect r JOIN mask m
   ON m.r // 5 = r.i AND m.c // 5 = r.j)
, k AS (SELECT DISTINCT i, j FROM parts)
, wd AS (SELECT count(*) AS v FROM (SELECT i, j FROM nr ANTI JOIN k USING (i, j) WHERE lat >= south + 0.0003 AND lat < north - 0.0003
   AND lon >= west + 0.0003 AND lon < east - 0.0003 GROUP BY i, j HAVING bool_or(water)))
, al AS (SELECT count(*) AS v FROM (SELECT i, j FROM nr SEMI JOIN k USING (i, j) WHERE lat >= south - 0.0003 AND lat <= north + 0.0003
   AND lon >= west - 0.0003 AND lon <= east + 0.0003 GROUP BY i, j HAVING NOT bool_or(water)))
, b0 AS (SELECT count(*) FILTER (NOT water) * 1.0 / count(*) AS v FROM nr WHERE lat >= south AND lat < north AND lon >= west AND lon < east)
, a0 AS (SELECT count(*) FILTER (NOT water) * 1.0 / count(*) AS v FROM parts p JOIN mask m ON m.r // 5 = p.i AND m.c // 5 = p.j AND lat >= s AND lat < n AND lon >= w AND lon < e)
, q AS (SELECT (SELECT count(*) FROM rect) AS cells, (SELECT count(*) FROM k) AS kept, (SELECT v FROM wd) AS wrongly, (SELECT v FROM al) AS all_land,
   (SELECT v FROM b0) AS bf, (SELECT v FROM a0) AS af, (SELECT count(*) * 1.0 / count(DISTINCT (i, j)) FROM parts) AS mp) """ + sql_rows("clipped", "q", {
    "part-open": "(SELECT bool_and(n > s AND e > w) FROM parts)", "clip-fewer": "kept <= cells",
    "clip-few": "cells - kept < cells * 0.05", "clip-water": "wrongly = 0",
    "clip-land": "all_land = 0", "clip-less": "af < bf",
    "clip-trace": "af < 0.005", "clip-parts": "mp < 2"}))
def _(v):
    rect = cut_lineage(rectangles(v))
    mask = R.pack_mask(v.stored("mask"))
    parts = cut_lineage(R.clip_parts(rect, mask, CFG))
    return verdicts(checks.check_clipped(rect, parts, mask, margin=0.0003))


@query("check_layer", "Q11 S16", "grid mask", CLIP_SQL + """
, kept AS (SELECT i, j, count(*) AS p FROM parts GROUP BY i, j)
, ly AS (SELECT g.date, g.i, g.j, g.value, g.lat, g.lon, p FROM grid g JOIN kept USING (i, j) WHERE g.value IS NOT NULL)
, q AS (SELECT count(*) AS n, (SELECT count(*) FROM ((SELECT DISTINCT date FROM grid) EXCEPT (SELECT DISTINCT date FROM ly))) AS apart, max(date) AS newest,
   (SELECT max(date) FROM grid) AS last, bool_and(lat IS NOT NULL AND lon IS NOT NULL) AS fields, bool_and(p > 0) AS parted,
   count(value) AS valued, (SELECT count(*) FROM (SELECT DISTINCT date, i, j FROM ly)) AS again FROM ly) """ + sql_rows("layer", "q", {
    "layer-dates": "apart = 0", "layer-newest": "newest = last", "layer-size": "n = again", "shape-fields": "fields", "layer-parts": "parted",
    "note-color_range": "valued > 0", "note-source_caveat": "last IS NOT NULL"}))
def _(v):
    grid, mask = v.stored("grid"), R.pack_mask(v.stored("mask"))
    flags = cut_lineage(R.flag_disconnected(grid))
    layer = R.polygons_of(grid, grid, CFG, mask, flags)
    colors = layer.agg(F.concat_ws("..", F.floor(F.min("value")), F.ceil(F.max("value")))).scalar()
    meta = cut_lineage(features.layer_metadata(layer, color_range=colors, source_caveat=F.concat(F.lit("analysis to "), "default_date")))
    fresh = R.polygons_of(grid, grid, GridConfig(decimals=4, mask_epsilon=1e-4), mask, flags)
    return verdicts(checks.check_layer(layer, grid, fresh.select("date", "i", "j"), meta))


@query("check_point_layer", "Q12 W18 W19", "station", SERIES_SQL + """
, dd AS (SELECT site, day, count(*) AS c FROM daily GROUP BY site, day)
, lst AS (SELECT *, max(month) OVER (PARTITION BY site) AS newest FROM an)
, ms AS (SELECT site, count(*) FILTER (partial) AS open, bool_and(NOT partial OR month = newest) AS tail, count(DISTINCT month) AS n,
   date_diff('month', min(month), max(month)) + 1 AS span, max(abs(value - clim - anom)) AS off FROM lst GROUP BY site)
, cs AS (SELECT site, count(DISTINCT calendar_month) AS m FROM clim GROUP BY site)
, q AS (SELECT (SELECT min(l) FROM (SELECT max(day) AS l FROM daily GROUP BY site)) AS least_end, (SELECT max(c) FROM dd) AS copies,
   (SELECT min(value) FROM daily) AS lo, (SELECT max(value) FROM daily) AS hi, (SELECT bool_and(n = span) FROM ms) AS chain, (SELECT max(open) FROM ms) AS open,
   (SELECT bool_and(tail) FROM ms) AS tail, (SELECT max(off) FROM ms) AS off, (SELECT bool_and(m = 12) FROM cs) AS twelve) """ + sql_rows("points", "q", {
    "series-end": "least_end >= DATE '2001-07-01'", "series-once": "copies = 1", "value-physical": "lo >= -2 AND hi <= 30", "month-chain": "chain",
    "month-open": "open <= 1", "month-tail": "tail", "anomaly-sum": "off IS NULL OR off <= 0.011", "year-full": "twelve"}))
def _(v):
    daily = cut_lineage(station_daily(v))
    anom = cut_lineage(M.series_anomalies(daily, rule=STATION_RULE))
    clim = M.climatology(anom.where(~F.col("partial")))
    return verdicts(checks.check_point_layer(daily, anom, clim, "2001-07-01"))
