"""Spatial queries: cell snap, nearest, crops, product comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import Box
from brinewave.operators import grid as R
from brinewave.operators import spatial as P
from brinewave.plans.registry import query
from brinewave.plans.views import table

# points over the grid's own area: a part is a click, coordinates follow its key
CLICKS_SQL = """
, clicks AS (SELECT p_partkey AS point_id, 40e0 + ((p_partkey * 37) % 4799) * 0.0001e0 + 0.00003e0 AS lat,
   -126.8e0 + ((p_partkey * 53) % 4699) * 0.0001e0 + 0.00003e0 AS lon FROM part)
, la AS (SELECT DISTINCT i, lat FROM grid) , lo AS (SELECT DISTINCT j, lon FROM grid)
, le AS (SELECT i, lat, lat - coalesce(lat - lag(lat) OVER w, lead(lat) OVER w - lat) / 2 AS a,
   lat + coalesce(lead(lat) OVER w - lat, lat - lag(lat) OVER w) / 2 AS b FROM la WINDOW w AS (ORDER BY lat))
, oe AS (SELECT j, lon, lon - coalesce(lon - lag(lon) OVER w, lead(lon) OVER w - lon) / 2 AS a,
   lon + coalesce(lead(lon) OVER w - lon, lon - lag(lon) OVER w) / 2 AS b FROM lo WINDOW w AS (ORDER BY lon))"""
SNAP_SQL = CLICKS_SQL + """
, snapped AS (SELECT point_id, i, j FROM clicks c JOIN le ON c.lat > le.a AND c.lat <= le.b JOIN oe ON c.lon > oe.a AND c.lon <= oe.b)"""


def clicks(v):
    k = F.col("p_partkey")
    return table(v.spark, v.folder, "part").select(
        k.alias("point_id"),
        (F.lit(40.0) + ((k * 37) % 4799) * F.lit(0.0001) + F.lit(0.00003)).alias("lat"),
        (F.lit(-126.8) + ((k * 53) % 4699) * F.lit(0.0001) + F.lit(0.00003)).alias("lon"))


def edges(v):
    g = v.grid
    return R.axis_edges(R.axis_of(g, "i", "lat")), R.axis_edges(R.axis_of(g, "j", "lon"))


@query("cell_snap", "J7", "grid", SNAP_SQL + "SELECT point_id, i, j FROM snapped")
def _(v):
    lat, lon = edges(v)
    return P.resolve_cell(clicks(v), lat, lon).select("point_id", "i", "j")


@query("cell_snap_uniform", "J7", "grid", CLICKS_SQL + """
SELECT point_id, cast(ceil((lat - 39.9975) / 0.005) - 1 AS bigint) AS i, cast(ceil((lon + 126.8025) / 0.005) - 1 AS bigint) AS j FROM clicks""")
def _(v):
    return clicks(v).select("point_id", P.snap_uniform("lat", 39.9975, 0.005).alias("i"),
                            P.snap_uniform("lon", -126.8025, 0.005).alias("j"))


@query("nearest_centre", "J8", "grid", CLICKS_SQL + """
SELECT point_id, arg_min(i, (abs(c.lat - la.lat), i)) AS i FROM clicks c, la GROUP BY point_id""")
def _(v):
    axis = R.axis_of(v.grid, "i", "lat")
    return P.nearest_index(clicks(v), axis, "lat", "i").select("point_id", "i")


@query("nearest_site", "J9", "points sites", """
SELECT point_id, s.site, round(greatest(abs(p.lon - s.lon), abs(p.lat - s.lat)), 6) AS distance FROM points p, sites s
WHERE greatest(abs(p.lon - s.lon), abs(p.lat - s.lat)) < 0.03
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY greatest(abs(p.lon - s.lon), abs(p.lat - s.lat)), s.site) = 1""")
def _(v):
    return P.nearest_site(v.points, v.sites, "point_id", "site")


@query("first_track_hit", "J10", "points obs", """
, t AS (SELECT deployment, longitude AS lon, latitude AS lat FROM obs)
SELECT point_id, min(deployment) AS deployment FROM points p JOIN t ON abs(p.lon - t.lon) < 0.0499 AND abs(p.lat - t.lat) < 0.0499
GROUP BY point_id""")
def _(v):
    fixes = v.obs.select("deployment", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return P.first_track(v.points, fixes, "point_id", "deployment", tol=0.0499)


SHORE_SQL = """
, sh AS (SELECT site, 39.9e0 + (site * 61 % 1000) * 0.0007e0 AS lat, -126.9e0 + (site * 37 % 1000) * 0.0007e0 AS lon FROM sites)
, ocean AS (SELECT DISTINCT lat, lon FROM grid WHERE value IS NOT NULL)"""


@query("distance_to_water", "J11", "sites grid", SHORE_SQL + """
SELECT site, round(min(sqrt(power((o.lat - s.lat) * 110.57, 2) + power((o.lon - s.lon) * 111.32 * cos(radians(s.lat)), 2))), 6) AS km
FROM sh s, ocean o GROUP BY site""")
def _(v):
    k = F.col("site")
    shore = v.sites.select("site", (F.lit(39.9) + (k * 61 % 1000) * F.lit(0.0007)).alias("lat"),
                           (F.lit(-126.9) + (k * 37 % 1000) * F.lit(0.0007)).alias("lon"))
    return P.distance_to_water(shore, v.grid, "site")


@query("nearest_time_step", "J12", "sensor", """
, st AS (SELECT DISTINCT site, time FROM sensor WHERE value IS NOT NULL)
, tg AS (SELECT o_orderkey AS target_id, ['click','view','error','signup','purchase'][o_orderkey % 5 + 1] AS site,
   TIMESTAMP '2023-12-31' + to_minutes(cast(o_orderkey * 7 % 46000 AS int)) AS time FROM orders)
, b AS (SELECT tg.site, target_id, tg.time AS t, st.time AS s FROM tg ASOF LEFT JOIN st ON st.site = tg.site AND st.time <= tg.time)
, a AS (SELECT tg.site, target_id, st.time AS s FROM tg ASOF LEFT JOIN st ON st.site = tg.site AND st.time >= tg.time)
SELECT b.site, b.target_id, b.t AS target_time, CASE WHEN b.s IS NULL THEN a.s WHEN a.s IS NULL THEN b.s
   WHEN epoch_us(a.s) - epoch_us(b.t) <= epoch_us(b.t) - epoch_us(b.s) THEN a.s ELSE b.s END AS step_time
FROM b JOIN a USING (target_id)""")
def _(v):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in ("click", "view", "error", "signup", "purchase")])
    targets = table(v.spark, v.folder, "orders").select(
        k.alias("target_id"), F.element_at(names, (k % 5 + 1).cast("int")).alias("site"),
        (F.lit("2023-12-31").cast("timestamp") + F.make_dt_interval(
            F.lit(0), F.lit(0), (k * 7 % 46000).cast("int"))).alias("time"))
    return P.nearest_step(targets, v.sensor.where(F.col("value").isNotNull()), "site", "target_id")


@query("coverage_crop", "J23 W12 S9", "obs grid", """
, f AS (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM
   (SELECT -126.8e0 + (c_custkey % 300) * 0.001e0 AS lon, 40e0 + (c_custkey % 200) * 0.001e0 AS lat FROM customer))
SELECT i, j, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT DISTINCT i, j, lon, lat FROM grid), f
WHERE lon BETWEEN a - 0.02 AND b + 0.02 AND lat BETWEEN c - 0.02 AND d + 0.02""")
def _(v):
    k = F.col("c_custkey")
    data = table(v.spark, v.folder, "customer").select(
        (F.lit(-126.8) + (k % 300) * F.lit(0.001)).alias("lon"), (F.lit(40.0) + (k % 200) * F.lit(0.001)).alias("lat"))
    cells = v.grid.select("i", "j", "lon", "lat").distinct()
    return P.coverage_crop(cells, data)


@query("same_cell_guard", "J25", "grid", """
, c AS (SELECT i, j, min(lat) AS lat, min(lon) AS lon FROM grid GROUP BY i, j)
SELECT concat(i, '/', j) AS key, i % 10 <> 3 AS same FROM c""")
def _(v):
    cells = v.grid.groupBy("i", "j").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).select(
        F.concat_ws("/", "i", "j").alias("key"), "i", "lat", "lon")
    moved = cells.withColumn("lat", F.col("lat") + F.when(F.col("i") % 10 == 3, 0.001).otherwise(0.0))
    return P.same_cell(moved, cells.drop("i"), "key")


REGION = Box(-126.7, -126.4, 40.01, 40.35)
PRODUCTS_SQL = """
, pr AS (SELECT source AS product, date, i, j, lat, lon, value FROM grid)"""


def products(v):
    return v.grid.withColumnRenamed("source", "product")


@query("region_statistics", "A27", "grid", PRODUCTS_SQL + """
SELECT product, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low,
       round(max(value), 6) AS high, round(max(value) - min(value), 6) AS "range" FROM pr
WHERE lon BETWEEN -126.7 AND -126.4 AND lat BETWEEN 40.01 AND 40.35 AND value IS NOT NULL GROUP BY product""")
def _(v):
    return P.region_stats(products(v), box=REGION)


@query("product_variability", "A27", "grid", PRODUCTS_SQL + """
, st AS (SELECT product, count(value) AS n, stddev_pop(value) AS std FROM pr
  WHERE lon BETWEEN -126.7 AND -126.4 AND lat BETWEEN 40.01 AND 40.35 AND value IS NOT NULL GROUP BY product)
SELECT round(f.std / c.std, 6) AS std_ratio, round(f.n * 1.0 / c.n, 6) AS pixel_ratio,
       CASE WHEN f.std / c.std < 0.6 THEN 'interpolation' WHEN f.std / c.std > 0.9 THEN 'signal' ELSE 'intermediate' END AS verdict
FROM st f, st c WHERE f.product = 'prelim' AND c.product = 'final'""")
def _(v):
    return P.variability_ratio(P.region_stats(products(v), box=REGION), "final", "prelim")


@query("product_census", "A28", "grid", PRODUCTS_SQL + """
, u AS (SELECT product, max(date) AS used FROM pr WHERE value IS NOT NULL GROUP BY product)
, f AS (SELECT pr.* FROM pr JOIN u ON u.product = pr.product AND u.used = pr.date)
, ax AS (SELECT product, lat, lead(lat) OVER (PARTITION BY product ORDER BY lat) - lat AS s FROM (SELECT DISTINCT product, lat FROM f))
, ay AS (SELECT product, lon, lead(lon) OVER (PARTITION BY product ORDER BY lon) - lon AS s FROM (SELECT DISTINCT product, lon FROM f))
SELECT f.product, cast(any_value(used) AS string) AS newest, cast(any_value(used) AS string) AS used, cast(1 AS bigint) AS probes,
   date_diff('day', any_value(used), DATE '2002-01-01') AS lag_days,
   count(DISTINCT f.lat) AS n_lat, count(DISTINCT f.lon) AS n_lon, count(*) AS n_cells, count(value) AS n_ocean,
   count(*) - count(value) AS n_land,
   count(*) FILTER (lon BETWEEN -126.7 AND -126.4 AND lat BETWEEN 40.01 AND 40.35) AS region_cells,
   count(value) FILTER (lon BETWEEN -126.7 AND -126.4 AND lat BETWEEN 40.01 AND 40.35) AS region_ocean,
   round(min(value), 6) AS low, round(max(value), 6) AS high,
   round((SELECT median(s) FROM ax WHERE ax.product = f.product) * 110.57, 6) AS cell_km_lat,
   round((SELECT median(s) FROM ay WHERE ay.product = f.product) * 111.32
      * cos(radians((SELECT avg(lat) FROM ax WHERE ax.product = f.product))), 6) AS cell_km_lon
FROM f JOIN u ON u.product = f.product GROUP BY f.product""")
def _(v):
    return P.product_census(products(v), "2002-01-01", box=REGION)


@query("cell_readout", "A35 J7", "grid", SNAP_SQL + """
, s AS (SELECT point_id, g.value FROM snapped s JOIN grid g ON g.i = s.i AND g.j = s.j)
SELECT point_id, count(value) AS n_days, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high,
       CASE WHEN count(value) > 0 THEN 'water' ELSE 'land or masked' END AS status FROM s GROUP BY point_id""")
def _(v):
    lat, lon = edges(v)
    placed = P.resolve_cell(clicks(v), lat, lon).select("point_id", "i", "j")
    return P.cell_readout(P.cell_series(placed, v.grid))


@query("cell_series", "A35 J7", "grid", SNAP_SQL + """
SELECT point_id, g.i, g.j, cast(date AS string) AS date, round(value, 6) AS value FROM snapped s JOIN grid g ON g.i = s.i AND g.j = s.j""")
def _(v):
    lat, lon = edges(v)
    placed = P.resolve_cell(clicks(v), lat, lon).select("point_id", "i", "j")
    return P.cell_series(placed, v.grid)
