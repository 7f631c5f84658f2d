"""Catalogue queries: selection, missions, snapshot diff, ledger, tracks, feature sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import Box
from brinewave.functions import columns as C
from brinewave.operators import catalogue as K
from brinewave.operators import chunked
from brinewave.operators import monthly as M
from brinewave.operators import sequences as Q
from brinewave.plans.ingest import fresh_path
from brinewave.plans.registry import query
from brinewave.plans.resampling import PARTIAL_SQL, STATION_RULE, station_daily
from brinewave.plans.resampling import clim_sql
from brinewave.session import stored_table
from brinewave.sources import exchange, features, text_tables


@query("catalogue_by_search", "J1", "obs", """
, cat AS (SELECT deployment AS dataset_id, max(time) AS max_time FROM obs GROUP BY deployment)
, hits AS (SELECT deployment AS dataset_id FROM obs WHERE event_id % 10 <> 0 GROUP BY deployment
           HAVING min(event_id) % 4 <> 3)
SELECT dataset_id, max_time, split_part(dataset_id, '-', 2) AS glider FROM cat
WHERE dataset_id IN (SELECT dataset_id FROM hits) AND ends_with(dataset_id, '-delayed')""")
def _(v):
    cat = v.obs.groupBy(F.col("deployment").alias("dataset_id")).agg(F.max("time").alias("max_time"))
    hits = v.obs.where("event_id % 10 <> 0").groupBy(F.col("deployment").alias("dataset_id")).agg(
        F.min("event_id").alias("m")).withColumn("institution", F.when(F.col("m") % 4 != 3, "ours").otherwise("ours too"))
    return K.find_deployments(cat, hits, "delayed", "ours")


@query("group_assignment", "P14", "catalogue", """
SELECT name, CASE WHEN trim(project) = '1-URGENT' THEN 'urgent' WHEN trim(comment) = 'P' THEN 'pending'
  WHEN trim(project) = '5-LOW' THEN 'low' ELSE 'other' END AS "group" FROM catalogue""")
def _(v):
    groups = [("urgent", "project", "1-URGENT"), ("pending", "comment", "P"), ("low", "project", "5-LOW")]
    return K.assign_group(v.catalogue, groups, default="other").select("name", "group")


@query("missions_collapsed", "W8", "catalogue", """
SELECT name, glider, cast(start AS string) AS start, "end" FROM catalogue
QUALIFY row_number() OVER (PARTITION BY glider, start ORDER BY "end" DESC, name) = 1""")
def _(v):
    return K.collapse_missions(v.catalogue).select("name", "glider", "start", "end")


@query("missions_superseded", "W8", "catalogue", """
, o AS (SELECT *, row_number() OVER (PARTITION BY glider, start ORDER BY name) AS rn FROM catalogue)
, m AS (SELECT *, coalesce("end" > max("end") OVER (PARTITION BY glider, start ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS wins FROM o)
, s AS (SELECT *, CASE WHEN wins THEN (SELECT min_by(n.name, n.rn) FROM m n WHERE n.glider = m.glider AND n.start = m.start AND n.rn > m.rn AND n.wins)
     ELSE (SELECT max_by(p.name, p.rn) FROM m p WHERE p.glider = m.glider AND p.start = m.start AND p.rn < m.rn AND p.wins) END AS by_ FROM m)
SELECT name, glider, cast(start AS string) AS start, "end", concat('superseded by ', by_) AS skip FROM s WHERE by_ IS NOT NULL""")
def _(v):
    return K.superseded(v.catalogue)


@query("available_now", "P28 W8", "catalogue vertices", """
SELECT name, glider, "end" FROM (SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY glider, start ORDER BY "end" DESC, name) = 1)
WHERE "end" >= TIMESTAMP '2001-06-01' - INTERVAL 400 DAY AND name IN (SELECT name FROM vertices
  WHERE lon BETWEEN -126.80 AND -124.50 AND lat BETWEEN 47.85 AND 49.36)""")
def _(v):
    return K.available_now(v.catalogue, v.vertices, "2001-06-01", 400.0).select("name", "glider", "end")


@query("track_description", "A22", "vertices", """
, t AS (SELECT *, lon BETWEEN -126.80 AND -124.50 AND lat BETWEEN 47.85 AND 49.36 AS inside FROM vertices)
SELECT name, count(*) AS profiles_total, count(*) FILTER (inside) AS profiles_in_box,
  round(min(lon) FILTER (inside), 4) AS lon_min, round(max(lon) FILTER (inside), 4) AS lon_max,
  round(min(lat) FILTER (inside), 4) AS lat_min, round(max(lat) FILTER (inside), 4) AS lat_max FROM t GROUP BY name""")
def _(v):
    return K.describe_tracks(v.vertices)


SNAP_SQL = """
, prev AS (SELECT name AS deployment, CASE WHEN id % 3 = 0 THEN "end" - INTERVAL 5 DAY ELSE "end" END AS last_fix FROM catalogue WHERE id % 5 <> 0)
, cur AS (SELECT name AS deployment, "end" AS last_fix, id AS profiles_in_box FROM catalogue WHERE id % 7 <> 0)
, ledger AS (SELECT name AS deployment, '2000-01-01' AS first_seen, "end" - INTERVAL 9 DAY AS last_fix, -id AS profiles_in_box FROM catalogue WHERE id % 2 = 0)"""


def snapshots(v):
    c = v.catalogue.withColumnRenamed("name", "deployment")
    prev = c.where("id % 5 <> 0").select("deployment", F.when(
        F.col("id") % 3 == 0, F.col("end") - F.expr("interval 5 days")).otherwise(F.col("end")).alias("last_fix"))
    cur = c.where("id % 7 <> 0").select("deployment", F.col("end").alias("last_fix"), F.col("id").alias("profiles_in_box"))
    ledger = c.where("id % 2 = 0").select("deployment", F.lit("2000-01-01").alias("first_seen"),
                                          (F.col("end") - F.expr("interval 9 days")).alias("last_fix"),
                                          (-F.col("id")).alias("profiles_in_box"))
    return prev, cur, ledger


@query("snapshot_diff", "J16 G3 U6", "catalogue", SNAP_SQL + """
SELECT coalesce(p.deployment, c.deployment) AS deployment,
  CASE WHEN p.deployment IS NULL AND l.deployment IS NULL THEN 'new' WHEN p.deployment IS NULL THEN 'returned'
       WHEN c.deployment IS NULL THEN 'departed' ELSE 'advanced' END AS change
FROM prev p FULL JOIN cur c ON p.deployment = c.deployment LEFT JOIN ledger l ON l.deployment = coalesce(p.deployment, c.deployment)
WHERE p.deployment IS NULL OR c.deployment IS NULL OR p.last_fix <> c.last_fix""")
def _(v):
    return K.snapshot_diff(*snapshots(v))


@query("ledger_merged", "J17 U6", "catalogue", SNAP_SQL + """
SELECT coalesce(l.deployment, c.deployment) AS deployment, coalesce(first_seen, '2024-06-01') AS first_seen,
  coalesce(c.last_fix, l.last_fix) AS last_fix, coalesce(c.profiles_in_box, l.profiles_in_box) AS profiles_in_box
FROM ledger l FULL JOIN cur c ON l.deployment = c.deployment""")
def _(v):
    _, cur, ledger = snapshots(v)
    return K.merge_ledger(ledger, cur, "2024-06-01")


FILES_SQL = """
, files AS (SELECT name, concat(CASE WHEN k = 4 THEN 'stray' ELSE name END, s) AS file FROM catalogue
  CROSS JOIN (SELECT unnest(range(5)) AS k, unnest(['_grid.nc', '_grid_adjusted.nc', '_other.nc', '_delayed.nc', '_grid.nc']) AS s)
  WHERE (id + k) % 3 = 0 OR k = 3)"""


def listings(v):
    names = ["_grid.nc", "_grid_adjusted.nc", "_other.nc", "_delayed.nc", "_grid.nc"]
    rows = v.catalogue.select("name", "id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "s"))
    return rows.where(((F.col("id") + F.col("k")) % 3 == 0) | (F.col("k") == 3)).select(
        "name", F.concat(F.when(F.col("k") == 4, "stray").otherwise(F.col("name")), "s").alias("file"))


@query("candidate_files", "J18", "catalogue", FILES_SQL + """
, r AS (SELECT name, file, CASE WHEN file = concat(name, '_grid_adjusted.nc') THEN 0 WHEN file = concat(name, '_grid.nc') THEN 1
   WHEN starts_with(file, name) AND NOT contains(file, 'delayed') THEN 2 END AS rk FROM files)
SELECT c.name, (SELECT min_by(file, (rk, file)) FROM r WHERE r.name = c.name AND rk IS NOT NULL) AS file FROM catalogue c""")
def _(v):
    return K.resolve_candidates(v.catalogue, listings(v), ["_grid_adjusted.nc", "_grid.nc"])


@query("wanted_files", "J19", "catalogue", FILES_SQL + """
, m AS (SELECT name, max(file) FILTER (file = concat(name, '_grid_adjusted.nc')) AS file, string_agg(DISTINCT file, ', ' ORDER BY file) AS mine
   FROM files WHERE starts_with(file, name) GROUP BY name)
SELECT c.name, file, CASE WHEN file IS NULL THEN concat('no _grid_adjusted.nc (publishes: ', coalesce(mine, 'nothing'), ')') END AS skip
FROM catalogue c LEFT JOIN m USING (name)""")
def _(v):
    return K.match_wanted(v.catalogue, listings(v))


@query("mode_pairs", "J15", "obs", """
SELECT regexp_replace(deployment, '-delayed$', '') AS deployment, count(*) FILTER (NOT ends_with(deployment, '-delayed')) AS realtime,
  count(*) FILTER (ends_with(deployment, '-delayed')) AS delayed,
  round_even(count(*) FILTER (ends_with(deployment, '-delayed')) * 1.0 / count(*) FILTER (NOT ends_with(deployment, '-delayed')), 0) AS ratio
FROM obs GROUP BY 1 HAVING realtime > 0 AND delayed > 0""")
def _(v):
    return K.pair_modes(v.obs)


@query("modal_month", "A23", "vertices", """
, m AS (SELECT name, strftime(time, '%Y-%m') AS month, count(*) AS n, min(time) AS t FROM vertices GROUP BY 1, 2)
SELECT name, month AS observed_month FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, t) = 1""")
def _(v):
    return K.modal_month(v.vertices, key="name")


@query("track_statistics", "A24", "obs", """
, m AS (SELECT deployment, strftime(time, '%Y-%m') AS mo, count(*) AS n, min(time) AS a, max(time) AS b FROM obs GROUP BY 1, 2)
, p AS (SELECT deployment, sum(n) AS n, min(a) AS a, max(b) AS b, string_agg(mo, ',' ORDER BY mo) AS months,
   right(regexp_replace(deployment, '-delayed$', ''), 8) AS st FROM m GROUP BY deployment)
SELECT deployment, cast(n AS bigint) AS n_points, a AS first_profile, b AS last_profile,
  concat(st[1:4], '-', st[5:6], '-', st[7:8]) AS stamp, months,
  coalesce((SELECT string_agg(mo, ',' ORDER BY mo) FROM m WHERE m.deployment = p.deployment AND mo < concat(st[1:4], '-', st[5:6])), '') AS early_months
FROM p""")
def _(v):
    return K.track_statistics(v.obs)


@query("epoch_days", "A25", "obs", """
, d AS (SELECT DISTINCT deployment, cast(strptime(right(regexp_replace(deployment, '-delayed$', ''), 8), '%Y%m%d') AS date) AS st FROM obs)
SELECT deployment, date_diff('day', (SELECT min(st) FROM d), st) AS epoch_days, cast((SELECT min(st) FROM d) AS string) AS epoch_start,
  date_diff('day', (SELECT min(st) FROM d), (SELECT max(st) FROM d)) AS epoch_days_max FROM d""")
def _(v):
    tracks = v.obs.select("deployment").distinct().withColumn("stamp", C.stamp_of(C.base_id("deployment")))
    return K.epoch_days(tracks)


def take(path, kind="string"):
    return F.get_json_object("feature", path).cast(kind)


def vertex_check(made, *keys):
    """Pieces with the count and an order-bound sum of their vertices, read back from the JSON."""
    made = made.withColumn("_shape", F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>"))
    shape = F.col("_shape")
    weighed = F.aggregate(F.transform(shape, lambda p, i: (p[0] - 2 * p[1]) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select(*keys, F.size(shape).cast("bigint").alias("n_here"), F.round(weighed, 3).alias("weighed"))


@query("track_line_features", "S14", "vertices", """
, s AS (SELECT name, round(lon, 5) AS x, round(lat, 5) AS y, row_number() OVER (PARTITION BY name ORDER BY time, lon, lat) AS rn,
   count(*) OVER (PARTITION BY name) AS n FROM vertices WHERE lon BETWEEN -126.80 AND -124.50 AND lat BETWEEN 47.85 AND 49.36)
, p AS (SELECT *, unnest(CASE WHEN rn > 1 AND (rn - 1) % 2 = 0 AND rn = n THEN [(rn - 1) // 2 - 1]
   WHEN rn > 1 AND (rn - 1) % 2 = 0 THEN [(rn - 1) // 2 - 1, (rn - 1) // 2] ELSE [(rn - 1) // 2] END) AS piece FROM s WHERE n > 1)
SELECT name, piece, n AS n_points, count(*) AS n_here, round(sum((x - 2 * y) * (rn - piece * 2)), 3) AS weighed, 'LineString' AS kind
FROM p GROUP BY name, piece, n""")
def _(v):
    tracks = chunked.with_row_number(v.vertices, ["name"], ["time", "lon", "lat"], "seq")
    names = v.vertices.select("name").distinct().select("name", F.substring_index("name", "x", 1).alias("glider"),
                                                        F.lit("survey").alias("project"))
    made = features.track_lines(tracks, names, piece_points=3)
    return vertex_check(made, "name", "piece", "n_points", take("$.geometry.type").alias("kind"))


@query("profile_point_features", "S15", "obs", """
, s AS (SELECT deployment, time, round(longitude, 5) AS x, round(latitude, 5) AS y,
   row_number() OVER (PARTITION BY deployment ORDER BY time, longitude, latitude) - 1 AS rn FROM obs)
, t AS (SELECT deployment, count(*) AS n, strftime(min(time), '%Y-%m-%dT%H:%M') AS a, strftime(max(time), '%Y-%m-%dT%H:%M') AS b FROM obs GROUP BY deployment)
SELECT deployment, rn // 50 AS piece, any_value(n) AS n_points, any_value(a) AS first_profile, any_value(b) AS last_profile,
  strftime(min(time), '%Y-%m-%dT%H:%M') AS first_time, count(*) AS n_here, round(sum((x - 2 * y) * (rn % 50 + 1)), 3) AS weighed
FROM s JOIN t USING (deployment) GROUP BY deployment, rn // 50""")
def _(v):
    fixes = v.obs.select("deployment", "time", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    made = features.profile_points(fixes, piece_points=50)
    return vertex_check(made, "deployment", "piece", "n_points", "first_profile", "last_profile", take("$.properties.times[0]").alias("first_time"))


@query("empty_tracks", "S15", "obs", """
SELECT DISTINCT deployment FROM obs WHERE deployment NOT IN (SELECT deployment FROM obs
  WHERE longitude BETWEEN -126.80 AND -125.9 AND latitude BETWEEN 48.8 AND 49.1)""")
def _(v):
    fixes = v.obs.select("deployment", "time", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    inside = fixes.where(C.in_box("lon", "lat", Box(-126.80, -125.9, 48.8, 49.1)))
    return features.empty_tracks(fixes.select("deployment"), features.profile_points(inside))


SERIES_SQL = PARTIAL_SQL + """
, base AS (SELECT * FROM monthly WHERE NOT partial)""" + clim_sql("base") + """
, an AS (SELECT m.*, c.clim, value - c.clim AS anom FROM monthly m JOIN clim c ON c.site = m.site AND c.calendar_month = month(m.month))
, th AS (SELECT site, quantile_cont(anom, 0.9) AS p90 FROM an WHERE NOT partial GROUP BY site)"""


@query("point_series_features", "S17 S18 W18", "station", SERIES_SQL + """
, dl AS (SELECT site, count(*) AS n_daily FROM daily WHERE value IS NOT NULL GROUP BY site)
SELECT site, n_daily, (SELECT count(*) FROM an WHERE an.site = th.site) AS n_monthly, cast(12 AS bigint) AS n_clim, round(p90, 2) AS p90,
  (SELECT strftime(min(month), '%Y-%m') FROM an WHERE an.site = th.site) AS first_month FROM th JOIN dl USING (site)""")
def _(v):
    daily = station_daily(v)
    anom = M.series_anomalies(daily, rule=STATION_RULE)
    clim = M.climatology(anom.where(~F.col("partial")))
    nested = features.point_series(daily.where(F.col("value").isNotNull()), anom, clim, M.series_thresholds(anom))
    return nested.select("site", F.size("daily").alias("n_daily"), F.size("monthly").alias("n_monthly"),
                         F.size("climatology").alias("n_clim"), F.col("anomaly_thresholds.p90").alias("p90"),
                         F.element_at("monthly", 1)["month"].alias("first_month"))


@query("ordered_series", "S18", "mooring", """
, s AS (SELECT site, count(*) AS n, round(avg(value), 6) AS mean FROM mooring GROUP BY site)
SELECT 'here' AS place, string_agg(site, '>' ORDER BY CASE site WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS series_order,
  cast(sum(n) AS bigint) AS n FROM s""")
def _(v):
    stats = v.mooring.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    seq = F.when(F.col("site") == "R", 1).when(F.col("site") == "A", 2).otherwise(3)
    order = stats.select("site", F.lit("here").alias("place"), seq.alias("seq"))
    made = features.ordered_series(stats, order)
    return made.select("place", F.array_join(F.transform("series", lambda s: s["key"]), ">").alias("series_order"),
                       F.aggregate("series", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]).alias("n"))


@query("site_features", "S19", "sites", """
SELECT site, round(lon, 6) AS lon, round(lat, 6) AS lat, depth FROM sites
WHERE lon BETWEEN -126.0 AND -125.0 AND lat BETWEEN 48.0 AND 49.0""")
def _(v):
    made = features.site_features(v.sites, Box(-126.0, -125.0, 48.0, 49.0))
    return made.select("site", take("$.geometry.coordinates[0]", "double").alias("lon"),
                       take("$.geometry.coordinates[1]", "double").alias("lat"), take("$.properties.depth", "double").alias("depth"))


@query("platform_columns_resolved", "S8", "", """
SELECT round(((s_acctbal + 180) - 360 * floor((s_acctbal + 180) / 360)) - 180, 6) + 0.0 AS "Longitude", cast(s_nationkey AS double) AS "Latitude",
  cast(s_suppkey AS double) AS "Depth", round(s_acctbal, 6) AS "Balance" FROM supplier""")
def _(v):
    from brinewave.plans.views import table

    raw = table(v.spark, v.folder, "supplier").select(
        F.col("s_acctbal").alias("LNG"), F.col("s_nationkey").alias("Lat_Dec"), F.col("s_suppkey").alias("z"),
        F.col("s_acctbal").alias("balance"))
    return exchange.load_platform(raw, "Balance")


@query("bathymetry_normalised", "S9", "", """
SELECT round(-100 + p_partkey * 0.01, 6) AS lon, cast(p_size AS double) AS lat, -abs(p_retailprice) AS depth FROM part""")
def _(v):
    from brinewave.plans.views import table

    raw = table(v.spark, v.folder, "part").select(
        (F.lit(260.0) + F.col("p_partkey") * F.lit(0.01)).alias("Longitude"), F.col("p_size").alias("LAT"),
        F.col("p_retailprice").alias("Elevation"))
    return exchange.load_bathymetry(raw, positive_down=True)


@query("site_discovery", "S12", "", """
, f AS (SELECT o_custkey % 500 AS k, concat('/a/Folger_Ridge', o_custkey % 500, '_variables_x.', CASE WHEN o_orderkey % 3 = 0 THEN 'nc' ELSE 'csv' END) AS path,
   o_orderkey % 3 = 0 AS nc FROM orders)
SELECT concat('ridge', k) AS site, min_by(path, (CASE WHEN nc THEN 0 ELSE 1 END, path)) AS path,
  CASE WHEN bool_or(nc) THEN 'station_binary' ELSE 'station_text' END AS kind FROM f GROUP BY k""".replace(", f AS", "WITH f AS", 1))
def _(v):
    from brinewave.plans.views import table

    k = F.col("o_custkey") % 500
    ext = F.when(F.col("o_orderkey") % 3 == 0, "nc").otherwise("csv")
    files = table(v.spark, v.folder, "orders").select(
        F.concat(F.lit("/a/Folger_Ridge"), k, F.lit("_variables_x."), ext).alias("path"), F.lit("#HEADER").alias("first_line"))
    return exchange.discover_sites(files)


def by_bucket(rows, value, path: str, documents: int, keys=("deployment",)) -> None:
    """The rows as so many JSON documents, dealt by ``keys``, each a file of the one folder."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(max(1, documents)))).groupBy("bucket").agg(value.alias("value")).select(
        "value").write.option("maxRecordsPerFile", 1).text(path)


#: vertices that take about as much text as the properties of one feature
FEATURE_VERTICES = 10


def write_catalogue(vertices, path: str, piece_points: int = 1_000, features: int = 500) -> None:
    """Tracks of (name, time, lon, lat) as feature collections, each of the size of about ``features`` full pieces.

    A track is a LineString for each ``piece_points`` vertices, which gives the number of its
    first one, so neither a feature nor a document grows with a track. Documents are counted by
    what they hold, so that short tracks do not make many small files. Vertices without a time
    come last; those without a name are of no deployment.
    """
    time = F.coalesce(F.col("time").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("time")
    named = vertices.where("name is not null").select("name", time, "lon", "lat")
    rows = chunked.with_row_number(named, ["name"], ["time", "lon", "lat"], "row")
    first = (F.floor((F.col("row") - 1) / piece_points) * piece_points).alias("first_vertex")
    ordered = F.array_sort(F.collect_list(F.struct("row", F.round("lon", 2).alias("x"), F.round("lat", 2).alias("y"))))
    pieces = stored_table(rows.groupBy(F.col("name").alias("deployment"), first).agg(ordered.alias("p")), "track-pieces")
    number = F.split_part(F.split_part("deployment", F.lit("x"), F.lit(1)), F.lit("g"), F.lit(3))
    feature = F.struct(
        F.struct(F.col("deployment").alias("deployment_name"), F.lit("g").alias("glider_name"), number.alias("glider_serial"), "first_vertex").alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("coordinates")).alias("geometry"))
    held = pieces.agg(F.sum(F.size("p") + FEATURE_VERTICES).alias("n")).first()["n"] or 0
    by_bucket(pieces, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))), path,
              held // (features * piece_points), ("deployment", "first_vertex"))


@query("catalogue_read_back", "S6", "vertices", """
, v AS (SELECT name, round(lon, 2) AS lon, round(lat, 2) AS lat, row_number() OVER (PARTITION BY name ORDER BY time, lon, lat) AS p FROM vertices)
SELECT name, concat('g', split_part(split_part(name, 'x', 1), 'g', 3)) AS glider, concat('http://data/', regexp_replace(name, '-[^-]*$', ''), '/', name) AS url, count(*) AS n,
  round(sum((lon - 2 * lat) * p), 3) AS weighed FROM v GROUP BY name""")
def _(v):
    path = fresh_path(v, "collections")
    write_catalogue(v.vertices, path)
    deployments, vertices = exchange.read_catalogue(v.spark, path, "http://data")
    sums = vertices.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("lon") - 2 * F.col("lat")) * (F.col("seq") + 1)), 3).alias("weighed"))
    return deployments.select("name", "glider", "url").join(sums, "name")


@query("watch_from_manifest", "S11 U6 J16", "catalogue", SNAP_SQL + """
SELECT coalesce(p.deployment, c.deployment) AS deployment,
  CASE WHEN p.deployment IS NULL AND l.deployment IS NULL THEN 'new' WHEN p.deployment IS NULL THEN 'returned'
       WHEN c.deployment IS NULL THEN 'departed' ELSE 'advanced' END AS change
FROM prev p FULL JOIN cur c ON p.deployment = c.deployment LEFT JOIN ledger l ON l.deployment = coalesce(p.deployment, c.deployment)
WHERE p.deployment IS NULL OR c.deployment IS NULL OR p.last_fix <> c.last_fix""")
def _(v):
    prev, cur, ledger = snapshots(v)
    path = fresh_path(v, "manifest")
    stamp = F.date_format("last_fix", "yyyy-MM-dd'T'HH:mm:ss")
    # transects and seen entries of a deployment travel together
    both = prev.select("deployment", stamp.alias("fix")).join(
        ledger.select("deployment", F.struct("first_seen", stamp.alias("last_fix"), "profiles_in_box").alias("entry")), "deployment", "full")
    transects = F.collect_list(F.when(F.col("fix").isNotNull(), F.struct("deployment", F.col("fix").alias("last_fix"))))
    seen = F.map_from_entries(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("deployment", "entry"))))
    by_bucket(both, F.to_json(F.struct(F.lit(1).alias("schema"), transects.alias("transects"), seen.alias("seen"))), path, both.count() // 500)
    held = exchange.read_manifest(v.spark, path)
    was = held["transects"].select("deployment", F.to_timestamp("last_fix").alias("last_fix"))
    now = cur.withColumn("last_fix", F.col("last_fix").cast("timestamp"))
    return K.snapshot_diff(was, now, held["ledger"])


@query("table_read_back", "S20", "station", """
SELECT site, count(*) AS n, round(sum(round_even(value, 4)), 2) AS total, cast(cast(max(time) AS date) AS string) AS last_day FROM station GROUP BY site""")
def _(v):
    path = fresh_path(v, "table")
    text_tables.write_table(v.station, path)
    back = v.spark.read.option("header", True).schema("site string, time timestamp, value double, id bigint").csv(path)
    return back.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.to_date(F.max("time")).cast("string").alias("last_day"))


@query("sites_by_depth", "G6 G4", "sites", """
, s AS (SELECT site, CASE WHEN depth >= 50 THEN depth END AS depth FROM sites)
SELECT site, depth, row_number() OVER (ORDER BY depth NULLS FIRST, site) AS place, row_number() OVER (ORDER BY depth DESC NULLS LAST, site) AS from_below FROM s""")
def _(v):
    sites = v.sites.select("site", F.when(F.col("depth") >= 50, F.col("depth")).alias("depth"))
    return Q.depth_places(sites)
