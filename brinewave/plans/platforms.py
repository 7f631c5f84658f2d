"""Queries over moving platforms: scans, screens, identifiers, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.config import SCIENCE, SITE_PREFIXES
from brinewave.functions import columns as C
from brinewave.operators import profile, screening, sequences, spatial
from brinewave.operators import grid as R
from brinewave.plans.registry import query
from brinewave.sources import archive

RANGED = {
    "temperature": "-2 AND 30", "salinity": "2 AND 42", "density": "1000 AND 1040",
    "oxygen_concentration": "0 AND 600", "chlorophyll": "-2 AND 60",
    "backscatter_700": "-0.001 AND 0.05", "cdom": "-5 AND 100",
}
BLANKED = ", ".join(f"CASE WHEN {n} BETWEEN {r} THEN {n} END AS {n}" for n, r in RANGED.items())
SCREENED = f"""
, blanked AS (SELECT deployment, glider, time, latitude, longitude,
   CASE WHEN depth BETWEEN -1 AND 1200 THEN depth END AS depth, {BLANKED}, event_id FROM obs)
, screened AS (SELECT * FROM blanked WHERE coalesce({', '.join(RANGED)}) IS NOT NULL)"""
ROUNDED = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in RANGED)
PLACE = "round(latitude, 6) AS latitude, round(longitude, 6) AS longitude"


@query("archive_window", "S1 U8", "obs", f"""
SELECT deployment, split_part(deployment, '-', 2) AS glider, time, {PLACE}, depth,
       round(temperature, 6) AS temperature, salinity
FROM obs WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20'""")
def _(v):
    frame = archive.window(v.obs, start="2024-01-10", end="2024-01-20")
    frame = frame.withColumn("glider", C.glider_of("deployment"))
    return archive.select_variables(frame, ["temperature", "salinity"])


@query("study_box", "P1", "obs", f"""
SELECT deployment, time, {PLACE} FROM obs
WHERE longitude BETWEEN -126.80 AND -124.50 AND latitude BETWEEN 47.85 AND 49.36""")
def _(v):
    return spatial.clip_to_box(v.obs).select("deployment", "time", "latitude", "longitude")


@query("gross_range_screen", "P2", "obs", SCREENED + f"""
SELECT deployment, time, depth, {ROUNDED} FROM screened""")
def _(v):
    return screening.gross_range(v.obs).select("deployment", "time", "depth", *RANGED)


@query("range_tally", "P3", "obs", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, count({n}) AS present, count(*) FILTER ({n} NOT BETWEEN {r}) AS flagged FROM obs"
    for n, r in {**RANGED, "depth": "-1 AND 1200"}.items()))
def _(v):
    return screening.range_tally(v.obs)


@query("good_flags", "P4", "sensor", """
SELECT site, time, round(value, 6) AS value, cast(flag AS bigint) AS flag FROM sensor
WHERE flag IN (1, 2, 7) AND value IS NOT NULL""")
def _(v):
    return screening.keep_good(v.sensor, "flag", "value", (1, 2, 7)).select("site", "time", "value", "flag")


_ORDER = ["temperature", "salinity", "density", "chlorophyll", "backscatter_700", "cdom", "oxygen_concentration"]


def _copy_sql() -> str:
    """Precedence cascade as nested expressions, one level per channel."""
    pairs = []
    for i, a in enumerate(_ORDER):
        for b in _ORDER[i + 1:]:
            pairs.append(f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= 10 AND "
                         f"count(*) FILTER ({a} <> {b}) = 0 AS {a}__{b}")
    steps = [f", p AS (SELECT deployment, {', '.join(pairs)} FROM obs GROUP BY deployment)"]
    prior = "p"
    for i, s in enumerate(_ORDER):
        accused = " OR ".join(f"(NOT c_{t} AND {t}__{s})" for t in _ORDER[:i]) or "false"
        steps.append(f", k{i} AS (SELECT *, {accused} AS c_{s} FROM {prior})")
        prior = f"k{i}"
    blank = ", ".join(f"round(CASE WHEN NOT c_{n} THEN {n} END, 6) + 0.0 AS {n}" for n in _ORDER)
    return " ".join(steps) + f" SELECT deployment, time, {blank} FROM obs JOIN {prior} USING (deployment)"


@query("copied_channels_blanked", "P5", "obs", _copy_sql())
def _(v):
    return screening.blank_copied_channels(v.obs).select("deployment", "time", *_ORDER)


@query("absent_sensor_and_coercion", "P6 P7", "obs", """
, t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN 'bad'
   ELSE cast(temperature AS string) END AS txt FROM obs)
SELECT event_id, round(CASE WHEN NOT isnan(try_cast(txt AS double)) THEN try_cast(txt AS double) END, 6) AS temperature,
       cast(NULL AS double) AS cdom FROM t""")
def _(v):
    text = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 7 == 0, "bad").otherwise(
        F.col("temperature").cast("string"))
    raw = v.obs.select("event_id", text.alias("temperature"))
    return screening.fill_absent(screening.coerce_numbers(raw, ["temperature"]), ["cdom"])


@query("longitude_conventions", "P8 P9 P10", "obs", """
, m AS (SELECT event_id, longitude AS lon, (longitude + 360) - 360 * floor((longitude + 360) / 360) AS lon360 FROM obs)
SELECT event_id, round(lon360, 6) AS lon_360,
       round((lon360 + 180) - 360 * floor((lon360 + 180) / 360) - 180, 6) AS lon_180,
       round(-abs(-lon), 6) AS west FROM m""")
def _(v):
    wide = v.obs.select("event_id", "longitude", C.lon_360("longitude").alias("lon_360"))
    return wide.select("event_id", "lon_360", C.lon_180("lon_360").alias("lon_180"),
                       C.west_positive(-F.col("longitude")).alias("west"))


@query("depth_conventions", "P11 P12 P24", "obs", """
SELECT event_id, round(-abs(coalesce(depth, salinity * 1.0197)), 6) + 0.0 AS z,
       round(coalesce(depth, salinity * 1.0197), 6) AS depth, nullif(salinity, 0.0) AS masked FROM obs""")
def _(v):
    depth = C.depth_or_pressure("depth", "salinity")
    return v.obs.select("event_id", C.depth_down_negative(depth).alias("z"), depth.alias("depth"),
                        C.zero_as_null("salinity").alias("masked"))


@query("required_fields", "P13", "obs", """
SELECT deployment, time, depth, round(temperature, 6) AS temperature FROM obs
WHERE depth IS NOT NULL AND temperature IS NOT NULL""")
def _(v):
    return screening.require(v.obs, ["depth", "temperature"]).select("deployment", "time", "depth", "temperature")


@query("identifiers", "P15", "obs", """
SELECT DISTINCT deployment, split_part(deployment, '-', 2) AS glider, ends_with(deployment, '-delayed') AS delayed,
       regexp_replace(deployment, '-delayed$', '') AS base,
       strftime(strptime(right(regexp_replace(deployment, '-delayed$', ''), 8), '%Y%m%d'), '%Y-%m-%d') AS stamp,
       rtrim(split_part(deployment, '-', 2), '0123456789') AS short_name FROM obs""")
def _(v):
    names = v.obs.select("deployment").distinct()
    return names.select(
        "deployment", C.glider_of("deployment").alias("glider"), C.is_delayed("deployment").alias("delayed"),
        C.base_id("deployment").alias("base"), C.stamp_of(C.base_id("deployment")).alias("stamp"),
        C.short_name(C.glider_of("deployment")).alias("short_name"))


@query("text_helpers", "P16", "", """
SELECT s_suppkey AS id, try_cast(regexp_extract(concat('depth ', s_acctbal, 'm'), '-?[0-9]+(\\.[0-9]+)?', 0) AS double) AS number,
       trim(regexp_replace(concat('FolgerRidge', s_name), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS spaced,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('ridge', s_suppkey) ELSE concat('site', s_suppkey) END AS key
FROM supplier""")
def _(v):
    from brinewave.plans.views import table

    s = table(v.spark, v.folder, "supplier")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Folger-Passage Ridge "), F.col("s_suppkey"))).otherwise(
        F.concat(F.lit("SITE_"), F.col("s_suppkey")))
    return s.select(
        F.col("s_suppkey").alias("id"),
        C.first_number(F.concat(F.lit("depth "), F.col("s_acctbal").cast("string"), F.lit("m"))).alias("number"),
        C.spaced_words(F.concat(F.lit("FolgerRidge"), F.col("s_name"))).alias("spaced"),
        C.site_key(raw, SITE_PREFIXES).alias("key"))


@query("display_labels", "P21 P23", "obs", """
SELECT event_id, strftime(time - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') AS local_time,
       printf('%.4f°%s, %.4f°%s', abs(latitude), CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END,
              abs(longitude), CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END) AS position,
       round_even(temperature, 3) AS temperature FROM obs""")
def _(v):
    return v.obs.select("event_id", C.local_label("time").alias("local_time"),
                        C.position_label("latitude", "longitude").alias("position"),
                        C.tidy_round("temperature", 3).alias("temperature"))


@query("unit_conversions", "P25", "obs", """
SELECT event_id, round(temperature + 273.15 - 273.15, 6) + 0.0 AS celsius, coalesce(oxygen_concentration < 2 / 1.43, false) AS hypoxic FROM obs""")
def _(v):
    return v.obs.select("event_id", C.kelvin_to_celsius(F.col("temperature") + 273.15).alias("celsius"),
                        F.coalesce(C.hypoxic("oxygen_concentration"), F.lit(False)).alias("hypoxic"))


HELD_SQL = """
, f AS (SELECT DISTINCT deployment, time, round(longitude, 6) AS x, round(latitude, 6) AS y FROM obs)
, m AS (SELECT *, coalesce(lag(x) OVER w = x AND lag(y) OVER w = y, false) AS same FROM f
        WINDOW w AS (PARTITION BY deployment ORDER BY time, x, y))
, g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY deployment ORDER BY time, x, y
        ROWS UNBOUNDED PRECEDING) AS run FROM m)
, held AS (SELECT deployment, x, y, min(time) AS held_from, max(time) AS held_to FROM g
        GROUP BY deployment, run, x, y HAVING epoch_us(max(time)) - epoch_us(min(time)) >= 28800000000)"""
MOVING_SQL = HELD_SQL + """
, moving AS (SELECT o.* FROM obs o WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.deployment = o.deployment
   AND h.x = round(o.longitude, 6) AND h.y = round(o.latitude, 6) AND o.time BETWEEN h.held_from AND h.held_to))"""


@query("held_position_runs", "W4", "obs", HELD_SQL + """
SELECT deployment, x AS longitude, y AS latitude, held_from, held_to FROM held""")
def _(v):
    return screening.held_runs(v.obs)


@query("held_positions_masked", "W4", "obs", MOVING_SQL + """
SELECT deployment, time, event_id FROM moving""")
def _(v):
    return screening.mask_held_positions(v.obs).select("deployment", "time", "event_id")


@query("active_platforms", "W14 W21 P28", "obs", MOVING_SQL + """
, r AS (SELECT * FROM moving WHERE time >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY
        AND depth IS NOT NULL AND temperature IS NOT NULL)
, n AS (SELECT *, count(*) OVER (PARTITION BY deployment) AS c FROM r)
SELECT deployment, time, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, depth,
       round(temperature, 6) AS temperature FROM n WHERE c >= 2""")
def _(v):
    from brinewave.config import Recency

    return sequences.active_platforms(v.obs, "2024-01-30", "temperature", Recency(active_days=10.0)).select(
        "deployment", "time", "longitude", "latitude", "depth", "temperature")


@query("live_view", "P1 P2 P5 W4 W14 W21", None or "obs", _copy_sql().rsplit(" SELECT deployment", 1)[0] + """
, un AS (SELECT deployment, time, latitude, longitude, CASE WHEN depth BETWEEN -1 AND 1200 THEN depth END AS depth, """
       + ", ".join(f"CASE WHEN NOT c_{n} AND {n} BETWEEN {r} THEN {n} END AS {n}" for n, r in RANGED.items())
       + """ FROM obs JOIN k6 USING (deployment)
        WHERE longitude BETWEEN -126.80 AND -124.50 AND latitude BETWEEN 47.85 AND 49.36)
, sc AS (SELECT * FROM un WHERE coalesce(""" + ", ".join(RANGED) + """) IS NOT NULL)
""" + HELD_SQL.replace("FROM obs", "FROM sc") + """
, mv AS (SELECT o.* FROM sc o WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.deployment = o.deployment
   AND h.x = round(o.longitude, 6) AND h.y = round(o.latitude, 6) AND o.time BETWEEN h.held_from AND h.held_to))
, rr AS (SELECT *, count(*) OVER (PARTITION BY deployment) AS c FROM mv WHERE time >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY
   AND depth IS NOT NULL AND temperature IS NOT NULL)
SELECT deployment, time, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, depth,
       round(temperature, 6) AS temperature, round(oxygen_concentration, 6) AS oxygen_concentration FROM rr WHERE c >= 2""")
def _(v):
    from brinewave.config import Recency

    clean = screening.gross_range(spatial.clip_to_box(screening.blank_copied_channels(v.obs)))
    return sequences.active_platforms(clean, "2024-01-30", "temperature", Recency(active_days=14.0)).select(
        "deployment", "time", "longitude", "latitude", "depth", "temperature", "oxygen_concentration")


@query("high_water_marks", "A19", "obs", """
SELECT deployment, max(time) AS mark, strftime(max(time), '%Y-%m-%dT%H:%M:%SZ') AS mark_text FROM obs GROUP BY deployment""")
def _(v):
    return profile.high_water_marks(v.obs)


@query("variable_coverage", "A20", "obs", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, round(count({n}) * 100.0 / count(*), 6) AS pct FROM obs" for n in SCIENCE))
def _(v):
    return profile.coverage(v.obs)


@query("coverage_by_deployment", "A20", "obs", ", c AS (" + " UNION ALL ".join(
    f"SELECT deployment, '{n}' AS variable, count({n}) * 100.0 / count(*) AS pct FROM obs GROUP BY deployment" for n in SCIENCE) + """)
SELECT deployment, variable, round(pct, 6) AS pct, row_number() OVER (PARTITION BY deployment ORDER BY pct DESC, variable) AS place FROM c""")
def _(v):
    return profile.coverage_by(v.obs)


@query("deployments_united", "G1", "obs", """
SELECT deployment, count(*) AS observations, count(temperature) AS temperatures, count(CASE WHEN glider NOT IN ('g1', 'g4') THEN oxygen_concentration END) AS oxygens,
  count(CASE WHEN glider <> 'g2' THEN cdom END) AS cdoms FROM obs GROUP BY deployment""")
def _(v):
    lacking = {"g1": ["oxygen_concentration"], "g4": ["oxygen_concentration"], "g2": ["cdom"]}
    # a fleet has a handful of gliders; each frame has the columns its glider carries
    gliders = [r["glider"] for r in v.obs.select("glider").distinct().orderBy("glider").collect()]
    frames = [v.obs.where(F.col("glider") == g).drop(*lacking.get(g, [])) for g in gliders]
    return sequences.united(frames).groupBy("deployment").agg(
        F.count(F.lit(1)).alias("observations"), F.count("temperature").alias("temperatures"),
        F.count("oxygen_concentration").alias("oxygens"), F.count("cdom").alias("cdoms"))


@query("deployment_summary", "A20", "obs", """
SELECT deployment, count(*) AS observations, min(time) AS first_time, max(time) AS last_time, max(depth) AS max_depth
FROM obs GROUP BY deployment""")
def _(v):
    return profile.deployment_summary(v.obs)


@query("time_coverage", "A21", "obs", "SELECT min(time) AS coverage_start, max(time) AS coverage_end FROM obs")
def _(v):
    return profile.time_coverage(v.obs)


@query("clamp_limits", "A30", "obs", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, round(quantile_cont({n}, 0.02), 6) AS low, round(quantile_cont({n}, 0.98), 6) AS high FROM obs"
    for n in ("temperature", "salinity", "chlorophyll")))
def _(v):
    return profile.clamp_limits(v.obs, ["temperature", "salinity", "chlorophyll"])


@query("product_truth", "P27", "obs", """
, n AS (SELECT deployment, count(CASE WHEN deployment LIKE '%1-%' THEN NULL ELSE oxygen_concentration END) AS finite
  FROM obs GROUP BY deployment)
SELECT deployment, finite, finite > 0 AS accepted,
       CASE WHEN finite > 0 THEN concat(finite, ' finite temperature_adjusted points')
            ELSE 'temperature_adjusted present but entirely NaN' END AS reason FROM n""")
def _(v):
    adjusted = F.when(~F.col("deployment").like("%1-%"), F.col("oxygen_concentration"))
    profiles = v.obs.withColumn("temperature_adjusted", adjusted)
    return screening.product_truth(profiles, v.obs.select("deployment").distinct())


@query("depth_section", "R4", "obs", """
SELECT deployment, time, -abs(depth) + 0.0 AS z, round(temperature, 6) AS value FROM obs
WHERE depth IS NOT NULL AND temperature IS NOT NULL""")
def _(v):
    return R.depth_section(v.obs, "temperature")


@query("vertical_profile", "R5", "obs", """
SELECT deployment, abs(depth) AS depth, salinity AS value FROM obs
WHERE depth IS NOT NULL AND salinity IS NOT NULL ORDER BY deployment, depth""")
def _(v):
    return R.vertical_profile(v.obs, "salinity")
