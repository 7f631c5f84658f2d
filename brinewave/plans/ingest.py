"""Incremental ingest, upsert, change gate and text exchange, run against shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brinewave.functions import columns as C
from brinewave.operators import incremental as I
from brinewave.operators.profile import high_water_marks
from brinewave.plans.platforms import SCREENED
from brinewave.plans.registry import query
from brinewave.session import shared_folder
from brinewave.sources import archive, features, text_tables, versions

CUT = "2024-01-20"
FRESH_SQL = SCREENED + """
, pick AS (SELECT * FROM screened QUALIFY row_number() OVER (PARTITION BY deployment, time, depth ORDER BY latitude, longitude) = 1)
, first_run AS (SELECT * FROM pick WHERE time < TIMESTAMP '2024-01-20')
, marks AS (SELECT deployment, max(time) AS mark FROM first_run GROUP BY deployment)
, second_run AS (SELECT p.* FROM pick p LEFT JOIN marks m USING (deployment) WHERE mark IS NULL OR time > mark)"""


def fresh_path(v, name: str) -> str:
    """A new folder per run in the shared folder the session names."""
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def landed(v):
    return v.obs.drop("event_id")


@query("archive_update_idempotent", "U1 S2 A19 J14 Q4", "obs", FRESH_SQL + """
SELECT cast(1 AS bigint) AS run, (SELECT count(*) FROM first_run) AS appended, (SELECT count(*) FROM first_run) AS total
UNION ALL SELECT 2, (SELECT count(*) FROM second_run), (SELECT count(*) FROM first_run) + (SELECT count(*) FROM second_run)
UNION ALL SELECT 3, 0, (SELECT count(*) FROM first_run) + (SELECT count(*) FROM second_run)""")
def _(v):
    path = fresh_path(v, "archive")
    rows = landed(v)
    early = rows.where(F.col("time") < F.lit(CUT).cast("timestamp"))
    runs = [I.update_archive(v.spark, early, path, "realtime")]
    runs += [I.update_archive(v.spark, rows, path, "realtime") for _ in range(2)]
    return v.spark.createDataFrame([(n + 1, r["appended"], r["total"]) for n, r in enumerate(runs)],
                                   "run bigint, appended bigint, total bigint")


@query("archive_round_trip", "S1 S2 W6", "obs", FRESH_SQL + """
SELECT deployment, time, depth, round(temperature, 6) AS temperature FROM pick
WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-12'""")
def _(v):
    path = fresh_path(v, "archive")
    archive.append_archive(v.spark, path, I.fresh_rows(landed(v), None), "realtime")
    return archive.read_archive(v.spark, path, "realtime", "2024-01-10", "2024-01-12", variables=["temperature"]).select(
        "deployment", "time", "depth", "temperature")


@query("rows_after_marks", "J14 U2", "obs", """
, m AS (SELECT deployment, max(time) AS mark FROM obs WHERE time < TIMESTAMP '2024-01-20' GROUP BY deployment)
SELECT deployment, time, event_id FROM obs LEFT JOIN m USING (deployment) WHERE mark IS NULL OR time > mark - INTERVAL 1 DAY""")
def _(v):
    marks = high_water_marks(v.obs.where(F.col("time") < F.lit(CUT).cast("timestamp")))
    return I.after_marks(v.obs, marks, lateness_seconds=86_400).select("deployment", "time", "event_id")


UPSERT_SQL = """
, base AS (SELECT site, cast(time AS date) AS day, min(value) AS value FROM station WHERE id % 3 <> 0 GROUP BY 1, 2)
, new AS (SELECT site, cast(time AS date) AS day, max(value) + 1 AS value FROM station WHERE id % 3 <> 1 GROUP BY 1, 2)"""


def two_sources(v):
    day = F.to_date("time").alias("day")
    base = v.station.where("id % 3 <> 0").groupBy("site", day).agg(F.min("value").alias("value"))
    new = v.station.where("id % 3 <> 1").groupBy("site", day).agg((F.max("value") + 1).alias("value"))
    return base, new


@query("history_upsert", "J20 G2 S23 W7", "station", UPSERT_SQL + """
SELECT coalesce(b.site, n.site) AS site, cast(coalesce(b.day, n.day) AS string) AS day, round(coalesce(n.value, b.value), 6) AS value
FROM base b FULL JOIN new n ON b.site = n.site AND b.day = n.day""")
def _(v):
    return I.upsert(*two_sources(v), ["site", "day"])


@query("changed_rows", "U7", "station", UPSERT_SQL + """
, prev AS (SELECT site, day FROM base) , curr AS (SELECT site, day FROM new)
SELECT site, cast(day AS string) AS day, 'appeared' AS side FROM (SELECT * FROM curr EXCEPT SELECT * FROM prev)
UNION ALL SELECT site, cast(day AS string), 'vanished' FROM (SELECT * FROM prev EXCEPT SELECT * FROM curr)""")
def _(v):
    base, new = two_sources(v)
    return I.changed_rows(base, new, ignore=("value",))


@query("content_unchanged", "U7", "station", """
, p AS (SELECT id, time, value AS old, CASE WHEN id = (SELECT min(id) FROM station) THEN coalesce(value, 0) + 1 ELSE value END AS new FROM station)
SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, bool_and(old IS NOT DISTINCT FROM new) AS same FROM p GROUP BY 1""")
def _(v):
    altered = F.when(F.col("id") == v.station.select(F.min("id")).scalar(), F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value"))
    before = v.station.withColumn("updated", F.lit("a"))
    after = v.station.withColumn("value", altered).repartition(5).withColumn("updated", F.lit("b"))
    month = F.date_format("time", "yyyy-MM")
    one, two = (I.partition_hashes(x, month, "month") for x in (before, after))
    return I.compared_partitions(one, two, "month").select("month", "n", "same")


@query("mode_switch", "U8", "obs", """
SELECT deployment, count(*) AS n FROM obs WHERE NOT ends_with(deployment, '-delayed') GROUP BY deployment""")
def _(v):
    return I.by_mode(v.obs, "realtime").groupBy("deployment").agg(F.count(F.lit(1)).alias("n"))


@query("published_atomically", "S21 S22 S7", "grid", """
SELECT cast(date AS string) AS date, count(*) AS cells, count(value) AS filled,
  round(avg(round_even(value * 100, 0) / 100), 6) AS mean FROM grid GROUP BY date""")
def _(v):
    path = fresh_path(v, "grid")
    versions.publish_version(features.pack_grid(v.grid.where("j < 3")), path)
    versions.publish_version(features.pack_grid(v.grid), path)
    return features.unpack_grid(archive.read_grid(v.spark, path)).groupBy("date").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.avg("value").alias("mean"))


@query("preambled_station_files", "S3 S24 P16", "sensor", """
SELECT site, count(*) AS n_rows, count(value) AS n_valid, round(avg(value), 5) AS mean, 98.5 AS depth_m,
  cast(cast(min(time) AS date) AS string) AS record_start, cast(cast(max(time) AS date) AS string) AS record_end FROM sensor GROUP BY site""")
def _(v):
    path = fresh_path(v, "stations")
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    day = F.to_date("time").alias("day")
    data = v.sensor.select("site", day, F.concat_ws(", ", stamp, F.coalesce(F.col("value").cast("string"), F.lit("NaN")),
                                               F.col("flag").cast("string"), F.lit("1")).alias("line"))
    head = ["## preamble", "#STNNAME: \"Ridge\"  / station name", "#LATITUDE: 48.81  / degrees", "#LONGITUDE: -125.28  / degrees",
            "#DEPTH: 98.5m  / metres", "# prose: not a key", "## END HEADER"]
    # a file for each station and day, each with its header
    lines = v.sensor.select("site", day).distinct().select("site", "day", F.explode(F.array(*[F.lit(h) for h in head])).alias("line"))
    lines.unionByName(data).repartition("site", "day").write.partitionBy("site", "day").text(path)
    rows = text_tables.station_rows(v.spark, path).withColumn("site", F.regexp_extract("file", "site=([a-z]+)", 1))
    header = text_tables.station_header(v.spark, path, ["LATITUDE", "LONGITUDE", "DEPTH"])
    fields = text_tables.station_fields(header, rows).withColumn("site", F.regexp_extract("file", "site=([a-z]+)", 1))
    stats = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_valid"),
                                     F.bround(F.avg("value"), 5).alias("mean"))
    per_site = fields.groupBy("site").agg(F.max("depth_m").alias("depth_m"), F.min("record_start").alias("record_start"),
                                          F.max("record_end").alias("record_end"))
    return stats.join(per_site, "site")


@query("buoy_files", "S4 A29", "sensor", """
, r AS (SELECT site, date_trunc('minute', time) AS time, min_by(coalesce(value, 0), time) AS value FROM sensor GROUP BY 1, 2)
SELECT site, count(*) AS n, round(avg(value), 5) AS mean FROM r GROUP BY site""")
def _(v):
    path = fresh_path(v, "buoys")
    # a stamp, to the minute, is in one file only
    v.sensor.repartitionByRange("site", F.date_trunc("minute", "time")).sortWithinPartitions("site", "time").select(
        F.col("site").alias("STN_ID"), F.date_format("time", "MM/dd/yyyy HH:mm").alias("DATE"), F.lit(48.8).alias("LATITUDE"),
        F.lit(125.9).alias("LONGITUDE"), F.lit(73.0).alias("DEPTH"), F.lit(4).alias("Q_FLAG"),
        F.coalesce("value", F.lit(0.0)).alias("SeaWaterTemperature")).write.option("header", True).csv(path)
    return text_tables.buoy_rows(v.spark, path).groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("value"), 5).alias("mean"))


@query("commented_history", "S5 S23", "station", """
, d AS (SELECT cast(time AS date) AS day, avg(value) AS value FROM station GROUP BY 1)
SELECT count(*) AS n, cast(min(day) AS string) AS first_day, cast(max(day) AS string) AS last_day, round(avg(value), 5) AS mean,
  '48.825' AS cell_lat FROM d""")
def _(v):
    path = fresh_path(v, "history")
    series = v.station.groupBy(F.to_date("time").alias("day")).agg(F.avg("value").alias("value"))
    lines = v.spark.range(1).select(F.posexplode(F.array(
        F.lit("# Daily values of one cell"), F.lit("# cell_lat: 48.825"), F.lit("# cell_lon: -125.275"))).alias("line", "text"))
    text_tables.write_commented_series(series, lines, path, "sst_c")
    back = text_tables.commented_series(v.spark, path, "sst_c")
    header = text_tables.commented_header(v.spark, path).where("key = 'cell_lat'")
    return back.agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                    F.bround(F.avg("value"), 5).alias("mean")).withColumn("cell_lat", header.select("value").scalar())


@query("steps_retired", "U5 S7", "grid", """
SELECT cast(date AS string) AS date, count(*) AS cells, count(value) AS filled FROM grid
WHERE date IN (SELECT DISTINCT date FROM grid ORDER BY date DESC LIMIT 4) GROUP BY date""")
def _(v):
    path = fresh_path(v, "layer")
    features.publish(v.grid, path, "date")
    archive.retire_steps(v.spark, path, 4)
    return v.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"))
