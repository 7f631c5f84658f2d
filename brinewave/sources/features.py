"""Feature sinks: rows to GeoJSON features, and all-or-nothing publication.

Every feature is one row of JSON text. A track is a sequence of pieces of a set number of
vertices, whatever its length, so a row stays bounded and no size changes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import STUDY_BOX, Box
from brinewave.functions import columns as C
from brinewave.functions import geometry as G
from brinewave.operators import chunked


#: vertices of one piece of a track
PIECE_POINTS = 10_000


def _pieces(points: DataFrame, key: str, order: list[str], size: int, shared: bool, seconds: int | None = None) -> DataFrame:
    """Points with ``row``, ``piece`` and the ``total`` of their key; with ``shared`` a piece begins with the end of the one before."""
    if chunked.keys_fit(points, [key]):
        rows = chunked.running_sum_whole(points.where(F.col(key).isNotNull()), [key], order, F.lit(1).cast("long"), "row")
        rows = rows.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(key)))
    else:
        counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
        rows = chunked.with_row_number(points, [key], order, "row", seconds).join(counts, key)
    step = size - 1 if shared else size
    piece = F.floor((F.col("row") - 1) / step)
    if not shared:
        return rows.withColumn("piece", piece)
    seam = ((F.col("row") - 1) % step == 0) & (F.col("row") > 1)
    both = F.when(seam & (F.col("row") == F.col("total")), F.array(piece - 1)).when(seam, F.array(piece - 1, piece)).otherwise(F.array(piece))
    return rows.withColumn("piece", F.explode(both))


def track_lines(vertices: DataFrame, deployments: DataFrame, box: Box | None = STUDY_BOX, places: int = 5,
                properties=("glider", "project"), piece_points: int = PIECE_POINTS, position: str = "seq") -> DataFrame:
    """(name, piece, n_points, feature): the LineString pieces of each deployment's track.

    Only vertices in the box count, in the order of ``position``. A track of fewer than two
    of them is no line. Every track is a row per ``piece_points`` vertices; neighbouring
    pieces share an end, and each carries the number of points of the whole track, so the
    size of a piece never changes what the track is.
    """
    inside = vertices if box is None else vertices.where(C.in_box("lon", "lat", box))
    stamped = inside.withColumn("_at", F.timestamp_micros(F.col(position).cast("bigint")))
    cut = _pieces(stamped, "name", ["_at", "lon", "lat"], piece_points, True, 1).where("total > 1")
    lines = cut.groupBy("name", "piece", F.col("total").alias("n_points")).agg(F.array_sort(F.collect_list(F.struct(
        "row", C.tidy_round("lon", places).alias("x"), C.tidy_round("lat", places).alias("y")))).alias("_p"))
    lines = lines.withColumn("coordinates", F.transform("_p", lambda p: F.array(p["x"], p["y"])))
    return lines.join(deployments, "name").select("name", "piece", "n_points", F.to_json(G.feature(
        "LineString", F.col("coordinates"), F.struct("name", *properties, "n_points", "piece"))).alias("feature"))


def profile_points(fixes: DataFrame, places: int = 5, key: str = "deployment", piece_points: int = PIECE_POINTS) -> DataFrame:
    """(key, piece, n_points, first_profile, last_profile, feature): MultiPoint pieces with parallel times.

    One timestamp per coordinate in the same order, both from one ordered array. A
    deployment is a row per ``piece_points`` fixes, in time order; count, first and last
    profile are those of the whole deployment on each piece.
    """
    held = fixes.where(C.clean("lon").isNotNull() & C.clean("lat").isNotNull())
    stamp = "yyyy-MM-dd'T'HH:mm"
    spans = held.groupBy(key).agg(F.date_format(F.min("time"), stamp).alias("first_profile"), F.date_format(F.max("time"), stamp).alias("last_profile"))
    rows = _pieces(held, key, ["time", "lon", "lat"], piece_points, False).groupBy(key, "piece", F.col("total").alias("n_points")).agg(
        F.array_sort(F.collect_list(F.struct("row", "time", C.tidy_round("lon", places).alias("x"), C.tidy_round("lat", places).alias("y")))).alias("_p"))
    shaped = rows.join(spans, key).select(
        key, "piece", "n_points", "first_profile", "last_profile", F.transform("_p", lambda p: F.date_format(p["time"], stamp)).alias("times"),
        F.transform("_p", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return shaped.select(
        key, "piece", "n_points", "first_profile", "last_profile",
        F.to_json(G.feature("MultiPoint", F.col("coordinates"), F.struct(
            F.col(key), C.glider_of(key).alias("glider"), "n_points", "piece", "times"))).alias("feature"))


def empty_tracks(names: DataFrame, features: DataFrame, key: str = "deployment") -> DataFrame:
    """Deployments that made no feature: reported, not emitted."""
    return names.select(key).distinct().join(features.select(key), key, "left_anti")


def grid_features(polygons: DataFrame, clipped: bool) -> DataFrame:
    """(date, i, j, feature) per (date, cell), each tagged with its date."""
    props = F.struct(F.col("value").alias("sst"), "lat", "lon", "flagged", F.col("date").cast("string").alias("date"))
    if clipped:
        shape = G.feature("MultiPolygon", F.col("parts"), props)
    else:
        shape = G.feature("Polygon", F.array("ring"), props)
    return polygons.select("date", "i", "j", F.to_json(shape).alias("feature"))


def layer_metadata(polygons: DataFrame, **extra) -> DataFrame:
    """One row about the layer: its dates, the default (newest) date, and captions."""
    dates = polygons.select("date").distinct()
    return dates.agg(
        F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ",").alias("dates"),
        F.max("date").cast("string").alias("default_date")).withColumns({k: F.lit(v) for k, v in extra.items()})


def point_series(daily: DataFrame, monthly: DataFrame, clim: DataFrame, thr: DataFrame,
                 key: str = "site") -> DataFrame:
    """(key, daily, monthly, climatology, anomaly_thresholds) with nested, ordered arrays.

    Values are rounded to two places, nulls stay. The arrays hold days and months of one
    record (thinned before), bounded by calendar time.
    """
    d = daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("day").cast("string").alias("date"), C.tidy_round("value", 2).alias("value")))).alias("daily"))
    m = monthly.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.date_format("month", "yyyy-MM").alias("month"), C.tidy_round("value", 2).alias("mean"), F.col("n").alias("n"),
        F.col("ok").alias("ok"), C.tidy_round("clim", 2).alias("clim"), C.tidy_round("anom", 2).alias("anom"),
        F.col("partial").alias("partial")))).alias("monthly"))
    c = clim.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "calendar_month", C.tidy_round("clim", 2).alias("clim"), C.tidy_round("std", 2).alias("std"),
        F.coalesce("n_years", F.lit(0)).alias("n_years")))).alias("climatology"))
    levels = [n for n in thr.columns if n != key]
    t = thr.select(key, F.struct(*[C.tidy_round(n, 2).alias(n) for n in levels]).alias("anomaly_thresholds"))
    return d.join(m, key).join(c, key).join(t, key)


def ordered_series(points: DataFrame, order: DataFrame, key: str = "site", group: str = "place") -> DataFrame:
    """One feature row per place with its series as an ordered list; the order is data.

    ``order`` has (group, key, seq); a place has a handful of series.
    """
    rest = [c for c in points.columns if c != key]
    return points.join(order, key).groupBy(group).agg(F.array_sort(F.collect_list(
        F.struct("seq", F.col(key).alias("key"), *rest))).alias("series"))


def site_features(sites: DataFrame, box: Box = STUDY_BOX, places: int = 6, key: str = "site") -> DataFrame:
    """(key, feature) points inside the box; instrument and water depth stay separate."""
    rest = [c for c in sites.columns if c not in (key, "lon", "lat")]
    rounded = sites.withColumn("lon", C.tidy_round("lon", places)).withColumn("lat", C.tidy_round("lat", places))
    return rounded.where(C.in_box("lon", "lat", box)).select(key, F.to_json(G.feature(
        "Point", F.array("lon", "lat"), F.struct(key, *rest))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features, the form parallel readers and writers can share."""
    features.select("feature").write.mode("overwrite").text(path)


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """All-or-nothing replacement of an output.

    Without a partition the rows go to a staging folder that is renamed into place when
    complete; with one, only the partitions in ``df`` are replaced by the job committer.
    """
    spark = df.sparkSession
    if partition:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    staging = path.rstrip("/") + "_staging"
    retired = path.rstrip("/") + "_previous"
    df.write.mode("overwrite").parquet(staging)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(retired)):
        fs.delete(hadoop(retired), True)
    if fs.exists(target) and not fs.rename(target, hadoop(retired)):
        raise OSError(f"could not retire {path}")
    if not fs.rename(hadoop(staging), target):
        fs.rename(hadoop(retired), target)
        raise OSError(f"could not publish {path}")


def pack_grid(grid: DataFrame) -> DataFrame:
    """Grid with values as hundredths in a SMALLINT, null as the fill value."""
    return grid.withColumn("value", C.pack_hundredths("value"))


def unpack_grid(grid: DataFrame) -> DataFrame:
    return grid.withColumn("value", C.unpack_hundredths("value"))
