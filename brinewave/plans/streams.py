"""Streaming queries: the given events as a stream, drained and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.functions import columns as C
from brinewave.plans.ingest import FRESH_SQL, fresh_path
from brinewave.plans.platforms import HELD_SQL
from brinewave.plans.registry import query
from brinewave.plans.views import VIEWS, _spark_text
from brinewave.session import is_folder, prepare
from brinewave.streaming import feeds


def lateness(v, name: str, unit: str = "microsecond") -> str:
    """The span of the input's times, cut to ``unit``: whatever the order of its parts, no row is later."""
    return feeds.span_of(getattr(v, name).select(F.date_trunc(unit, "time").alias("time")))


def event_stream(v, name: str):
    """A view over ``events``, a file or a folder of parts, read as a file stream."""
    prepare(v.spark)
    path = f"{v.folder}/events.parquet"
    schema = v.spark.read.parquet(path).schema
    reader = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    raw = reader.parquet(path) if is_folder(v.spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(v.folder)
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    text = _spark_text(VIEWS[name][1]).replace("FROM events", "FROM {events}")
    return v.spark.sql(text, events=raw)


def drain(v, writer) -> None:
    """Run to the end of the input; rows refused as too late are an error here, as the lateness covers the feed."""
    with feeds.LateRows(v.spark) as late:
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
        refused = late.of(running)
    if refused:
        raise ValueError(f"{refused} rows came later than the feed's lateness allows")


def to_table(v, stream, name: str):
    """Run an append-mode stream into a parquet table and read it back."""
    path = fresh_path(v, name)
    drain(v, stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", path + "_progress"))
    return v.spark.read.schema(stream.schema).parquet(path)


def last_rows(v, stream, keys, name: str):
    """Run an update-mode stream and keep, for each key, the row of its last batch."""
    path = fresh_path(v, name)

    def keep(batch, batch_id):
        if not batch.isEmpty():
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    drain(v, stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", path + "_progress"))
    rest = [c for c in stream.columns if c not in keys]
    rows = v.spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


@query("stream_ingest", "U1 U2", "obs", FRESH_SQL + """
SELECT deployment, count(*) AS n, max(time) AS newest FROM pick GROUP BY deployment""")
def _(v):
    path = fresh_path(v, "feed")
    drain(v, feeds.ingest_stream(event_stream(v, "obs").drop("event_id"), path, path + "_progress", "realtime"))
    return v.spark.read.parquet(path).groupBy("deployment").agg(
        F.count(F.lit(1)).alias("n"), F.max("time").alias("newest"))


@query("stream_duplicates_suppressed", "U3", "sensor", """
SELECT DISTINCT site, date_trunc('hour', time) AS time FROM sensor""")
def _(v):
    hourly = event_stream(v, "sensor").select("site", F.date_trunc("hour", "time").alias("time"))
    return to_table(v, feeds.distinct_times(hourly, ["site"], lateness(v, "sensor", "hour")), "distinct")


@query("stream_latest_values", "U4", "sensor", """
SELECT site, max(time) AS latest_time, arg_max(id, time) AS id, cast(arg_max(flag, time) AS bigint) AS flag FROM sensor GROUP BY site""")
def _(v):
    return last_rows(v, feeds.latest_values(event_stream(v, "sensor"), "site", ["id", "flag"]), ["site"], "latest")


@query("stream_daily_completeness", "U9 A2", "sensor", """
SELECT site, cast(cast(time AS date) AS string) AS day, round(CASE WHEN count(value) >= 18 THEN avg(value) END, 6) AS value,
  count(value) AS n, count(value) >= 18 AS ok FROM sensor GROUP BY site, cast(time AS date)""")
def _(v):
    return last_rows(v, feeds.daily_completeness(event_stream(v, "sensor"), lateness(v, "sensor")), ["site", "day"], "daily")


@query("stream_held_positions", "U10 W4", "obs", HELD_SQL + """
SELECT deployment, x AS longitude, y AS latitude, held_from, held_to FROM held""")
def _(v):
    path = fresh_path(v, "held")
    drain(v, feeds.held_position_stream(event_stream(v, "obs"), path, path + "_progress"))
    return feeds.held_positions_so_far(v.spark, path).select("deployment", "longitude", "latitude", "held_from", "held_to")
