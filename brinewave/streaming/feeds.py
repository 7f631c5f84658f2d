"""Structured Streaming twins of the incremental and resampling operators."""

from __future__ import annotations

import time as time_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from brinewave.functions import columns as C
from brinewave.operators.incremental import after_marks, fresh_rows
from brinewave.session import cut_lineage, path_exists, stored_table


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, mode: str,
                  lateness_seconds: float = 0.0):
    """Writer that keeps an archive up to date from landed rows.

    Every micro-batch is screened, de-duplicated and held against the marks that the batches
    before left beside the archive (``path_marks``: one row per deployment), so late rows are
    refused per deployment, without reading the archive. ``path_refused`` counts them per
    batch. A batch writes its own partitions and replaces them when replayed: rows are
    neither lost nor doubled.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _newest(spark, f"{path}_marks", batch_id)
        offered = stored_table(batch, "offered")
        newer = offered if held is None else after_marks(offered, held, lateness_seconds=lateness_seconds)
        rows = stored_table(fresh_rows(newer, None), "fresh")
        marks = rows.groupBy("deployment").agg(F.max("time").alias("mark"))
        if held is not None:
            marks = marks.unionByName(held).groupBy("deployment").agg(F.max("mark").alias("mark"))
        refused = spark.createDataFrame([(offered.count() - newer.count(),)], "refused bigint")
        _replace(rows.withColumn("mode", F.lit(mode)), path, batch_id, "mode")
        _replace(refused, f"{path}_refused", batch_id)
        _replace(marks, f"{path}_marks", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _replace(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch").parquet(path)


def _newest(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows of the last batch before this one, if there is any."""
    if not path_exists(spark, path):
        return None
    before = spark.read.parquet(path).where(F.col("batch") < batch_id)
    last = before.agg(F.max("batch").alias("v")).first()["v"]
    return None if last is None else before.where(F.col("batch") == last).drop("batch")


class LateRows(StreamingQueryListener):
    """Counts rows that queries drop as later than their lateness, in every report of every batch.

    A query itself keeps only its newest reports; a listener is sent all of them. The count of
    a query is whole once ``of`` has waited for its last report.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dropped, self.ended = spark, {}, set()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query, seconds: float = 60.0) -> int:
        """Rows the finished query dropped."""
        until = time_module.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time_module.monotonic() > until:
                raise TimeoutError("the end of the query was not reported")
            time_module.sleep(0.02)
        return self.dropped.get(str(query.runId), 0)


def span_of(rows: DataFrame, time: str = "time") -> str:
    """A lateness that covers any order of these rows: from the oldest to the newest, and a second."""
    low, high = rows.agg(F.min(C.micros(time)), F.max(C.micros(time))).first()
    return f"{0 if low is None else (high - low) // 1_000_000 + 1} seconds"


def refused_rows(query) -> int:
    """Rows a finished query dropped as later than its lateness allows, in its newest reports (see ``LateRows``)."""
    return sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)


def distinct_times(stream: DataFrame, keys, lateness: str, time: str = "time") -> DataFrame:
    """One row per key and time. State is kept for ``lateness``, the disorder the feed may have;
    rows later than that are refused and counted (``LateRows``)."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, time])


def latest_values(stream: DataFrame, key: str, values, time: str = "time") -> DataFrame:
    """Running latest row per key, for update mode."""
    return stream.groupBy(key).agg(
        F.max(time).alias("latest_time"),
        F.max_by(F.struct(*values), time).alias("_r")).select(key, "latest_time", "_r.*")


def daily_completeness(stream: DataFrame, lateness: str, key: str = "site", time: str = "time", value: str = "value",
                       min_hours: int = 18) -> DataFrame:
    """Tumbling-day twin of the daily frame: (key, day, value, n, ok).

    In append mode a day comes out once it is closed, ``lateness`` after the newest row; in
    update mode as often as it changes. Rows later than that are refused and counted.
    """
    v = C.clean(value)
    return (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, "1 day"), key)
        .agg(F.avg(v).alias("_mean"), F.count(v).alias("n"))
        .select(key, F.to_date("window.start").alias("day"),
                F.when(F.col("n") >= min_hours, F.col("_mean")).alias("value"), "n",
                (F.col("n") >= min_hours).alias("ok"))
    )


RUNS = "deployment string, longitude double, latitude double, held_from timestamp, held_to timestamp, batch long"


def held_position_stream(stream: DataFrame, path: str, checkpoint: str, max_hold_hours: float = 8.0):
    """Writer that detects frozen positions as rows arrive.

    ``path/closed`` gets the held runs that ended, ``path/open`` the still open run of every
    deployment after each batch. A batch continues from the open runs of the batch before:
    their first and last fix join the new fixes and the batch operator does the rest, so a
    deployment with most of the feed is still cut along time. Rows older than the open
    run's last fix are late and refused. Replaying a batch replaces its own output.
    """
    from brinewave.operators.screening import position_runs

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fixes = batch.select("deployment", "time", "longitude", "latitude")
        before = _newest(spark, f"{path}/open", batch_id)
        if before is not None:
            marks = before.select("deployment", F.col("held_to").alias("mark"))
            ends = before.select("deployment", F.explode(F.array("held_from", "held_to")).alias("time"),
                                 "longitude", "latitude")
            fixes = after_marks(fixes, marks).unionByName(ends)
        runs = cut_lineage(position_runs(fixes))
        last = runs.groupBy("deployment").agg(F.max("held_to").alias("held_to"))
        tail = runs.join(last, ["deployment", "held_to"], "left_semi")
        tail = tail.groupBy("deployment").agg(F.max_by(
            F.struct("longitude", "latitude", "held_from", "held_to"), "run").alias("r"), F.max("run").alias("run"))
        closed = runs.join(tail.select("deployment", "run"), ["deployment", "run"], "left_anti").where(
            C.micros("held_to") - C.micros("held_from") >= int(max_hold_hours * 3_600_000_000)).drop("run")
        for frame, name in ((closed, "closed"), (tail.select("deployment", "r.*"), "open")):
            _replace(frame, f"{path}/{name}", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def held_positions_so_far(spark: SparkSession, path: str, max_hold_hours: float = 8.0) -> DataFrame:
    """Closed runs plus the open ones that are already long enough."""
    closed = spark.read.schema(RUNS).parquet(f"{path}/closed")  # may hold no run yet
    state = spark.read.schema(RUNS).parquet(f"{path}/open")
    newest = state.agg(F.max("batch").alias("v")).scalar()
    now_open = state.where(F.col("batch") == newest).where(
        C.micros("held_to") - C.micros("held_from") >= int(max_hold_hours * 3_600_000_000))
    return closed.unionByName(now_open).drop("batch")
