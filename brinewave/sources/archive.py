"""The observation archive: parquet partitioned by mode and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.config import SCIENCE
from brinewave.functions import columns as C
from brinewave.schema import OBSERVATION_KEYS, OBSERVATIONS


def archive_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def window(frame: DataFrame, start=None, end=None, last_days: float | None = None, now=None) -> DataFrame:
    """Both bounds inclusive; ``last_days`` (needs ``now``) replaces ``start``."""
    if last_days is not None:
        if now is None:
            raise ValueError("last_days needs the time it counts from")
        frame = frame.where(C.since("time", now, last_days))
    elif start is not None:
        frame = frame.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        frame = frame.where(F.col("time") <= F.lit(end).cast("timestamp"))
    return frame


def select_variables(frame: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """The key columns and the asked science variables, in the order asked; all by default."""
    if variables is None:
        return frame.select(*OBSERVATION_KEYS, *SCIENCE)
    strangers = set(variables).difference(SCIENCE)
    if strangers:
        raise ValueError("not measured here: " + ", ".join(sorted(strangers)))
    return frame.select(*OBSERVATION_KEYS, *variables)


def read_archive(spark: SparkSession, path: str, mode: str | None = None, start=None, end=None,
                 last_days: float | None = None, variables: Sequence[str] | None = None,
                 now=None) -> DataFrame:
    """Windowed, pruned read. An archive that does not exist reads as an empty frame.

    The month partition is bounded too, so that old directories are never listed.
    """
    if not archive_exists(spark, path):
        empty = spark.createDataFrame([], OBSERVATIONS)
        return select_variables(empty, variables)
    frame = spark.read.parquet(path)
    if mode is not None:
        frame = frame.where(F.col("mode") == mode)
    if last_days is not None and now is not None:
        low = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval(0,0,0,{last_days * 86400})")
        frame = frame.where(F.col("month") >= F.date_format(low, "yyyy-MM"))
    elif start is not None:
        frame = frame.where(F.col("month") >= F.date_format(F.lit(start).cast("timestamp"), "yyyy-MM"))
    if end is not None:
        frame = frame.where(F.col("month") <= F.date_format(F.lit(end).cast("timestamp"), "yyyy-MM"))
    frame = window(frame, start, end, last_days, now).withColumn("glider", C.glider_of("deployment"))
    return select_variables(frame, variables)


def append_archive(spark: SparkSession, path: str, rows: DataFrame, mode: str,
                   message: str | None = None) -> int:
    """Append rows and an audit line; nothing to add writes nothing and returns 0.

    Rows are spread by (month, deployment, day): a deployment with a third of the rows
    still lands in many files.
    """
    added = rows.count()
    if added == 0:
        return 0
    day = F.to_date("time")
    (
        rows.withColumn("mode", F.lit(mode)).withColumn("month", F.date_format("time", "yyyy-MM"))
        .repartition("month", "deployment", day).sortWithinPartitions("deployment", "time")
        .write.mode("append").partitionBy("mode", "month").parquet(path)
    )
    note = message or f"appended {added:,} {mode} observations"
    spark.range(1).select(
        F.current_timestamp().alias("at"), F.lit(mode).alias("mode"),
        F.lit(added).cast("long").alias("appended"), F.lit(note).alias("message"),
    ).write.mode("append").parquet(path.rstrip("/") + "_history")
    return added


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path.rstrip("/") + "_history")


def read_grid(spark: SparkSession, path: str, last_days: int | None = None) -> DataFrame:
    """A long grid table, plain or published as versions; ``last_days`` counts the steps present, not calendar days."""
    from brinewave.operators.sequences import newest_steps
    from brinewave.sources.versions import current

    grid = spark.read.parquet(current(spark, path))
    values = [c for c in grid.columns if c not in ("date", "source", "i", "j", "lat", "lon")]
    if len(values) != 1:
        raise ValueError(f"expected one data variable, found {values}")
    grid = grid.withColumnRenamed(values[0], "value")
    return grid if last_days is None else newest_steps(grid, last_days)


def read_snapshot(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """A frozen snapshot without the deployments that cannot form a line."""
    from brinewave.operators.sequences import min_points

    return min_points(spark.read.parquet(path), "deployment", least)


def retire_steps(spark: SparkSession, path: str, keep: int, partition: str = "date", value: str = "value") -> list[str]:
    """Delete the steps of a stored layer that are older than its newest ``keep`` filled ones; names of those deleted.

    A step without a value does not count and goes only if it is older than those kept. Rows
    without a step are older than all. A partition goes as a folder, whole; running it again
    deletes nothing.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith(f"{partition}=")]
    layer = spark.read.parquet(path)
    filled = layer.where(F.col(partition).isNotNull())
    filled = filled.where(C.clean(value).isNotNull()) if value in layer.columns else filled
    newest = filled.select(F.col(partition).cast("string").alias("step")).distinct().orderBy(F.desc("step")).limit(keep)
    oldest_kept = newest.agg(F.min("step").alias("step")).first()["step"]
    if oldest_kept is None:  # nothing is filled, so nothing is newer than anything
        return []
    none = f"{partition}=__HIVE_DEFAULT_PARTITION__"
    old = sorted(n for n in names if n == none or n.partition("=")[2] < oldest_kept)
    for name in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return ["" if n == none else n.partition("=")[2] for n in old]
