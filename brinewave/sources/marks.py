"""The log of an archive's marks: what each append added, per deployment.

``path_log/<mode>/commit=<n>`` holds (deployment, mark, rows) of one append, ``base=<n>`` the
sum of all commits up to n. Marks and totals are read from the newest base and the few
commits after it, so an update never scans the archive for them, and one with nothing new
does not read it at all. Every so many commits they are folded into a new base.

An append first leaves a file ``open=<n>``, which its commit removes. If one is found, an
update stopped between its rows and its commit: the marks are then taken from the archive
once and become the base. An archive without a log is read once in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.session import path_exists

FOLD = 16
SCHEMA = "deployment string, mark timestamp, rows bigint"


def _place(path: str, mode: str) -> str:
    return f"{path.rstrip('/')}_log/{mode}"


def _entries(spark: SparkSession, place: str) -> dict[str, list[int]]:
    """Numbers of complete entries by kind."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"base": [], "commit": [], "open": []}
    for f in fs.listStatus(hadoop(place)) if fs.exists(hadoop(place)) else []:
        kind, _, number = f.getPath().getName().partition("=")
        if kind in out and (kind == "open" or fs.exists(hadoop(f"{place}/{kind}={number}/_SUCCESS"))):
            out[kind].append(int(number))
    return {k: sorted(v) for k, v in out.items()}


def _remove(spark: SparkSession, place: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("deployment").agg(F.max("mark").alias("mark"), F.sum("rows").alias("rows"))


def _read(spark: SparkSession, place: str, entries: dict[str, list[int]]) -> DataFrame:
    base = entries["base"][-1:]
    parts = [f"{place}/base={n}" for n in base] + [f"{place}/commit={n}" for n in entries["commit"] if not base or n > base[0]]
    return _summed(spark.read.schema(SCHEMA).parquet(*parts)) if parts else spark.createDataFrame([], SCHEMA)


def marks_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("deployment").agg(F.max("time").alias("mark"), F.count(F.lit(1)).alias("rows"))


def read_marks(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """(deployment, mark, rows) of all that the archive holds of a mode."""
    from brinewave.sources import archive

    place = _place(path, mode)
    entries = _entries(spark, place)
    known = entries["base"] or entries["commit"]
    if entries["open"] or (not known and path_exists(spark, path)):
        number = max([0, *entries["base"], *entries["commit"], *entries["open"]]) + 1
        marks_of(archive.read_archive(spark, path, mode=mode)).write.parquet(f"{place}/base={number}")
        for n in entries["open"]:
            _remove(spark, f"{place}/open={n}")
        entries = _entries(spark, place)
    return _read(spark, place, entries)


def begin(spark: SparkSession, path: str, mode: str) -> int:
    """Note that an append is about to write; its number."""
    place = _place(path, mode)
    entries = _entries(spark, place)
    number = max([0, *entries["base"], *entries["commit"], *entries["open"]]) + 1
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(f"{place}/open={number}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(place))
    fs.create(target, False).close()
    return number


def commit(spark: SparkSession, path: str, mode: str, number: int, added: DataFrame) -> None:
    """Log the marks of the rows that an append wrote; fold the log when it has grown."""
    place = _place(path, mode)
    added.select("deployment", "mark", "rows").coalesce(1).write.parquet(f"{place}/commit={number}")
    _remove(spark, f"{place}/open={number}")
    entries = _entries(spark, place)
    after = [n for n in entries["commit"] if not entries["base"] or n > entries["base"][-1]]
    if len(after) >= FOLD:
        _read(spark, place, entries).coalesce(1).write.parquet(f"{place}/base={number}")
        for n in entries["commit"]:
            _remove(spark, f"{place}/commit={n}")
        for n in entries["base"]:
            _remove(spark, f"{place}/base={n}")
