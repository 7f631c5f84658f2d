"""Tables published as versions: a reader sees the old or the new one, never none and never a mixture.

``path/version=<n>`` holds the rows of a version, ``path/_committed/<n>`` is an empty file
that makes it the table. A version is written whole before its file is created, which is one
atomic step on any file system; nothing is renamed and nothing a reader holds is touched. Of
older versions the newest few are kept, so that a reader that resolved one can end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, folder: str, prefix: str = "") -> list[int]:
    hadoop, fs = _files(spark, path)
    place = hadoop(f"{path}/{folder}" if folder else path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def committed(spark: SparkSession, path: str) -> list[int]:
    """The published versions that are kept, oldest first."""
    return _numbers(spark, path.rstrip("/"), "_committed")


def publish_version(df: DataFrame, path: str, keep: int = 3) -> int:
    """Write the rows as the next version, make it the table, and drop all but the newest ``keep``.

    A version that was begun and not committed is no version; its number is not used again.
    Of two writers with the same number the second fails at its commit and publishes nothing.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    hadoop, fs = _files(spark, path)
    number = max([0, *committed(spark, path), *_numbers(spark, path, "", "version=")]) + 1
    df.write.mode("errorifexists").parquet(f"{path}/version={number}")
    fs.mkdirs(hadoop(f"{path}/_committed"))
    fs.create(hadoop(f"{path}/_committed/{number}"), False).close()
    held = committed(spark, path)
    last = held[-keep:][0]
    for old in (n for n in held if n < last):  # no longer the table for anyone who asks, then its rows
        fs.delete(hadoop(f"{path}/_committed/{old}"), False)
    for old in (n for n in _numbers(spark, path, "", "version=") if n < last):
        fs.delete(hadoop(f"{path}/version={old}"), True)
    return number


def current(spark: SparkSession, path: str) -> str:
    """Folder of the published version; the path itself if nothing was published there as versions."""
    held = committed(spark, path)
    return f"{path.rstrip('/')}/version={held[-1]}" if held else path


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))
