"""CSV exports whose metadata sits in a preamble or comment header, read in bulk.

A directory of files is one table: data rows carry their file, header fields become one
row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewave.functions import columns as C
from brinewave.schema import STATION_ROWS


def _file() -> F.Column:
    return F.col("_metadata.file_path")


def station_header(spark: SparkSession, path: str, keys=None) -> DataFrame:
    """(file, key columns...) from ``#KEY: value  / note`` lines with upper-case keys."""
    lines = spark.read.text(path).select(_file().alias("file"), "value")
    comment = lines.where(F.startswith("value", F.lit("#")) & F.contains("value", F.lit(":")))
    body = F.expr("substring(value, 2)")
    key = F.trim(F.split_part(body, F.lit(":"), F.lit(1)))
    rest = F.regexp_replace(body, "^[^:]*:", "")
    value = F.trim(F.split_part(rest, F.lit("  /"), F.lit(1)))
    fields = comment.select("file", key.alias("key"), F.regexp_replace(value, '^"+|"+$', "").alias("text")).where(
        (F.col("key") == F.upper("key")) & F.col("key").rlike("[A-Z]"))
    pivot = fields.groupBy("file").pivot("key", list(keys)) if keys else fields.groupBy("file").pivot("key")
    return pivot.agg(F.last("text"))


def station_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, time, value, flag, count); 'NaN' text becomes NULL."""
    raw = (
        spark.read.schema(STATION_ROWS).option("comment", "#").option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    return raw.select(
        _file().alias("file"), F.to_timestamp("time_text").alias("time"), C.to_number("value_text").alias("value"),
        F.col("flag").cast("tinyint").alias("flag"), "count")


def station_fields(header: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(file, lat, lon, depth_m, record_start, record_end) per station file.

    The span is taken from the file name, else from the data. Units after a number are
    tolerated; a header without a position is an error.
    """
    name = F.element_at(F.split("file", "/"), -1)
    pattern = r"(\d{8})T\d{6}Z_(\d{8})T\d{6}Z"

    def named(group):
        return F.to_date(F.nullif(F.regexp_extract(name, pattern, group), F.lit("")), "yyyyMMdd")

    def position(key):
        c = C.first_number(key)
        return F.when(c.isNotNull(), c).otherwise(F.raise_error(
            F.concat(name, F.lit(f": header has no {key}"))).cast("double"))

    depth = C.first_number("DEPTH") if "DEPTH" in header.columns else F.lit(None).cast("double")
    out = header.select("file", position("LATITUDE").alias("lat"), position("LONGITUDE").alias("lon"),
                        depth.alias("depth_m"), named(1).alias("record_start"), named(2).alias("record_end"))
    if rows is None:
        return out
    span = rows.groupBy("file").agg(F.to_date(F.min("time")).alias("_a"), F.to_date(F.max("time")).alias("_b"))
    return out.join(span, "file", "left").withColumn("record_start", F.coalesce("record_start", "_a")).withColumn(
        "record_end", F.coalesce("record_end", "_b")).drop("_a", "_b")


BUOY_COLUMNS = T.StructType([
    T.StructField("STN_ID", T.StringType()), T.StructField("DATE", T.StringType()),
    T.StructField("LATITUDE", T.DoubleType()), T.StructField("LONGITUDE", T.DoubleType()),
    T.StructField("DEPTH", T.DoubleType()), T.StructField("Q_FLAG", T.IntegerType()),
    T.StructField("SeaWaterTemperature", T.DoubleType()),
])


def buoy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(site, time, value, lat, lon, depth); the first of duplicate stamps stays.

    The quality flag is read past on purpose: it cannot be trusted. Which duplicate is
    first follows the order within the file.
    """
    header = spark.read.option("header", True).schema(BUOY_COLUMNS).option("enforceSchema", False).csv(path)
    rows = header.select(
        F.col("STN_ID").alias("site"), F.to_timestamp("DATE", "MM/dd/yyyy HH:mm").alias("time"),
        C.clean("SeaWaterTemperature").alias("value"), F.col("LATITUDE").alias("lat"),
        F.col("LONGITUDE").alias("lon"), F.col("DEPTH").alias("depth"),
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return rows.groupBy("site", "time").agg(F.min_by(
        F.struct("value", "lat", "lon", "depth"), F.struct("_file", "_at")).alias("r")).select("site", "time", "r.*")


def commented_series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(file, day, value) of CSV files with a ``# key: value`` header."""
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField(value, T.StringType())])
    raw = spark.read.schema(schema).option("comment", "#").csv(path)
    return raw.where(F.col("date") != "date").select(
        _file().alias("file"), F.to_date("date").alias("day"), C.to_number(value).alias("value"))


def commented_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, key, value): header lines, kept verbatim to be written back."""
    lines = spark.read.text(path).select(
        _file().alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    body = F.expr("substring(text, 2)")
    return lines.where(F.startswith("text", F.lit("#"))).select(
        "file", "line", "text", F.trim(F.split_part(body, F.lit(":"), F.lit(1))).alias("key"),
        F.trim(F.regexp_replace(body, "^[^:]*:?", "")).alias("value"))


def write_commented_series(series: DataFrame, header: DataFrame, path: str, value: str) -> None:
    """Write one small series (days of one cell) back below its verbatim header."""
    head = header.select(F.col("line").cast("long").alias("_o"), F.lit("").alias("_d"), "text")
    title = head.sparkSession.range(1).select(
        F.lit(2**62).alias("_o"), F.lit("").alias("_d"), F.lit(f"date,{value}").alias("text"))
    rows = series.select(F.lit(2**62 + 1).alias("_o"), F.col("day").cast("string").alias("_d"),
                         F.concat_ws(",", F.col("day").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("text"))
    head.unionByName(title).unionByName(rows).repartitionByRange(1, "_o", "_d").sortWithinPartitions(
        "_o", "_d").select("text").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, places: int = 4) -> None:
    """CSV with a header; doubles rounded half-even."""
    out = df.select(*[
        C.tidy_round(n, places).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).csv(path)
