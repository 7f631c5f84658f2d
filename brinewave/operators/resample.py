"""Hourly, daily and monthly frames with explicit completeness rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.config import Completeness
from brinewave.functions import columns as C


def hourly_mean(df: DataFrame, key: str = "site", time: str = "time",
                value: str = "value") -> DataFrame:
    """Mean per hour; hours without a value do not appear."""
    return df.where(C.clean(value).isNotNull()).groupBy(
        key, F.date_trunc("hour", time).alias(time)).agg(F.avg(value).alias(value))


def spine(bounds: DataFrame, key: str, low: str, high: str, step: str, out: str) -> DataFrame:
    """Contiguous calendar steps from ``low`` to ``high`` per key."""
    return bounds.select(key, F.explode(F.sequence(
        F.col(low), F.col(high), F.expr(f"interval 1 {step}"))).alias(out))


def to_daily(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
             min_hours: int = 18) -> DataFrame:
    """(key, day, value, n, ok): every day between first and last, even the empty ones.

    The first and last day come from all rows, valid or not. Under the threshold the mean
    is null and the row stays.
    """
    binned = df.groupBy(key, F.to_date(time).alias("day")).agg(
        F.avg(C.clean(value)).alias("value"), F.count(C.clean(value)).alias("n"))
    bounds = binned.groupBy(key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = spine(bounds, key, "_a", "_b", "day", "day")
    return (
        days.join(binned, [key, "day"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("ok", F.col("n") >= min_hours)
        .withColumn("value", F.when(F.col("ok"), F.col("value")))
        .select(key, "day", "value", "n", "ok")
    )


def daily_frame(df: DataFrame, key: str = "site", day: str = "day",
                value: str = "value") -> DataFrame:
    """An already daily series; missing days are not invented."""
    v = C.clean(value)
    return df.select(key, F.to_date(day).alias("day"), v.alias("value"),
                     v.isNotNull().cast("long").alias("n"), v.isNotNull().alias("ok"))


def to_monthly(daily: DataFrame, key: str = "site",
               rule: Completeness = Completeness()) -> DataFrame:
    """(key, month, value, n, ok): contiguous months, mean of the ok days.

    With ``drop_partial_end`` the last month goes unless the record reaches its last day;
    the record end is the last daily row, ok or not.
    """
    ok = F.col("ok") & F.col("value").isNotNull()
    tally = daily.groupBy(key, C.month_start("day").alias("month")).agg(
        F.avg(F.when(ok, F.col("value"))).alias("value"),
        F.count_if(ok).alias("n"),
        F.min("day").alias("_first"), F.max("day").alias("_last"))
    bounds = tally.groupBy(key).agg(
        F.min("month").alias("_a"), F.max("month").alias("_b"), F.max("_last").alias("_last"))
    if rule.drop_partial_end:
        partial = F.month(F.date_add("_last", 1)) == F.month("_last")
        bounds = bounds.withColumn(
            "_b", F.when(partial, F.add_months("_b", -1)).otherwise(F.col("_b"))
        ).where(F.col("_b") >= F.col("_a"))
    months = spine(bounds, key, "_a", "_b", "month", "month")
    return (
        months.join(tally.select(key, "month", "value", "n"), [key, "month"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("ok", F.col("n") >= rule.min_days)
        .withColumn("value", F.when(F.col("ok"), F.col("value")))
        .select(key, "month", "value", "n", "ok")
    )
