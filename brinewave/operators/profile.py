"""Record profiles: sampling steps, gaps, coverage, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.config import SCIENCE
from brinewave.functions import columns as C
from brinewave.operators import chunked


def _stamps(df, key, time):
    """Distinct times with their number of copies."""
    return df.groupBy(key, time).agg(F.count(F.lit(1)).alias("_c"))


def sampling_steps(df: DataFrame, key: str = "site", time: str = "time",
                   seconds: int | None = None) -> DataFrame:
    """(key, step_seconds, n, pct): spacing of consecutive timestamps.

    Copies of one timestamp are zero-length steps; they are counted, not sorted.
    """
    stamps = chunked.with_previous(_stamps(df, key, time), [key], [time], [time], "prev", seconds)
    step = (C.micros(time) - C.micros(f"prev.{time}")) / 1e6
    steps = stamps.select(key, F.explode(F.array(
        F.struct(step.alias("step_seconds"), F.when(step.isNotNull(), 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit(0.0).alias("step_seconds"), (F.col("_c") - 1).alias("n")))).alias("r")
    ).select(key, "r.*").where(F.col("n") > 0)
    hist = steps.groupBy(key, "step_seconds").agg(F.sum("n").alias("n"))
    total = hist.groupBy(key).agg(F.sum("n").alias("_t"))
    return hist.join(total, key).select(
        key, "step_seconds", "n", (F.col("n") / F.col("_t") * 100).alias("pct"))


def gap_table(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
              min_days: float = 7.0, seconds: int | None = None) -> DataFrame:
    """Stretches without a valid sample longer than ``min_days`` (strict)."""
    valid = df.where(C.clean(value).isNotNull()).select(key, time).distinct()
    pairs = chunked.with_previous(valid, [key], [time], [time], "prev", seconds)
    days = (C.micros(time) - C.micros(f"prev.{time}")) / 86_400e6
    return (
        pairs.withColumn("days", days).where(F.col("days") > min_days)
        .select(key, F.col(f"prev.{time}").alias("gap_start"), F.col(time).alias("gap_end"), "days",
                (F.bround(F.col("days") * 24, 0).cast("long") - 1).alias("missing_hours"))
    )


def record_profile(df: DataFrame, key: str = "site", time: str = "time",
                   value: str = "value") -> DataFrame:
    """One row per key: rows, validity, span, duplicate stamps."""
    v = C.clean(value)
    per_stamp = df.groupBy(key, time).agg(
        F.count(F.lit(1)).alias("_c"), F.count(v).alias("_v"))
    return per_stamp.groupBy(key).agg(
        F.sum("_c").alias("n_rows"), F.sum("_v").alias("n_valid"),
        ((F.sum("_c") - F.sum("_v")) / F.sum("_c") * 100).alias("null_pct"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.min(F.when(F.col("_v") > 0, F.col(time))).alias("first_valid"),
        F.max(F.when(F.col("_v") > 0, F.col(time))).alias("last_valid"),
        (F.sum("_c") - F.count(F.lit(1))).alias("duplicate_stamps"),
        F.datediff(F.max(time), F.min(time)).alias("span_days"),
    )


def arrival_order(df: DataFrame, key: str, time: str, sequence: str) -> DataFrame:
    """Whether times never decrease in arrival order; ``sequence`` is that order (a LONG).

    Cut into blocks of the sequence: a block passes on its largest time.
    """
    from pyspark.sql import Window as W

    block = df.withColumn("_b", F.floor(F.col(sequence) / 100_000))
    inside = W.partitionBy(key, "_b").orderBy(sequence)
    local = block.withColumn("_p", F.lag(time).over(inside)).groupBy(key, "_b").agg(
        F.bool_and(F.coalesce(F.col("_p") <= F.col(time), F.lit(True))).alias("_ok"),
        F.min_by(time, sequence).alias("_first"), F.max_by(time, sequence).alias("_last"))
    across = W.partitionBy(key).orderBy("_b")
    return local.withColumn("_before", F.lag("_last").over(across)).groupBy(key).agg(
        F.bool_and(F.col("_ok") & F.coalesce(F.col("_before") <= F.col("_first"), F.lit(True)))
        .alias("monotonic"))


def flag_histogram(df: DataFrame, key: str = "site", flag: str = "flag") -> DataFrame:
    hist = df.groupBy(key, flag).agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy(key).agg(F.sum("n").alias("_t"))
    return hist.join(total, key).select(key, flag, "n", (F.col("n") / F.col("_t") * 100).alias("pct"))


def duplicate_stamps(df: DataFrame, key: str = "site", time: str = "time") -> DataFrame:
    return _stamps(df, key, time).where(F.col("_c") > 1).select(key, time, F.col("_c").alias("copies"))


def high_water_marks(df: DataFrame, key: str = "deployment", time: str = "time") -> DataFrame:
    """Latest stored time per deployment, and its second-resolution text."""
    return df.groupBy(key).agg(F.max(time).alias("mark")).withColumn(
        "mark_text", F.date_format("mark", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def coverage(df: DataFrame, names=SCIENCE) -> DataFrame:
    """(variable, pct): share of rows carrying each variable."""
    share = df.agg(*[(F.avg(C.clean(n).isNotNull().cast("double")) * 100).alias(n) for n in names])
    return share.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable"), F.col(n).alias("pct")) for n in names])).alias("r")
    ).select("r.*")


def coverage_by(df: DataFrame, key: str = "deployment", names=SCIENCE) -> DataFrame:
    """(key, variable, pct, place): share of a key's rows carrying each variable, the best covered first.

    One pass: all shares are aggregates of the same groups, and only they are unfolded. Places
    of equal shares go by name.
    """
    share = df.groupBy(key).agg(*[(F.avg(C.clean(n).isNotNull().cast("double")) * 100).alias(n) for n in names])
    order = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("less"), F.lit(n).alias("variable")) for n in names]))
    return share.select(key, F.posexplode(order).alias("place", "r")).select(
        key, "r.variable", (-F.col("r.less")).alias("pct"), (F.col("place") + 1).alias("place"))


def deployment_summary(df: DataFrame, key: str = "deployment") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"), F.min("time").alias("first_time"),
        F.max("time").alias("last_time"), F.max(C.clean("depth")).alias("max_depth"))


def time_coverage(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(time).alias("coverage_start"), F.max(time).alias("coverage_end"))


def clamp_limits(df: DataFrame, names, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(variable, low, high) colour-scale limits; the data itself is never clamped."""
    from brinewave.operators.quantile import group_quantiles

    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable"), C.clean(n).alias("value")) for n in names])).alias("r")
    ).select("r.*")
    return group_quantiles(long, ["variable"], "value", [low, high]).select(
        "variable", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))
