"""Quality screens: ranges, copied channels, spikes, seasonal outliers, frozen positions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import (
    CHANNEL_PRECEDENCE,
    DEFAULT_SCALE,
    GROSS_RANGES,
    SCIENCE,
    ScreenConfig,
)
from brinewave.functions import columns as C
from brinewave.operators import chunked
from brinewave.operators.quantile import build_pool, pool_deviation, pool_quantiles
from brinewave.operators.rolling import range_medians, time_frames
from brinewave.operators.sizing import join_checked
from brinewave.session import cut_lineage, ship_package


def fill_absent(df: DataFrame, names=SCIENCE) -> DataFrame:
    """A sensor a platform did not carry becomes an all-null column."""
    missing = {n: F.lit(None).cast("double") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def coerce_numbers(df: DataFrame, names) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({
        n: C.to_number(n) if types[n] == "string" else C.clean(n)
        for n in names if n in types})


def require(df: DataFrame, names) -> DataFrame:
    """Drop rows missing any required field; NaN counts as missing."""
    types = dict(df.dtypes)
    tests = [C.clean(n).isNotNull() if types[n] in ("double", "float") else F.col(n).isNotNull()
             for n in names]
    return df.where(reduce(lambda a, b: a & b, tests))


def gross_range(df: DataFrame, ranges=None, science=SCIENCE) -> DataFrame:
    """Blank implausible values; drop a row only when every science value is missing."""
    ranges = GROSS_RANGES if ranges is None else ranges
    held = [n for n in ranges if n in df.columns]
    out = df.withColumns({n: C.within(n, *ranges[n]) for n in held})
    present = [n for n in science if n in df.columns]
    return out.where(F.coalesce(*[C.clean(n) for n in present]).isNotNull()) if present else out


def range_tally(df: DataFrame, ranges=None) -> DataFrame:
    """Per variable: values present and values outside the range. One pass over the data."""
    ranges = GROSS_RANGES if ranges is None else ranges
    held = [n for n in ranges if n in df.columns]
    aggs = []
    for n in held:
        value = C.clean(n)
        aggs += [F.count(value).alias(f"{n}__present"),
                 F.count_if(value.isNotNull() & ~value.between(*ranges[n])).alias(f"{n}__flagged")]
    totals = df.agg(*aggs)
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable"), F.col(f"{n}__present").alias("present"),
                 F.col(f"{n}__flagged").alias("flagged")) for n in held])).alias("r")).select("r.*")


def keep_good(df: DataFrame, flag: str, value: str, flags) -> DataFrame:
    return df.where(C.good_flag(flag, value, flags))


def copied_channels(df: DataFrame, key: str = "deployment", channels=CHANNEL_PRECEDENCE,
                    min_shared: int = 10) -> DataFrame:
    """Per deployment, which channels are exact copies of a more trusted one.

    All ordered pairs are counted in one aggregate; the cascade (a blanked channel can
    accuse nobody) is resolved in precedence order on the one-row-per-deployment result.
    """
    present = [n for n in channels if n in df.columns]
    aggs = []
    for i, trusted in enumerate(present):
        for suspect in present[i + 1:]:
            a, b = C.clean(trusted), C.clean(suspect)
            both = a.isNotNull() & b.isNotNull()
            aggs += [F.count_if(both).alias(f"{trusted}|{suspect}|n"),
                     F.count_if(both & (a != b)).alias(f"{trusted}|{suspect}|d")]
    verdict = df.groupBy(key).agg(*aggs)
    for i, suspect in enumerate(present):
        accused = F.lit(False)
        for trusted in present[:i]:
            pair = f"{trusted}|{suspect}"
            accused = accused | (
                ~F.col(f"_copy_{trusted}")
                & (F.col(f"`{pair}|n`") >= min_shared) & (F.col(f"`{pair}|d`") == 0))
        verdict = verdict.withColumn(f"_copy_{suspect}", accused)
    return verdict.select(key, *[F.col(f"_copy_{n}") for n in present])


def blank_copied_channels(df: DataFrame, key: str = "deployment", channels=CHANNEL_PRECEDENCE,
                          min_shared: int = 10) -> DataFrame:
    present = [n for n in channels if n in df.columns]
    verdict = copied_channels(df, key, present, min_shared)
    out = join_checked(df, verdict, key, "left")
    return out.withColumns({n: F.when(~F.col(f"_copy_{n}"), F.col(n)) for n in present}).drop(
        *[f"_copy_{n}" for n in present])


def despike(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
            cfg: ScreenConfig = ScreenConfig(), chunk_hours: int | None = None) -> DataFrame:
    """Drop points far from a centred rolling median, limit scaled by the rolling MAD.

    The frame is (t - 6.5 h, t + 6.5 h]. Each key is cut into time chunks, and rows near a
    chunk edge are copied to the neighbour: twice the half window, as the second pass
    reads residuals that themselves need a full window. A point whose limit is undecided
    is dropped. The medians of all frames of a chunk are found together (``rolling``), at a
    cost that does not depend on how many rows a frame holds; chunks go through Arrow.
    """
    half = int(cfg.half_window_hours * 3_600_000_000)
    hours = chunk_hours or chunked.width_for(df, [key], time, DEFAULT_SCALE.screen_widths) // 3_600
    width = hours * 3_600_000_000
    margin = 2 * half
    at = F.col("_us")
    home = F.floor(at / F.lit(width)).cast("long")
    copies = F.array_distinct(F.array(
        home,
        F.floor((at - margin) / F.lit(width)).cast("long"),
        F.floor((at + margin) / F.lit(width)).cast("long")))
    cut = (
        df.where(C.clean(value).isNotNull())
        .withColumn("_us", C.micros(time))
        .withColumn("_home", home)
        .withColumn("_chunk", F.explode(copies))
    )
    kept = df.columns
    least, floor, times = cfg.min_neighbours, cfg.floor, cfg.sds * cfg.mad_scale

    def screened(table: pa.Table) -> pa.Table:
        table = table.sort_by("_us")
        values = table.column(value).cast(pa.float64()).to_numpy()
        first, last = time_frames(table.column("_us").to_numpy(), half)
        residual = values - range_medians(values, first, last, least)
        spread = range_medians(np.abs(residual), first, last, least)
        near = np.abs(residual) <= np.maximum(floor, times * spread)  # false where undecided
        here = table.column("_home").to_numpy() == table.column("_chunk").to_numpy()
        return table.filter(pa.array(near & here)).select(kept)

    ship_package(df.sparkSession)
    return cut.groupBy(key, "_chunk").applyInArrow(screened, df.schema)


def yearday_scale(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
                  cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """(key, yearday, centre, scale): median and scaled MAD of the pooled +/- window."""
    pool = build_pool(df, [key], value, C.yearday(time), 365,
                      lambda c: C.circular_days(c, cfg.window_days), ranks=2)
    centre = cut_lineage(pool_quantiles(pool, [0.5]).select(key, "_t", F.element_at("q", 1).alias("centre")))
    spread = pool_deviation(pool, centre)
    return centre.join(spread, [key, "_t"]).select(
        key, F.col("_t").alias("yearday"), "centre", (F.col("spread") * cfg.mad_scale).alias("scale"))


def drop_yearday_outliers(df: DataFrame, key: str = "site", time: str = "time",
                          value: str = "value", cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Drop points beyond ``sds`` robust deviations; an undecided point is kept."""
    scale = yearday_scale(df, key, time, value, cfg)
    far = F.abs(F.col(value) - F.col("centre")) > F.col("scale") * cfg.sds
    return (
        join_checked(df.withColumn("yearday", C.yearday(time)), scale, [key, "yearday"], "left")
        .where(~F.coalesce(far, F.lit(False)))
        .select(*df.columns)
    )


def first_per_time(df: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Keep the first of duplicate timestamps, by an explicit tie-break column."""
    return df.groupBy(key, time).agg(F.min_by(value, tie).alias(value))


def screen_buoy(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
                cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Range, despike, hourly mean, seasonal outlier screen."""
    inside = df.where(C.clean(value).between(cfg.low, cfg.high))
    smooth = despike(inside, key, time, value, cfg)
    hourly = smooth.groupBy(key, F.date_trunc("hour", time).alias(time)).agg(
        F.avg(value).alias(value))
    return drop_yearday_outliers(hourly, key, time, value, cfg)


def screen_tally(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
                 cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Per site: rows raw, out of range, spikes, hourly bins, seasonal outliers, kept."""
    inside = df.where(C.clean(value).between(cfg.low, cfg.high))
    smooth = despike(inside, key, time, value, cfg)
    hourly = smooth.groupBy(key, F.date_trunc("hour", time).alias(time)).agg(
        F.avg(value).alias(value))
    kept = drop_yearday_outliers(hourly, key, time, value, cfg)

    def counted(frame, name):
        return frame.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(C.clean(value).between(cfg.low, cfg.high)).alias("_in"))
    for frame, name in ((smooth, "_smooth"), (hourly, "hourly_bins"), (kept, "kept")):
        out = out.join(counted(frame, name), key, "left").fillna(0, [name])
    return out.select(
        key, "raw_records",
        (F.col("raw_records") - F.col("_in")).alias("out_of_range"),
        (F.col("_in") - F.col("_smooth")).alias("spikes"),
        "hourly_bins",
        (F.col("hourly_bins") - F.col("kept")).alias("day_of_year_outliers"),
        "kept")


def position_runs(df: DataFrame, key: str = "deployment", seconds: int | None = None) -> DataFrame:
    """(key, run, longitude, latitude, held_from, held_to): stretches of one position.

    Works on distinct (key, time, position): copies of a fix cannot make a task large.
    A missing coordinate starts its own run. Equality is at six decimals.
    """
    fixes = df.select(
        key, "time", F.bround("longitude", 6).alias("_x"), F.bround("latitude", 6).alias("_y")
    ).distinct()
    fixes = fixes.withColumn("_chunk", chunked.time_chunk("time", seconds or chunked.width_for(fixes, [key], "time")))
    order = ["time", "_x", "_y"]
    inside = W.partitionBy(key, "_chunk").orderBy(*order)
    across = W.partitionBy(key).orderBy("_chunk")

    def moved(x, y, px, py):
        return ~F.coalesce((F.col(x) == F.col(px)) & (F.col(y) == F.col(py)), F.lit(False))

    local = fixes.withColumn("_px", F.lag("_x").over(inside)).withColumn("_py", F.lag("_y").over(inside)).withColumn(
        "_row", F.row_number().over(inside))
    # the first row of a chunk is judged against the last row of the chunk before
    step = F.when(F.col("_row") == 1, 0).otherwise(moved("_x", "_y", "_px", "_py").cast("long"))
    local = local.withColumn("_n", F.sum(step).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.struct(*order)
    chunks = (
        local.groupBy(key, "_chunk").agg(
            F.max("_n").alias("_steps"), F.min(rank).alias("_first"), F.max(rank).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .withColumn("_new", moved("_first._x", "_first._y", "_carry._x", "_carry._y").cast("long"))
        .withColumn("_base", F.sum(F.col("_steps") + F.col("_new")).over(
            across.rowsBetween(W.unboundedPreceding, 0)) - F.col("_steps"))
        .select(key, "_chunk", "_base")
    )
    return local.join(chunks, [key, "_chunk"]).withColumn("run", F.col("_base") + F.col("_n")).groupBy(key, "run").agg(
        F.first("_x").alias("longitude"), F.first("_y").alias("latitude"),
        F.min("time").alias("held_from"), F.max("time").alias("held_to"))


def held_runs(df: DataFrame, key: str = "deployment", max_hold_hours: float = 8.0,
              seconds: int | None = None) -> DataFrame:
    """Stretches whose position repeats for ``max_hold_hours`` or longer."""
    return position_runs(df, key, seconds).where(
        C.micros("held_to") - C.micros("held_from") >= F.lit(int(max_hold_hours * 3_600_000_000))
    ).drop("run")


def mask_held_positions(df: DataFrame, key: str = "deployment",
                        max_hold_hours: float | None = 8.0,
                        seconds: int | None = None) -> DataFrame:
    """Drop observations inside a held run. Must see the whole record, so run it before
    any cut to a recent window. ``None`` or 0 turns it off."""
    if not max_hold_hours:
        return df
    runs = held_runs(df, key, max_hold_hours, seconds).select(
        F.col(key).alias("_key"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y"),
        "held_from", "held_to")
    hit = (
        (F.col(key) == F.col("_key"))
        & (F.bround("longitude", 6) == F.col("_x")) & (F.bround("latitude", 6) == F.col("_y"))
        & F.col("time").between(F.col("held_from"), F.col("held_to"))
    )
    return df.join(runs, hit, "left_anti")


def product_truth(profiles: DataFrame, names: DataFrame, key: str = "deployment",
                  field: str = "temperature_adjusted") -> DataFrame:
    """Accept a product only if its calibrated field holds a finite value; say why not."""
    if field not in profiles.columns:
        adjusted = sorted(c for c in profiles.columns if c.endswith("_adjusted"))
        reason = f"no {field} (has: {', '.join(adjusted) or 'no adjusted fields at all'})"
        return names.select(key, F.lit(0).cast("long").alias("finite"),
                            F.lit(False).alias("accepted"), F.lit(reason).alias("reason"))
    tally = profiles.groupBy(key).agg(F.count(C.clean(field)).alias("finite"))
    return (
        names.select(key).join(tally, key, "left")
        .withColumn("finite", F.coalesce("finite", F.lit(0)))
        .withColumn("accepted", F.col("finite") > 0)
        .withColumn("reason", F.when(F.col("accepted"), F.concat(
            F.col("finite").cast("string"), F.lit(f" finite {field} points")))
            .otherwise(F.lit(f"{field} present but entirely NaN")))
    )
