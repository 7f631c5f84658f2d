"""De-duplication, top-of-group, thinning, windows and calendar pieces of a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import Recency, SeriesConfig
from brinewave.functions import columns as C
from brinewave.operators import chunked
from brinewave.operators.screening import mask_held_positions, require
from brinewave.operators.sizing import join_checked
from brinewave.session import stored_table


def _pick(df, keys, order, last):
    """One whole row per key by min/max of ``order``: combines map-side, so a group of
    copies is never gathered."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) for o in order])
    choose = F.max_by if last else F.min_by
    out = df.groupBy(*keys).agg(choose(F.struct(*rest), rank).alias("_r"))
    return out.select(*keys, "_r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, list(keys), list(order), last=False)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, list(keys), list(order), last=True)


def dedup_observations(df: DataFrame, order: Sequence[str],
                       keys: Sequence[str] = ("deployment", "time", "depth")) -> DataFrame:
    """Keep one row per (deployment, time, depth); null depths compare equal."""
    return keep_first(df, keys, order)


def newest_fix(df: DataFrame, key: str = "deployment", time: str = "time",
               tie: str | None = None) -> DataFrame:
    """Latest row per deployment; on equal times the row with the smallest tie wins."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(time), -F.col(tie)) if tie else F.struct(F.col(time))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(
        key, "_r.*").select(*df.columns)


def newest_steps(grid: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the newest ``n`` steps present (not calendar days)."""
    keep = grid.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return grid.join(keep, date, "left_semi")


def filled_steps(grid: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """(date, filled): a step is filled when any cell holds a value."""
    return grid.groupBy(date).agg((F.count(C.clean(value)) > 0).alias("filled"))


def newest_filled_steps(grid: DataFrame, n: int, value: str = "value",
                        date: str = "date") -> DataFrame:
    """Dates of the newest ``n`` filled steps, walking past empty ones."""
    return (
        filled_steps(grid, value, date).where("filled").select(date)
        .orderBy(F.desc(date)).limit(n)
    )


def retain_newest(grid: DataFrame, n: int, value: str = "value", date: str = "date") -> DataFrame:
    return grid.join(newest_filled_steps(grid, n, value, date), date, "left_semi")


def prefer_final(steps: DataFrame, date: str = "date", label: str = "label") -> DataFrame:
    """One step per date; the final product beats any preliminary one."""
    return keep_last(
        steps.withColumn("_rank", F.when(F.col(label) == "final", 1).otherwise(0)),
        [date], ["_rank", label]).drop("_rank")


def thin_series(df: DataFrame, key: str = "site", day: str = "day", value: str = "value",
                cfg: SeriesConfig = SeriesConfig(), span: int = 512) -> DataFrame:
    """Keep a value once ``stride`` days have passed since the last kept; the tail is whole.

    The rule is greedy, but all that an earlier day leaves to later ones is the date before
    which nothing is kept, which reaches less than a stride into the next span of ``span`` days. So
    each span says, for each date it may be entered with, the date it hands on; per key these are
    followed from span to span, and then each span lists its own days. Arrays hold the
    days of one span, and of a key a row per span.
    """
    held = df.where(C.clean(value).isNotNull())
    days = held.select(key, day).distinct()
    ends = days.groupBy(key).agg(F.max(day).alias("_max"))
    placed = join_checked(days, ends, key).select(
        key, F.unix_date(day).alias("_d"), (F.col(day) > F.date_sub("_max", cfg.tail_days)).alias("_tail"))
    stride = max(1, cfg.stride_days)  # days are distinct, so none and one are the same
    span = max(span, stride)
    first = F.col("_span") * span

    def follow(entry):
        return F.aggregate("_days", entry.cast("int"), lambda free, d: F.when(d >= free, d + stride).otherwise(free))

    spans = placed.groupBy(key, F.floor(F.col("_d") / span).cast("int").alias("_span"), "_tail").agg(
        F.array_sort(F.collect_list("_d")).alias("_days"))
    exits = F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda late: follow(first + late))
    spans = stored_table(spans.withColumn("_exits", F.when(~F.col("_tail"), exits)), "series-spans")
    older = spans.where(~F.col("_tail"))
    route = older.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_span", "_exits"))).alias("_route"))
    free = F.aggregate("_route", F.array(F.lit(-2 ** 31)), lambda seen, s: F.concat(seen, F.array(F.get(
        s["_exits"], F.greatest(F.lit(0), F.element_at(seen, -1).cast("long") - s["_span"] * span).cast("int")))))
    entered = route.select(key, free.alias("_free"), F.posexplode("_route").alias("_at", "_s")).select(
        key, F.col("_s._span").alias("_span"), F.get("_free", F.col("_at")).alias("_entry"))
    kept = F.aggregate("_days", F.array().cast("array<int>"), lambda seen, d: F.when(
        d >= F.coalesce(F.try_element_at(seen, F.lit(-1)) + stride, F.col("_entry")), F.concat(seen, F.array(d))).otherwise(seen))
    keep = older.join(entered, [key, "_span"]).select(key, kept.alias("_days")).unionByName(spans.where("_tail").select(key, "_days"))
    keep = keep.select(key, F.explode("_days").alias("_d")).select(key, F.date_from_unix_date("_d").alias(day))
    return held.join(keep, [key, day], "left_semi")


def break_gaps(df: DataFrame, key: str = "site", day: str = "day", value: str = "value",
               cfg: SeriesConfig = SeriesConfig()) -> DataFrame:
    """Insert a null marker the day after the last sample before a long gap."""
    following = chunked.with_next(
        df.select(key, day, value), [key], [day], [day], "next", seconds=366 * 86_400)
    long_gap = F.datediff(F.col(f"next.{day}"), F.col(day)) > cfg.break_days
    row = F.struct(F.col(day).alias(day), F.col(value).alias(value))
    marker = F.struct(F.date_add(day, 1).alias(day), F.lit(None).cast("double").alias(value))
    return following.select(key, F.explode(
        F.when(long_gap, F.array(row, marker)).otherwise(F.array(row))).alias("r")
    ).select(key, "r.*")


def every_nth(df: DataFrame, n: int, key: str, order: Sequence[str],
              seconds: int | None = None) -> DataFrame:
    """First, (n+1)th, (2n+1)th ... record per key."""
    numbered = chunked.with_row_number(df, [key], order, "_row", seconds)
    return numbered.where((F.col("_row") - 1) % n == 0).drop("_row")


def axis_stride(axis: DataFrame, index: str, max_size: int) -> DataFrame:
    """Every k-th index of an axis so that about ``max_size`` remain: k = max(1, len // max)."""
    length = axis.agg(F.count(F.lit(1)).alias("n")).scalar()
    step = F.greatest(F.lit(1).cast("long"), F.floor(length / max_size).cast("long"))
    return axis.where(F.col(index) % step == 0)


def trailing_own(df: DataFrame, days: float, key: str = "deployment", time: str = "time",
                 strict: bool = False) -> DataFrame:
    """Rows within ``days`` of the key's own latest time."""
    last = df.groupBy(key).agg(F.max(time).alias("_last"))
    edge = C.micros("_last") - F.lit(int(days * 86_400_000_000))
    at = C.micros(time)
    return df.join(last, key).where(at > edge if strict else at >= edge).drop("_last")


def trailing_now(df: DataFrame, now, days: float, time: str = "time") -> DataFrame:
    return df.where(C.since(time, now, days))


def calendar_chunks(spans: DataFrame, key: str, start: str, end: str, years: int = 1) -> DataFrame:
    """Split [start, end] into year-long spans that do not overlap, oldest first."""
    begins = F.sequence(F.col(start), F.col(end), F.expr(f"interval {years} year"))
    return spans.select(key, F.col(end).alias("_end"), F.posexplode(begins).alias("chunk", "chunk_start")
                        ).select(key, "chunk", "chunk_start", F.least(
                            F.date_sub(F.add_months("chunk_start", 12 * years), 1), "_end").alias("chunk_end"))


def active_platforms(df: DataFrame, now, variable: str, cfg: Recency = Recency()) -> DataFrame:
    """Held positions out, recent window, required fields, at least two points each.

    The order is part of the meaning: a held run is diagnosed on the whole record.
    """
    moving = mask_held_positions(df, max_hold_hours=cfg.max_hold_hours)
    recent = trailing_now(moving, now, cfg.active_days)
    whole = require(recent, ["longitude", "latitude", "depth", variable])
    enough = whole.groupBy("deployment").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= cfg.min_points).select("deployment")
    return whole.join(enough, "deployment", "left_semi").withColumn(
        "longitude", C.lon_180("longitude"))


def min_points(df: DataFrame, key: str = "deployment", least: int = 2) -> DataFrame:
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(enough.select(key), key, "left_semi")


def month_order_checks(monthly: DataFrame, key: str = "site", month: str = "month") -> DataFrame:
    """Whether the months of each key are contiguous (a few hundred rows per key)."""
    w = W.partitionBy(key).orderBy(month)
    step = F.months_between(F.col(month), F.lag(month).over(w))
    return monthly.select(key, step.alias("_s")).groupBy(key).agg(
        F.bool_and(F.coalesce(F.col("_s") == 1, F.lit(True))).alias("contiguous"))


def depth_places(rows: DataFrame, key: str = "site", depth: str = "depth") -> DataFrame:
    """Places in depth order, unknown depths first, and from the deepest up, unknown last; ties by key.

    Two sorts of the whole, with places added from the sizes of the sorted parts, so that
    no task sees more than its part.
    """
    def placed(df: DataFrame, order, out: str) -> DataFrame:
        ranged = stored_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "depth-order")
        sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per part
        return ranged.join(before, "_part").withColumn(
            out, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")).drop("_part", "_before")

    up = placed(rows, [F.col(depth).asc_nulls_first(), F.col(key)], "place")
    return placed(up, [F.col(depth).desc_nulls_last(), F.col(key)], "from_below")


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of single deployments, sites or steps as one.

    A column that some frames lack is null in their rows. A column of different types in two
    frames is an error, not a cast. No frame gives no rows and is an error, as it has no columns.
    """
    if not frames:
        raise ValueError("nothing to unite")
    kinds: dict[str, str] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is {kinds[name]} in one frame and {kind} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
