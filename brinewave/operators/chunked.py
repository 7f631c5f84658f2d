"""Sequence operators that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task. Here a key is
cut along time into chunks; the window runs per (key, chunk), and the little that has to
cross a chunk boundary (the neighbouring row, or a prefix total) travels through a
summary with one row per chunk. The result equals the uncut window. Unless it is given, the
width of a chunk comes from counts, so that dense rows make narrower chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import DEFAULT_SCALE
from brinewave.session import stored_table

CHUNK = "_chunk"
PART = "_part"


def range_parts(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows in sorted parts of about equal size, numbered by ``_part``, for an order that is not time.

    Parts are cut by a sample of the whole order, so a key of any size is spread over many;
    rows that are equal in ``order`` share a part. Stored, so that the numbers stay.
    """
    by = [F.col(o) for o in order]
    cut = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored_table(cut.withColumn(PART, F.spark_partition_id()), "range-parts")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a null key equals a null key, as it does in a window."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"_k_{k}" for k in keys])


def time_chunk(time: str | Column, seconds: int) -> Column:
    c = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def width_for(df: DataFrame, keys: Sequence[str], time: str, widths: Sequence[int] = DEFAULT_SCALE.chunk_widths,
              rows: int = DEFAULT_SCALE.chunk_rows) -> int:
    """The widest of ``widths`` (seconds) in which no key has more than ``rows`` rows, else the narrowest.

    The driver sees one number per width tried; nearly always the first will do.
    """
    for seconds in widths[:-1]:
        counts = df.groupBy(*keys, time_chunk(time, seconds).alias(CHUNK)).agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= rows:
            return seconds
    return widths[-1]


def keys_fit(df: DataFrame, keys: Sequence[str], rows: int = DEFAULT_SCALE.chunk_rows) -> bool:
    """Whether no key can have more than ``rows`` rows: none has more than the keys that share its hash."""
    shared = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    return (shared.agg(F.max("n").alias("n")).first()["n"] or 0) <= rows


def running_sum_whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """The running total in windows of whole keys, for keys that fit; null, as in chunks, without a key or a time."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = F.col(order[0]).cast("timestamp").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    return df.withColumn("_amount", amount).withColumn(out, F.sum("_amount").over(upto)).withColumn(out, F.when(placed, F.col(out))).drop("_amount")


def _neighbour(df, keys, order, values, out, seconds, forward: bool) -> DataFrame:
    keys, order = list(keys), list(order)
    seconds = seconds or width_for(df, keys, order[0])
    payload = F.struct(*[F.col(v) for v in values])
    cut = df.withColumn(CHUNK, time_chunk(order[0], seconds))
    shift = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(CHUNK)
    edge = (
        cut.groupBy(*keys, CHUNK)
        .agg(pick(payload, F.struct(*[F.col(o) for o in order])).alias("_edge"))
        .withColumn("_edge", shift("_edge").over(across))
    )
    return (
        cut.withColumn("_near", shift(payload).over(inside))
        .join(edge, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("_near", "_edge"))
        .drop("_near", "_edge", CHUNK)
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  values: Sequence[str], out: str = "prev",
                  seconds: int | None = None) -> DataFrame:
    """Add ``out``: a struct of ``values`` from the row before, within ``keys``."""
    return _neighbour(df, keys, order, values, out, seconds, forward=False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              values: Sequence[str], out: str = "next",
              seconds: int | None = None) -> DataFrame:
    return _neighbour(df, keys, order, values, out, seconds, forward=True)


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     amount: Column, out: str, seconds: int | None = None) -> DataFrame:
    """Add ``out``: inclusive running total of ``amount`` in ``order`` within ``keys``.

    Keys that fit into a chunk are not cut: rows are shuffled once, by key, and joined with nothing.
    """
    keys, order = list(keys), list(order)
    if seconds is None and keys_fit(df, keys):
        return running_sum_whole(df, keys, order, amount, out)
    seconds = seconds or width_for(df, keys, order[0])
    cut = df.withColumn(CHUNK, time_chunk(order[0], seconds)).withColumn("_amount", amount)
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    base = (
        cut.groupBy(*keys, CHUNK).agg(F.sum("_amount").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        cut.withColumn("_local", F.sum("_amount").over(inside))
        .join(base, [*keys, CHUNK], "left")
        .withColumn(out, F.col("_local") + F.col("_base"))
        .drop("_local", "_base", "_amount", CHUNK)
    )


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    out: str = "row", seconds: int | None = None) -> DataFrame:
    return with_running_sum(df, keys, order, F.lit(1).cast("long"), out, seconds)
