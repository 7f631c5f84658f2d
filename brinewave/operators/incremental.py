"""Idempotent incremental ingest: marks, anti-replay, upsert, change gate, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.functions import columns as C
from brinewave.operators.profile import high_water_marks
from brinewave.operators.screening import gross_range
from brinewave.operators.sequences import keep_last
from brinewave.operators.sizing import join_checked


def after_marks(df: DataFrame, marks: DataFrame, key: str = "deployment", time: str = "time",
                lateness_seconds: float = 0.0) -> DataFrame:
    """Rows strictly newer than the stored mark of their own deployment.

    A deployment without a mark passes whole. ``lateness_seconds`` moves the mark back.
    Marks are one row per deployment; the side is broadcast only if it turns out small.
    """
    edge = C.micros("_mark") - F.lit(int(lateness_seconds * 1_000_000))
    return join_checked(df, marks.select(key, F.col("mark").alias("_mark")), key, "left").where(
        F.col("_mark").isNull() | (C.micros(time) > edge)).drop("_mark")


def fresh_rows(landed: DataFrame, archive: DataFrame | None, order=("latitude", "longitude"),
               lateness_seconds: float = 0.0) -> DataFrame:
    """What an update would append to the rows held: new by mark, screened, one per (deployment, time, depth)."""
    marks = None if archive is None else high_water_marks(archive)
    return newer_rows(landed, marks, order, lateness_seconds)


def newer_rows(landed: DataFrame, marks: DataFrame | None, order=("latitude", "longitude"),
               lateness_seconds: float = 0.0) -> DataFrame:
    """What an update would append after these marks.

    Anti-replay reads two columns only, so it goes first; the rows are the same.
    """
    from brinewave.operators.sequences import dedup_observations

    new = landed if marks is None else after_marks(landed, marks, lateness_seconds=lateness_seconds)
    return dedup_observations(gross_range(new), list(order))


def update_archive(spark: SparkSession, landed: DataFrame, path: str, mode: str,
                   lateness_seconds: float = 0.0) -> dict:
    """Bring the archive at ``path`` up to date; a second run appends nothing.

    Marks and totals come from the log beside the archive (``sources.marks``), one small
    table; the archive itself is not scanned. A missed run is back-filled by the next one.
    """
    from brinewave.session import cut_lineage
    from brinewave.sources import marks as log
    from brinewave.sources.archive import append_archive

    held = cut_lineage(log.read_marks(spark, path, mode))
    fresh = cut_lineage(newer_rows(landed, held, lateness_seconds=lateness_seconds))
    added = cut_lineage(log.marks_of(fresh))
    appended = added.agg(F.sum("rows").alias("n")).first()["n"] or 0
    if appended:
        number = log.begin(spark, path, mode)
        append_archive(spark, path, fresh, mode)
        log.commit(spark, path, mode, number, added)
    total = (held.agg(F.sum("rows").alias("n")).first()["n"] or 0) + appended
    return {"mode": mode, "path": path, "appended": appended, "total": total}


def upsert(base: DataFrame, fresh: DataFrame, keys, value: str = "value") -> DataFrame:
    """Union where the fresh source wins on a shared key; fresh nulls never overwrite."""
    new = fresh.where(C.clean(value).isNotNull())
    both = base.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return keep_last(both, list(keys), ["_src", value]).drop("_src")


def missing_chunks(spans: DataFrame, held: DataFrame, key: str, date: str = "date",
                   stride_days: int = 7) -> DataFrame:
    """Chunks with at least one expected date that is not held: (key, chunk, missing)."""
    expected = spans.select(key, "chunk", F.explode(F.sequence(
        F.col("chunk_start"), F.col("chunk_end"), F.expr(f"interval {stride_days} days"))).alias(date))
    return expected.join(held.select(key, date).distinct(), [key, date], "left_anti").groupBy(key, "chunk").agg(
        F.count(F.lit(1)).alias("missing"))


def stale_steps(wanted: DataFrame, held: DataFrame, date: str = "date",
                label: str = "label") -> DataFrame:
    """Dates whose label differs, is missing or is no longer wanted; empty = current."""
    a = wanted.select(date, F.col(label).alias("wanted"))
    b = held.select(date, F.col(label).alias("held"))
    return a.join(b, date, "full").where(~F.col("wanted").eqNullSafe(F.col("held")))


def _row_hash(df: DataFrame, ignore) -> Column:
    names = sorted(c for c in df.columns if c not in ignore)
    return F.xxhash64(*[F.to_json(F.struct(F.col(n))) for n in names])


def _folded(h: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("_x"),
            F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("_s")]


def content_hash(df: DataFrame, ignore=("updated",)) -> DataFrame:
    """Order-free fingerprint of the rows without the ignored columns: (n, fingerprint)."""
    return df.agg(*_folded(_row_hash(df, ignore))).select("n", F.concat_ws("-", "_x", "_s").alias("fingerprint"))


def partition_hashes(df: DataFrame, part: Column, name: str, ignore=("updated",)) -> DataFrame:
    """(name, n, fingerprint): the fingerprint of each partition, to be stored with a publication.

    Two publications are compared by these few rows; only partitions whose fingerprints
    differ need their rows compared (``changed_rows``).
    """
    return df.groupBy(part.alias(name)).agg(*_folded(_row_hash(df, ignore))).select(name, "n", F.concat_ws("-", "_x", "_s").alias("fingerprint"))


def compared_partitions(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(name, n, same): every partition of either side, with its rows now and whether they are those of before."""
    a = before.select(F.col(name).alias("_part"), F.lit(True).alias("_before"), F.col("fingerprint").alias("_old"))
    b = after.select(F.col(name).alias("_own"), "n", "fingerprint")
    both = a.join(b, F.col("_part").eqNullSafe(F.col("_own")), "full")
    same = F.coalesce("_before", F.lit(False)) & F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(False))
    return both.select(F.coalesce("_own", "_part").alias(name), F.coalesce("n", F.lit(0)).alias("n"), same.alias("same"))


def changed_rows(previous: DataFrame, current: DataFrame, ignore=("updated",)) -> DataFrame:
    """Rows that appeared or vanished, comparing everything but the ignored columns."""
    names = [c for c in current.columns if c not in ignore]
    a, b = previous.select(*names), current.select(*names)
    return b.exceptAll(a).withColumn("side", F.lit("appeared")).unionByName(
        a.exceptAll(b).withColumn("side", F.lit("vanished")))


def has_changed(previous: DataFrame, current: DataFrame, ignore=("updated",)) -> bool:
    return not changed_rows(previous, current, ignore).isEmpty()


def by_mode(observations: DataFrame, mode: str) -> DataFrame:
    """One feed at a time; the feeds are never blended."""
    if mode not in ("realtime", "delayed", "live"):
        raise ValueError(f"unknown mode {mode!r}")
    delayed = C.is_delayed("deployment")
    return observations.where(delayed if mode == "delayed" else ~delayed)
