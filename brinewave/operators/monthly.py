"""Calendar-month climatology, anomalies, exceedance and comparison of two sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import Completeness, Thresholds
from brinewave.functions import columns as C
from brinewave.operators.resample import to_monthly


def climatology(monthly: DataFrame, key: str = "site") -> DataFrame:
    """(key, calendar_month, clim, std, n_years): twelve rows per key, usable months only."""
    by_month = monthly.withColumn("calendar_month", F.month("month"))
    use = F.col("ok")
    stats = by_month.groupBy(key, "calendar_month").agg(
        F.avg(F.when(use, F.col("value"))).alias("clim"),
        F.stddev_samp(F.when(use, F.col("value"))).alias("std"),
        F.count_if(use).alias("_n"))
    twelve = monthly.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("calendar_month"))
    return twelve.join(stats, [key, "calendar_month"], "left").select(
        key, "calendar_month", "clim", "std",
        F.when(F.col("_n") > 0, F.col("_n")).alias("n_years"))


def anomalies(monthly: DataFrame, clim: DataFrame | None = None, key: str = "site") -> DataFrame:
    """Add ``clim`` and ``anom``; months that are not usable keep a null anomaly.

    Without a given climatology it is taken in place: the months of one record are few
    (a thousand in a century), so one exchange on the key serves all windows over them.
    """
    if clim is None:
        same_month = W.partitionBy(key, F.month("month"))
        return monthly.repartition(key).withColumn(
            "clim", F.avg(F.when(F.col("ok"), F.col("value"))).over(same_month)).withColumn(
            "anom", F.col("value") - F.col("clim"))
    return (
        monthly.withColumn("calendar_month", F.month("month"))
        .join(clim.select(key, "calendar_month", "clim"), [key, "calendar_month"], "left")
        .withColumn("anom", F.col("value") - F.col("clim"))
        .drop("calendar_month")
    )


def thresholds(anom: DataFrame, key: str = "site", cfg: Thresholds = Thresholds()) -> DataFrame:
    """(key, p90, p95, ...) over the whole record.

    A group is the months of one record, a few thousand at most, so the built-in exact
    percentile is bounded here.
    """
    probs = F.array(*[F.lit(p / 100) for p in cfg.percentiles])
    rolled = anom.groupBy(key).agg(F.percentile("anom", probs).alias("_q"))
    return rolled.select(key, *[
        F.element_at("_q", i + 1).alias(f"p{p}") for i, p in enumerate(cfg.percentiles)])


def exceedances(anom: DataFrame, thr: DataFrame | None = None, key: str = "site",
                cfg: Thresholds = Thresholds()) -> DataFrame:
    """Strict exceedance flags per threshold and the severest class.

    Thresholds not given are taken over the record itself, in the same exchange.
    """
    if thr is None:
        probs = F.array(*[F.lit(p / 100) for p in cfg.percentiles])
        out = anom.withColumn("_q", F.percentile("anom", probs).over(W.partitionBy(key))).withColumns({
            f"p{p}": F.element_at("_q", i + 1) for i, p in enumerate(cfg.percentiles)}).drop("_q")
    else:
        out = anom.join(thr, key, "left")
    out = out.withColumns({
        f"exceeds_p{p}": F.coalesce(F.col("anom") > F.col(f"p{p}"), F.lit(False))
        for p in cfg.percentiles})
    return out.withColumn(
        "severity", C.severest("anom", {p: F.col(f"p{p}") for p in cfg.percentiles}))


def common_baseline(monthly: DataFrame, site_a: str, site_b: str, key: str = "site") -> DataFrame:
    """Two sites on the months usable at both: (month, anom_a, anom_b), plus clims."""
    def one(site, tag):
        return monthly.where(F.col(key) == site).select(
            "month", F.col("value").alias(f"value_{tag}"), F.col("ok").alias(f"ok_{tag}"))

    paired = one(site_a, "a").join(one(site_b, "b"), "month")
    both = F.col("ok_a") & F.col("ok_b")
    long = paired.withColumn("ok", both).select(
        "month", "ok", F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.when(both, F.col("value_a")).alias("value")),
            F.struct(F.lit("b").alias("side"), F.when(both, F.col("value_b")).alias("value")),
        )).alias("r")).select("month", "ok", "r.side", "r.value")
    rebased = anomalies(long, key="side")
    return rebased.groupBy("month").agg(
        F.max(F.when(F.col("side") == "a", F.col("anom"))).alias("anom_a"),
        F.max(F.when(F.col("side") == "b", F.col("anom"))).alias("anom_b"),
        F.bool_and("ok").alias("ok"))


def joint_anomalies(anom: DataFrame, site_a: str, site_b: str, key: str = "site") -> DataFrame:
    """Inner join of two sites' anomalies on month, nulls dropped."""
    a = anom.where(F.col(key) == site_a).select("month", F.col("anom").alias("anom_a"))
    b = anom.where(F.col(key) == site_b).select("month", F.col("anom").alias("anom_b"))
    return a.join(b, "month").dropna(subset=["anom_a", "anom_b"])


def correlation(joint: DataFrame) -> DataFrame:
    return joint.agg(F.count(F.lit(1)).alias("n_common"), F.corr("anom_a", "anom_b").alias("r"))


def series_anomalies(daily: DataFrame, key: str = "site", rule: Completeness = Completeness(),
                     partial_in_baseline: bool = False) -> DataFrame:
    """Monthly anomalies with the unfinished month shown.

    By default that month does not count: it is outside the climatology and the
    thresholds. ``partial_in_baseline=True`` lets it in.
    """
    keep = Completeness(rule.min_hours, rule.min_days, drop_partial_end=False)
    full = to_monthly(daily, key, keep)
    ends = daily.groupBy(key).agg(F.max("day").alias("_last"))
    unfinished = F.month(F.date_add("_last", 1)) == F.month("_last")
    full = (
        full.join(ends, key)
        .withColumn("partial", (F.col("month") == C.month_start("_last")) & unfinished)
        .drop("_last")
    )
    base = full if partial_in_baseline else full.where(~F.col("partial"))
    return anomalies(full, climatology(base, key), key)


def series_thresholds(anom: DataFrame, key: str = "site", partial_in_baseline: bool = False,
                      cfg: Thresholds = Thresholds()) -> DataFrame:
    base = anom if partial_in_baseline else anom.where(~F.col("partial"))
    return thresholds(base, key, cfg)


def shared_limit(anom: DataFrame) -> DataFrame:
    """One symmetric limit for all series."""
    return anom.agg((F.max(F.abs("anom")) * 1.15).alias("limit"))


def thin_months(monthly: DataFrame, key: str = "site", fewer_than: int = 10) -> DataFrame:
    """How many usable months rest on few values."""
    return monthly.groupBy(key).agg(
        F.count_if(F.col("ok")).alias("usable"),
        F.count_if(F.col("ok") & (F.col("n") < fewer_than)).alias("thin"))


def record_text(daily: DataFrame, clim: DataFrame, key: str = "site") -> DataFrame:
    """Record span and the baseline sentence; calendar months without data count as 0."""
    span = daily.where(F.col("value").isNotNull()).groupBy(key).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"))
    years = clim.groupBy(key).agg(
        F.min(F.coalesce("n_years", F.lit(0))).alias("_lo"),
        F.max(F.coalesce("n_years", F.lit(0))).alias("_hi"))
    return span.join(years, key).select(
        key, "first_day", "last_day", "n_days",
        F.format_string("%s to %s, %d-%d years per calendar month",
                        F.col("first_day").cast("string"), F.col("last_day").cast("string"),
                        F.col("_lo"), F.col("_hi")).alias("baseline"))
