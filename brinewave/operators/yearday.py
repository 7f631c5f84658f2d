"""Day-of-year climatology and the scoring of readings against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import DEFAULT_SCALE, YeardayConfig
from brinewave.functions import columns as C
from brinewave.operators.quantile import build_pool, group_quantiles, held_in, pool_quantiles
from brinewave.operators.sizing import BROADCAST_ROWS, join_checked, measured
from brinewave.session import cut_lineage, stored_table


def _day_stats(df, key, time, value):
    """Sufficient statistics per (key, yearday, year): what fans out is 365 rows a year."""
    v = F.col(value)
    return (
        df.where(C.clean(value).isNotNull())
        .groupBy(key, C.yearday(time).alias("_yd"), F.year(time).alias("_year"))
        .agg(F.count(v).alias("_n"), F.avg(v).alias("_m"),
             F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("_ss"))
    )


def _pool(df, key, time, value, window_days, ranks):
    return build_pool(df, [key], value, C.yearday(time), 365,
                      lambda c: C.circular_days(c, window_days), ranks)


def pooled_moments(df: DataFrame, key: str = "site", time: str = "time", value: str = "value",
                   cfg: YeardayConfig = YeardayConfig()) -> DataFrame:
    """(key, yearday, mean, sd, n, n_years) per circular window, all 365 days.

    Moments combine from per-day means and squared deviations about a per-key centre, so
    the raw rows are read once and only the daily statistics are copied.
    """
    stats = cut_lineage(_day_stats(df, key, time, value))
    centre = stats.groupBy(key).agg(
        (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_c"))
    offset = F.col("_m") - F.col("_c")
    fanned = (
        stats.join(centre, key)
        .withColumn("_d", offset)
        .withColumn("yearday", F.explode(C.circular_days("_yd", cfg.window_days)))
    )
    pooled = fanned.groupBy(key, "yearday").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_d")).alias("_s1"),
        F.sum(F.col("_ss") + F.col("_n") * F.col("_d") * F.col("_d")).alias("_s2"),
        F.first("_c").alias("_c"), F.countDistinct("_year").alias("n_years"))
    n = F.col("n")
    pooled = pooled.select(
        key, "yearday", "n", "n_years",
        (F.col("_c") + F.col("_s1") / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(
            F.lit(0.0), (F.col("_s2") - F.col("_s1") * F.col("_s1") / n) / (n - 1)))).alias("sd"))
    days = centre.select(key, F.explode(F.sequence(F.lit(1), F.lit(365))).alias("yearday"))
    out = days.join(pooled, [key, "yearday"], "left").fillna(0, ["n", "n_years"])
    enough = F.col("n_years") >= cfg.min_years
    return out.select(
        key, "yearday", F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, F.col("sd")).alias("sd"), F.col("n").cast("long").alias("n"),
        F.col("n_years").cast("long").alias("n_years"))


def smooth(clim: DataFrame, key: str = "site", days: int = 5) -> DataFrame:
    """Circular moving average of mean and sd, only where all 365 days have a mean."""
    if days <= 1:
        return clim
    if days % 2 == 0:
        raise ValueError("an odd number of days is needed")
    clim = cut_lineage(clim)
    whole = F.count("mean").over(W.partitionBy(key)) == 365  # 365 rows per key
    near = (
        clim.select(key, F.explode(C.circular_days("yearday", days // 2)).alias("yearday"),
                    "mean", "sd")
        .groupBy(key, "yearday")
        .agg(F.avg("mean").alias("_mean"), F.when(F.count("sd") == days, F.avg("sd")).alias("_sd"))
    )
    return (
        clim.withColumn("_whole", whole).join(near, [key, "yearday"])
        .withColumn("mean", F.when(F.col("_whole"), F.col("_mean")).otherwise(F.col("mean")))
        .withColumn("sd", F.when(F.col("_whole"), F.col("_sd")).otherwise(F.col("sd")))
        .drop("_mean", "_sd", "_whole")
    )


def with_bounds(clim: DataFrame) -> DataFrame:
    return clim.withColumns({
        f"{side}{k}": F.col("mean") + sign * k * F.col("sd")
        for k in (1, 2) for side, sign in (("lo", -1), ("hi", 1))})


def build_climatology(df: DataFrame, key: str = "site", time: str = "time",
                      value: str = "value", cfg: YeardayConfig = YeardayConfig(),
                      percentiles: bool = True) -> DataFrame:
    """365 rows per key: smoothed mean and sd with bounds, support, unsmoothed percentiles."""
    moments = pooled_moments(df, key, time, value, cfg)
    clim = with_bounds(smooth(moments, key, cfg.smooth_days))
    if not percentiles:
        return clim
    pool = _pool(df, key, time, value, cfg.window_days, 2 * len(cfg.percentiles))
    ranked = pool_quantiles(pool, [p / 100 for p in cfg.percentiles]).select(
        key, F.col("_t").alias("yearday"), "q")
    enough = F.col("n_years") >= cfg.min_years
    return clim.join(ranked, [key, "yearday"], "left").withColumns({
        f"p{p:02d}": F.when(enough, F.element_at("q", i + 1))
        for i, p in enumerate(cfg.percentiles)}).drop("q")


def classify_series(clim: DataFrame, obs: DataFrame, key: str = "site", time: str = "time",
                    value: str = "value") -> DataFrame:
    """Score every observation; without a climatology the band is 2 and ``scored`` is false."""
    ref = clim.select(key, "yearday", F.col("mean").alias("clim_mean"), F.col("sd").alias("clim_sd"))
    z = F.col("anomaly") / F.nullif(F.col("clim_sd"), F.lit(0.0))
    return (
        join_checked(obs.withColumn("yearday", C.yearday(time)), ref, [key, "yearday"], "left")
        .withColumn("anomaly", F.col(value) - F.col("clim_mean"))
        .withColumn("z", z)
        .withColumn("band", C.sigma_band("z"))
        .withColumn("label", C.sigma_label("z"))
        .withColumn("scored", F.col("z").isNotNull())
    )


def score_readings(readings: DataFrame, clim: DataFrame, obs: DataFrame, key: str = "site",
                   time: str = "time", value: str = "value",
                   window_days: int = 7, strict: bool = True, repeated: str | None = None) -> DataFrame:
    """Score readings with anomaly, z, band, and percentile rank in the pooled window.

    ``readings`` needs ``reading_id``. A reading without a usable climatology is an error
    when its row is evaluated; without ``strict`` it keeps a null score. The rank reads the
    record once for all readings. Rows that share an id each have the ranks of all of them;
    ``repeated`` names a column that is true for every such row, where the caller knows them.
    """
    ref = clim.select(key, "yearday", F.col("mean").alias("clim_mean"), F.col("sd").alias("clim_sd"),
                      "lo1", "hi1", "lo2", "hi2")
    unusable = F.raise_error(F.format_string("no usable climatology for yearday %d", "yearday")) if strict else F.lit(None)
    return (
        join_checked(window_rank(readings, obs, key, time, value, window_days, repeated=repeated).withColumn("yearday", C.yearday(time)), ref, [key, "yearday"], "left")
        .withColumn("clim_sd", F.when(F.col("clim_sd") > 0, F.col("clim_sd")).otherwise(unusable.cast("double")))
        .withColumn("anomaly", F.col(value) - F.col("clim_mean"))
        .withColumn("z", F.col("anomaly") / F.col("clim_sd"))
        .withColumn("band", C.sigma_band("z"))
        .withColumn("label", C.sigma_label("z"))
    )


RANK = ("percentile", "n_compared", "window_min", "window_max")


def window_rank(readings: DataFrame, obs: DataFrame, key: str = "site", time: str = "time", value: str = "value",
                window_days: int = 7, most: int = DEFAULT_SCALE.chunk_rows, repeated: str | None = None) -> DataFrame:
    """``readings`` with percentile, n_compared, window_min and window_max, null where nothing can be ranked; see ``by_id``.

    Readings and history are never paired value by value. Both are placed in the value cells
    of the key: lower cells count as a whole through a prefix sum, and only rows in a
    reading's own cell are fetched and ordered with it. The readings are placed and stored once,
    then travel to their cell, and are joined with nothing large after; a cell of more than
    ``most`` readings is shared by several tasks, each with the history of the cell.
    """
    pool = _pool(obs, key, time, value, window_days, 2)
    placed = pool.place(readings.withColumns({"_t": C.yearday(time), "_v": F.col(value)}), "left").drop("_v")
    placed = stored_table(placed, "readings").withColumn("_v", F.col(value))
    ids, n_ids = shared_ids(placed.where(repeated) if repeated else placed)
    usable = F.col("reading_id").isNotNull() & F.col("_t").isNotNull() & F.col("_v").isNotNull() & F.col("_b").isNotNull()
    cell = [key, "_t", "_b"]
    asked, n_asked = measured(placed.where(usable).groupBy(*cell).agg(F.count(F.lit(1)).alias("_asked")))
    days = asked.select(key, "_t").distinct()
    cells = pool.cells.join(days, [key, "_t"], "left_semi")
    totals = cells.groupBy(key, "_t").agg(F.sum("_c").alias("n_compared"), F.min("_min").alias("window_min"),
                                          F.max("_max").alias("window_max"))
    base = (
        cells.select(*cell, "_c").unionByName(asked.select(*cell, F.lit(0).cast("long").alias("_c")))
        .groupBy(*cell).agg(F.sum("_c").alias("_c"))
        .withColumn("_c", F.sum("_c").over(W.partitionBy(key, "_t").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c"))
    ).join(asked, cell, "left_semi")
    lower = base.withColumn("_v", F.lit(None).cast("double")).unionByName(held_in(pool, asked, n_asked))
    # shares of a cell: 0, further ones for the readings of a crowded cell, negative ones for what has no rank
    crowded, n_crowded = measured(asked.where(F.col("_asked") > most).select(*cell, F.ceil(F.col("_asked") / most).cast("int").alias("_shares")))
    share = F.lit(0)
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
        lower = lower.join(crowded, cell, "left").withColumn(
            "_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
        placed = placed.join(crowded, cell, "left")
        share = F.pmod(F.xxhash64("reading_id"), F.coalesce("_shares", F.lit(1))).cast("int")
    else:
        lower = lower.withColumn("_share", F.lit(0))
    spare = -1 - F.pmod(F.xxhash64(*readings.columns), F.lit(1 << 16)).cast("int")
    placed = placed.withColumn("_share", F.when(usable, share).otherwise(spare)).withColumn("_usable", usable).drop("_shares")
    # the history of a value follows the readings equal to it, and is not below them
    near = placed.withColumns({"_c": F.lit(0).cast("long"), "_held": F.lit(False)}).unionByName(
        lower.withColumn("_held", F.col("_v").isNotNull()), allowMissingColumns=True)
    # a number leads the order of the rows, as the texts of keys are slow to compare; mostly it stands for the cell
    number = [F.xxhash64(*cell)] if hashes_apart(asked, cell) else [F.xxhash64(*cell), *cell]
    upto = W.partitionBy(*number, "_share").orderBy(F.col("_v") + F.lit(0.0), "_held").rowsBetween(W.unboundedPreceding, 0)
    ranked = near.withColumn("_below", F.sum("_c").over(upto)).where(F.col("_usable").isNotNull())
    out = join_checked(ranked, totals, [key, "_t"], "left").withColumn("percentile", F.col("_below") / F.col("n_compared") * 100)
    out = out.select(*readings.columns, *[F.when(F.col("_usable"), F.col(c)).alias(c) for c in RANK])
    return by_id(out, ids, n_ids) if n_ids else out


def hashes_apart(cells: DataFrame, by: list[str]) -> bool:
    """Whether no two of the (distinct) cells have the same hash."""
    return cells.groupBy(F.xxhash64(*by).alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def shared_ids(readings: DataFrame) -> tuple[DataFrame, int]:
    """Hashes of ids that more than one reading has, and how many there are."""
    counts = readings.groupBy(F.xxhash64("reading_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return measured(counts.where("_n > 1").select("_id"))


def by_id(ranked: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """``ranked`` as if its ranks were joined to its readings by id; only the ``n`` shared ids (or hashes) need it."""
    shared = F.broadcast(shared) if n <= BROADCAST_ROWS else shared
    held = cut_lineage(ranked.withColumn("_id", F.xxhash64("reading_id")))
    several = held.join(shared, "_id", "left_semi").drop("_id")
    ranks = several.where(F.col("n_compared").isNotNull()).select("reading_id", *RANK)
    return held.join(shared, "_id", "left_anti").drop("_id").unionByName(several.drop(*RANK).join(ranks, "reading_id", "left"))


def last_archived(obs: DataFrame, key: str = "site", time: str = "time",
                  value: str = "value") -> DataFrame:
    """The newest value of each key, the largest of equal times, and its time."""
    return obs.where(C.clean(value).isNotNull()).groupBy(key).agg(
        F.max_by(value, F.struct(time, value)).alias("archived_last"), F.max(time).alias("archived_time"))


def score_table(readings: DataFrame, clim: DataFrame, obs: DataFrame, sites: DataFrame, key: str = "site", time: str = "time",
                value: str = "value", window_days: int = 7, strict: bool = True, repeated: str | None = None) -> DataFrame:
    """What a reader of scores sees: a row per reading, with the normal range and what the archive last held.

    ``sites`` has (key, depth). Columns: reading_id, key, depth, time, reading, clim_mean, sd,
    lo1, hi1, lo2, hi2, anomaly, z, percentile, verdict, archived_last, archived_time, and
    ``place``: that of the site from the surface down, sites without a depth first.
    """
    from pyspark.sql import Window

    # one row per site: the order is over sites, not over readings
    placed = sites.select(key, "depth").withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("depth"), key)))
    scored = score_readings(readings, clim, obs, key, time, value, window_days, strict, repeated)
    out = join_checked(scored, last_archived(obs, key, time, value), key, "left")
    out = join_checked(out, placed, key, "left")
    return out.select("reading_id", key, "depth", "place", time, F.col(value).alias("reading"), "clim_mean", F.col("clim_sd").alias("sd"),
                      "lo1", "hi1", "lo2", "hi2", "anomaly", "z", "percentile", F.col("label").alias("verdict"), "archived_last", "archived_time")


def drift(readings: DataFrame, obs: DataFrame, key: str = "site", time: str = "time",
          value: str = "value", recent_days: int = 7, limit: float = 0.1) -> DataFrame:
    """Readings that differ from a still current archive by more than ``limit``."""
    last = last_archived(obs, key, time, value)
    return readings.join(last, key).where(
        (F.col("archived_time") > F.col(time) - F.expr(f"interval {recent_days} days"))
        & (F.abs(F.col(value) - F.col("archived_last")) > limit))


def band_shares(scored: DataFrame, key: str = "site") -> DataFrame:
    """(key, band, n, pct): where a record falls relative to its own climatology."""
    totals = scored.groupBy(key).agg(*[
        F.count_if(F.col("band") == b).alias(f"_b{b}") for b in (0, 1, 2)])
    total = F.col("_b0") + F.col("_b1") + F.col("_b2")
    return totals.select(key, F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"_b{b}").alias("n"),
                 (F.col(f"_b{b}") / total * 100).alias("pct")) for b in (0, 1, 2)])).alias("r")
    ).select(key, "r.*").where(F.col("n") > 0)


def seasonal_extremes(clim: DataFrame, key: str = "site") -> DataFrame:
    """Coldest and warmest day, amplitude, spread and support.

    Means equal to nine places are ties and go to the earlier day, so that the order in
    which floats were added does not decide.
    """
    level = F.round("mean", 9)
    cold = F.when(level.isNotNull(), F.struct(level.alias("m"), F.col("yearday")))
    warm = F.when(level.isNotNull(), F.struct(level.alias("m"), -F.col("yearday")))
    return clim.groupBy(key).agg(
        F.min_by("yearday", cold).alias("coldest_day"), F.min("mean").alias("coldest"),
        F.max_by("yearday", warm).alias("warmest_day"), F.max("mean").alias("warmest"),
        (F.max("mean") - F.min("mean")).alias("amplitude"),
        F.min("sd").alias("sd_min"), F.max("sd").alias("sd_max"),
        F.percentile("sd", 0.5).alias("sd_median"),  # 365 rows per key
        F.min("n").alias("n_min"), F.max("n").alias("n_max"),
        F.min("n_years").alias("years_min"), F.max("n_years").alias("years_max"))


def monthly_z(scored: DataFrame, key: str = "site", time: str = "time") -> DataFrame:
    return scored.groupBy(key, C.month_start(time).alias("month")).agg(F.avg("z").alias("z"))


def overlay_year(df: DataFrame, key: str = "site", time: str = "time",
                 min_days: int = 200) -> DataFrame:
    """Latest year with enough distinct days, else the last year."""
    days = df.select(key, F.to_date(time).alias("_d")).distinct()
    years = days.groupBy(key, F.year("_d").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    return years.groupBy(key).agg(F.coalesce(
        F.max(F.when(F.col("_n") >= min_days, F.col("_y"))), F.max("_y")).alias("overlay_year"))


def site_position(rows: DataFrame, key: str = "site") -> DataFrame:
    """Median position and water depth of a mooring; longitude is written west-positive."""
    def median(name, out):
        return group_quantiles(rows, [key], name, [0.5]).select(
            key, F.element_at("q", 1).alias(out))

    return (
        median("lat", "lat").join(median("lon", "_lon"), key).join(median("depth", "water_depth"), key)
        .select(key, "lat", C.west_positive("_lon").alias("lon"), "water_depth")
    )
