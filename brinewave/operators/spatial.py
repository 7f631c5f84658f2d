"""Spatial joins: cell snap, nearest within tolerance, coverage crop, product statistics.

Range conditions are always rewritten to equi-joins on integer bins, never a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import DEFAULT_SCALE, SOUND_BOX, STUDY_BOX, Box, GridConfig, HitTolerance
from brinewave.functions import columns as C
from brinewave.operators import chunked
from brinewave.operators.sizing import BROADCAST_ROWS, measured, small
from brinewave.session import stored_table


def clip_to_box(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                box: Box = STUDY_BOX) -> DataFrame:
    return df.where(C.in_box(lon, lat, box))


def snap_uniform(x, edge0: float, step: float) -> Column:
    """Index of the cell (lo, hi] that holds ``x`` on a uniform axis."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.ceil((x - F.lit(edge0)) / F.lit(step)) - 1).cast("long")


def snap_axis(points: DataFrame, edges: DataFrame, x: str, out: str) -> DataFrame:
    """Index of the cell (lo, hi] on any axis; rows outside the axis are left out.

    ``edges`` has (idx, lo, hi). Bins as wide as the mean cell turn the range into an
    equi-join: a cell lists the bins it touches, a point has one.
    """
    edges = small(edges)
    facts = edges.agg(F.avg(F.col("hi") - F.col("lo")).alias("w"), F.min("lo").alias("a")).first()
    if facts["a"] is None:  # an axis without cells holds no point
        return points.withColumn(out, F.lit(None).cast(edges.schema["idx"].dataType)).where(F.lit(False))
    width, first = F.lit(facts["w"]), F.lit(facts["a"])
    bins = edges.withColumn("_bin", F.explode(F.sequence(
        F.floor((F.col("lo") - first) / width), F.floor((F.col("hi") - first) / width)))
    ).select("_bin", F.col("idx").alias(out), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    placed = points.withColumn("_bin", F.floor((F.col(x) - first) / width))
    return placed.join(bins, "_bin").where(
        (F.col("_lo") < F.col(x)) & (F.col(x) <= F.col("_hi"))).drop("_bin", "_lo", "_hi")


def resolve_cell(points: DataFrame, lat_edges: DataFrame, lon_edges: DataFrame,
                 strict: bool = False) -> DataFrame:
    """Points with cell indices (i, j). With ``strict`` a point outside the grid is an error."""
    out = snap_axis(snap_axis(points, lat_edges, "lat", "i"), lon_edges, "lon", "j")
    if not strict:
        return out
    keys = points.columns
    return points.join(out.select(*keys, "i", "j"), keys, "left").withColumn("i", F.when(
        F.col("i").isNotNull() & F.col("j").isNotNull(), F.col("i")).otherwise(
        F.raise_error(F.format_string("(%f, %f) falls outside the grid", "lat", "lon")).cast("long")))


def nearest_index(points: DataFrame, axis: DataFrame, x: str, out: str) -> DataFrame:
    """Nearest axis centre; on a tie the lower index. ``axis`` has (idx, centre).

    Each point takes the cell of its bin between centre midpoints, so it is one range
    lookup, not a comparison with every centre.
    """
    from brinewave.operators.grid import axis_edges

    edges = small(axis_edges(axis))
    ends = edges.agg(F.min("lo").alias("a"), F.max("hi").alias("b")).first()
    inner = points.withColumn("_x", F.least(F.greatest(F.col(x), F.lit(ends["a"]).cast("double") + F.lit(1e-9)), F.lit(ends["b"]).cast("double")))
    return snap_axis(inner, edges, "_x", out).drop("_x")


#: positions a bin may hold before it is looked into by its quarters, and how often bins are quartered at most
LEAF, DEEPEST = 64, 8
_SLACK = 1e-9  # corners are products, so they are off by rounding


class _Bins:
    """Positions in square bins of side ``tol``, each side cut in four again and again where positions crowd.

    Positions are reduced to the lowest ``order`` at each. ``deepest`` is the first level
    (at least ``least_level``) at which no bin has more than ``leaf`` positions, so that work per point
    depends on the positions near it, not on how many share a square of the tolerance.
    """

    def __init__(self, targets: DataFrame, order: str, tol: float, leaf: int, least_level: int = 0):
        self.tol, self.finest = tol, tol / 4 ** DEEPEST
        spots = targets.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(order).alias("_order"))
        self.spots = stored_table(spots.withColumns({"_fx": self._fine("lon"), "_fy": self._fine("lat")}), "spots")
        self.deepest = least_level
        while self.deepest < DEEPEST and self._crowd(self.deepest) > leaf:
            self.deepest += 1

    def _fine(self, at: str) -> Column:
        return F.floor(F.col(at) / F.lit(self.finest)).cast("long")

    def _at(self, fine: str, level: int) -> Column:
        return F.shiftright(F.col(fine), 2 * (DEEPEST - level))

    def _crowd(self, level: int) -> int:
        sizes = self.spots.groupBy(self._at("_fx", level), self._at("_fy", level)).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.max("n").alias("n")).first()["n"] or 0

    def level(self, level: int) -> DataFrame:
        """(_bx, _by, _least) of the occupied bins, with those of the bin they are a quarter of, (_ux, _uy)."""
        up = max(level - 1, 0)
        return self.spots.groupBy(
            self._at("_fx", level).alias("_bx"), self._at("_fy", level).alias("_by"), self._at("_fx", up).alias("_ux"), self._at("_fy", up).alias("_uy")
        ).agg(F.min("_order").alias("_least"))

    def placed(self, points: DataFrame, key: str) -> DataFrame:
        """(key, _x, _y, _px, _py): points with their bin of the first level."""
        return points.select(key, F.col("lon").alias("_x"), F.col("lat").alias("_y"),
                             self._at_of("lon").alias("_px"), self._at_of("lat").alias("_py"))

    def _at_of(self, at: str) -> Column:
        return F.shiftright(self._fine(at), 2 * DEEPEST)

    def around(self, placed: DataFrame) -> DataFrame:
        """Points with each of the nine bins about them, whether occupied or not."""
        ring = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        return placed.withColumn("_bx", F.explode(F.transform(ring, lambda k: F.col("_px") + k))).withColumn(
            "_by", F.explode(F.transform(ring, lambda k: F.col("_py") + k)))

    def nearest(self, level: int) -> Column:
        """Chebyshev distance from (_x, _y) to the nearest corner or edge of a bin."""
        return F.greatest(F.lit(0.0), *[d for at, b in (("_x", "_bx"), ("_y", "_by")) for d in self._sides(at, b, level)])

    def farthest(self, level: int) -> Column:
        return F.greatest(*[-d for at, b in (("_x", "_bx"), ("_y", "_by")) for d in self._sides(at, b, level)])

    def _sides(self, at: str, bin_: str, level: int) -> tuple[Column, Column]:
        side = self.finest * 4 ** (DEEPEST - level)
        return F.col(bin_) * side - F.col(at), F.col(at) - (F.col(bin_) + 1) * side

    def quarters(self, met: DataFrame, level: int) -> DataFrame:
        """The occupied bins of ``level`` inside the bins that ``met`` holds of the level above."""
        return met.drop("_least").withColumnsRenamed({"_bx": "_ux", "_by": "_uy"}).join(small(self.level(level)), ["_ux", "_uy"]).drop("_ux", "_uy")

    def positions(self, met: DataFrame) -> DataFrame:
        """Each position in the bins of the last level, strictly within the tolerance on both axes."""
        spots = self.spots.select(self._at("_fx", self.deepest).alias("_bx"), self._at("_fy", self.deepest).alias("_by"), "lon", "lat", "_order")
        dx, dy = F.abs(F.col("_x") - F.col("lon")), F.abs(F.col("_y") - F.col("lat"))
        return met.join(spots, ["_bx", "_by"]).where((dx < self.tol) & (dy < self.tol)).withColumn("distance", F.greatest(dx, dy))


def nearest_site(points: DataFrame, sites: DataFrame, point_key: str, site_key: str,
                 tol: float = HitTolerance().site_deg, leaf: int = LEAF) -> DataFrame:
    """Nearest site within tolerance (Chebyshev, strict); ties go to the first site listed.

    Both frames have ``lon`` and ``lat``; ``site_key`` gives the list order. Points without
    a hit are absent. Where more than ``leaf`` sites share a square of the tolerance, a point
    goes down into quarters of bins and keeps those whose nearest edge is not beyond the
    farthest corner of another: it never meets all sites of a crowd.
    """
    bins = _Bins(sites, site_key, tol, leaf)
    met = bins.around(bins.placed(points, point_key)).drop("_px", "_py")
    met = met.join(small(bins.level(0).drop("_ux", "_uy", "_least")), ["_bx", "_by"])
    for level in range(1, bins.deepest + 1):
        met = bins.quarters(met, level).drop("_least").withColumns({"_near": bins.nearest(level), "_far": bins.farthest(level)})
        met = stored_table(met.where(F.col("_near") < tol + _SLACK), "near-bins")
        best = met.groupBy(point_key).agg(F.min("_far").alias("_best"))
        met = chunked.join_null_safe(met, best, [point_key]).where(F.col("_near") <= F.col("_best") + _SLACK).drop("_near", "_far", "_best")
    best = bins.positions(met).groupBy(point_key).agg(F.min(F.struct("distance", "_order")).alias("_b"))
    return best.select(point_key, F.col("_b._order").alias(site_key), F.col("_b.distance"))


def first_track(points: DataFrame, fixes: DataFrame, point_key: str, order: str,
                tol: float = HitTolerance().track_deg, leaf: int = LEAF) -> DataFrame:
    """First track (by ``order``) with any fix within tolerance; first, not nearest.

    The bin of the tolerance that a point is in lies whole inside its square and answers for
    all its fixes at once. Of the eight about it only those that hold an earlier track are
    looked into, by quarters: a whole quarter answers again, quarters on the border that could
    still improve are quartered further while they hold more than ``leaf`` positions, and only in
    the last ones are positions compared.
    """
    bins = _Bins(fixes, order, tol, leaf, least_level=1)
    whole = F.col("_reach") < tol - _SLACK  # one that is inside only by rounding is looked into
    top = small(bins.level(0).select("_bx", "_by", "_least"))
    own = top.select(F.col("_bx").alias("_px"), F.col("_by").alias("_py"), F.col("_least").alias("_own"))
    met = bins.around(bins.placed(points, point_key).join(own, ["_px", "_py"], "left"))
    met = met.join(top, ["_bx", "_by"]).withColumn("_reach", bins.farthest(0))
    met = stored_table(met.where(((F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by"))) | F.col("_own").isNull() | (F.col("_least") < F.col("_own")))
                       .drop("_px", "_py", "_own"), "met-bins")
    hits = []
    for level in range(1, bins.deepest + 2):
        hits.append(met.where(whole).select(point_key, F.col("_least").alias("_hit")))
        known = hits[-1] if level == 1 else met.select(point_key, F.least("_best", F.when(whole, F.col("_least"))).alias("_hit"))
        best = known.groupBy(point_key).agg(F.min("_hit").alias("_best"))
        edge = chunked.join_null_safe(met.where(~whole).drop(*(["_best"] if level > 1 else [])), best, [point_key]).where(
            F.col("_best").isNull() | (F.col("_least") < F.col("_best"))).drop("_reach")
        if level > bins.deepest:
            break
        met = bins.quarters(edge, level).withColumn("_reach", bins.farthest(level)).where(bins.nearest(level) < tol + _SLACK)
        met = stored_table(met.where(F.col("_best").isNull() | (F.col("_least") < F.col("_best"))), "met-bins")
    hits.append(bins.positions(edge).select(point_key, F.col("_order").alias("_hit")))
    return reduce(DataFrame.unionByName, hits).groupBy(point_key).agg(F.min("_hit").alias(order))


def _sent(bins: DataFrame) -> DataFrame:
    """Bins for a join with the rows of sites: sent to them while few, else both are sorted.

    Never the other way round: a site becomes a row per bin, which Spark's estimate of its size
    leaves out, so the driver would gather all of them.
    """
    held, n = measured(bins)
    return F.broadcast(held) if n <= BROADCAST_ROWS else held.hint("merge")


def distance_to_water(sites: DataFrame, cells: DataFrame, site_key: str, finest: float = 0.0625,
                      levels: int = 4, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Kilometres from each site to the nearest cell with a value; exact.

    Descends from coarse to fine occupied bins. At each level a site keeps the bins whose
    nearest corner is not beyond the best farthest corner, a handful whatever the number
    of cells, so sites are never compared with cells in general. Each bin has 64 children,
    of which only the occupied ones are met.
    """
    from brinewave.session import cut_lineage

    ocean = cells.where(C.clean("value").isNotNull()).select(
        F.col("lon").alias("_clon"), F.col("lat").alias("_clat"),
        F.floor(F.col("lon") / finest).alias("_bx"), F.floor(F.col("lat") / finest).alias("_by"))
    ocean = cut_lineage(ocean.distinct())
    occupied = cut_lineage(ocean.select("_bx", "_by").distinct())
    here = sites.select(site_key, F.col("lon").alias("_slon"), F.col("lat").alias("_slat"))
    kx = F.lit(cfg.km_per_lon) * F.cos(F.radians("_slat"))
    ky = F.lit(cfg.km_per_lat)

    def axis_bounds(position, index, size, scale):
        low, high = F.col(index) * size, (F.col(index) + 1) * size
        nearest = F.greatest(low - position, position - high, F.lit(0.0)) * scale
        farthest = F.greatest(F.abs(position - low), F.abs(position - high)) * scale
        return nearest, farthest

    coarse = finest * 8 ** (levels - 1)
    reach = int(180 // coarse) + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    met = here.withColumn("_bx", F.explode(span)).withColumn("_by", F.explode(span))
    on = ["_bx", "_by"]
    for level in range(levels - 1, -1, -1):
        size = finest * 8 ** level
        bins = occupied.select(F.floor(F.col("_bx") / 8 ** level).alias("_bx"),
                               F.floor(F.col("_by") / 8 ** level).alias("_by")).distinct()
        if level < levels - 1:
            bins = bins.withColumns({"_ux": F.floor(F.col("_bx") / 8), "_uy": F.floor(F.col("_by") / 8)})
        nx, fx = axis_bounds(F.col("_slon"), "_bx", size, kx)
        ny, fy = axis_bounds(F.col("_slat"), "_by", size, ky)
        bounded = met.join(_sent(bins), on).withColumn("_least", F.hypot(nx, ny)).withColumn("_most", F.hypot(fx, fy))
        # the bins of one site are few, so this window is small for every site
        best = F.min("_most").over(W.partitionBy(site_key))
        kept = bounded.withColumn("_best", best).where(F.col("_least") <= F.col("_best")).select(
            site_key, "_slon", "_slat", "_bx", "_by")
        on = ["_ux", "_uy"]
        met = kept.withColumnsRenamed({"_bx": "_ux", "_by": "_uy"})
    dx = (F.col("_clon") - F.col("_slon")) * kx
    dy = (F.col("_clat") - F.col("_slat")) * ky
    return kept.join(ocean.hint("merge"), ["_bx", "_by"]).groupBy(site_key).agg(F.min(F.hypot(dx, dy)).alias("km"))


def coverage_crop(bathymetry: DataFrame, data: DataFrame, buffer: float = 0.02,
                  strict: bool = True) -> DataFrame:
    """Grid rows inside the data's footprint plus a buffer; nothing left is an error."""
    span = data.agg(F.min("lon").alias("a"), F.max("lon").alias("b"),
                    F.min("lat").alias("c"), F.max("lat").alias("d"))

    def edge(name):
        return span.select(name).scalar()

    out = bathymetry.where(
        F.col("lon").between(edge("a") - buffer, edge("b") + buffer)
        & F.col("lat").between(edge("c") - buffer, edge("d") + buffer))
    if strict and out.isEmpty():
        have = bathymetry.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
        want = span.first()
        raise ValueError(f"bathymetry {tuple(have)} does not overlap the data {tuple(want)}")
    return out


def same_cell(history: DataFrame, current: DataFrame, key: str,
              tolerance: float = 1e-6) -> DataFrame:
    """Row form of the guard for many series: (key, same)."""
    now = current.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return history.join(now, key).select(key, (
        (F.abs(F.col("lat") - F.col("_lat")) <= tolerance)
        & (F.abs(F.col("lon") - F.col("_lon")) <= tolerance)).alias("same"))


def require_same_cell(history: DataFrame, current: DataFrame, key: str, tolerance: float = 1e-6) -> None:
    """Stop when any series would go on in a cell other than its own; names some of them."""
    moved = [r[key] for r in same_cell(history, current, key, tolerance).where(~F.col("same")).select(key).limit(5).collect()]
    if moved:
        raise ValueError(f"series of another cell: {moved}")


def nearest_step(targets: DataFrame, steps: DataFrame, key: str, target_key: str,
                 time: str = "time") -> DataFrame:
    """Nearest step to each target time within ``key``; on a tie the newer step.

    As-of in both directions: steps and targets share one axis; each target takes the last
    step at or before it and the first after it, carried across time chunks. What follows a
    row is taken in falling order: a frame that runs to the end is gone through anew at each row.
    """
    from brinewave.operators import chunked

    stamps = steps.select(key, F.col(time).alias("_t")).distinct()
    axis = stamps.withColumn("_step", F.col("_t")).withColumn("_id", F.lit(None).cast(
        targets.schema[target_key].dataType)).unionByName(
        targets.select(key, F.col(time).alias("_t"), F.lit(None).cast("timestamp").alias("_step"),
                       F.col(target_key).alias("_id")))
    axis = stored_table(axis, "step-axis")  # asked for each width, the ends of chunks and the rows
    width = chunked.width_for(axis, [key], "_t", (86_400 * 30, *DEFAULT_SCALE.chunk_widths))
    spans = axis.withColumn("_chunk", chunked.time_chunk("_t", width))
    edges = spans.groupBy(key, "_chunk").agg(F.max("_step").alias("_lastin"), F.min("_step").alias("_firstin"))
    back = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(key, "_chunk", F.max("_lastin").over(back).alias("_prev0"),
                         F.min("_firstin").over(ahead).alias("_next0"))
    upto = W.partitionBy(key, "_chunk").orderBy(F.unix_micros("_t")).rangeBetween(W.unboundedPreceding, 0)
    onward = W.partitionBy(key, "_chunk").orderBy(F.unix_micros("_t").desc()).rangeBetween(W.unboundedPreceding, 0)
    near = (
        spans.withColumn("_p", F.max("_step").over(upto)).withColumn("_n", F.min("_step").over(onward))
        .where(F.col("_id").isNotNull())
        .join(edges, [key, "_chunk"])
        .withColumn("_p", F.coalesce("_p", "_prev0")).withColumn("_n", F.coalesce("_n", "_next0"))
    )
    before = C.micros("_t") - C.micros("_p")
    after = C.micros("_n") - C.micros("_t")
    choice = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).when(
        after <= before, F.col("_n")).otherwise(F.col("_p"))
    return near.select(key, F.col("_id").alias(target_key), F.col("_t").alias("target_time"),
                       choice.alias("step_time"))


def region_stats(cells: DataFrame, product: str = "product", box: Box = SOUND_BOX) -> DataFrame:
    """Per product: count, mean, population sd, min, max, range inside a sub-region."""
    v = C.clean("value")
    return cells.where(C.in_box("lon", "lat", box) & v.isNotNull()).groupBy(product).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("range"))


def variability_ratio(stats: DataFrame, coarse: str, fine: str,
                      product: str = "product") -> DataFrame:
    """Fine over coarse spatial sd, pixel ratio, and what that says about the extra resolution."""
    row = stats.agg(
        F.max(F.when(F.col(product) == coarse, F.col("std"))).alias("_sc"),
        F.max(F.when(F.col(product) == fine, F.col("std"))).alias("_sf"),
        F.max(F.when(F.col(product) == coarse, F.col("n"))).alias("_nc"),
        F.max(F.when(F.col(product) == fine, F.col("n"))).alias("_nf"))
    ratio = F.when(F.col("_sc") > 0, F.col("_sf") / F.col("_sc"))
    return row.select(
        ratio.alias("std_ratio"), (F.col("_nf") / F.col("_nc")).alias("pixel_ratio"),
        F.when(ratio < 0.6, "interpolation").when(ratio > 0.9, "signal")
        .when(ratio.isNotNull(), "intermediate").alias("verdict"))


def product_census(grid: DataFrame, today, product: str = "product", probes: int = 5,
                   box: Box = SOUND_BOX, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Per product, from its newest filled step among the newest ``probes``: shape, ocean and
    land cells, in-region cells, cell size in km, lag in days, empty steps walked past."""
    v = C.clean("value")
    steps = grid.groupBy(product, "date").agg((F.count(v) > 0).alias("filled"))
    newest_first = W.partitionBy(product).orderBy(F.desc("date"))
    ranked = steps.withColumn("_r", F.row_number().over(newest_first)).where(F.col("_r") <= probes)
    used = ranked.groupBy(product).agg(
        F.max("date").alias("newest"), F.max(F.when(F.col("filled"), F.col("date"))).alias("used"),
        F.min(F.when(F.col("filled"), F.col("_r"))).alias("probes"))
    field = grid.join(used.select(product, F.col("used").alias("date")), [product, "date"])
    inside = C.in_box("lon", "lat", box)
    counts = field.groupBy(product).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(v).alias("n_ocean"),
        F.count_if(v.isNull()).alias("n_land"), F.count_if(inside).alias("region_cells"),
        F.count_if(inside & v.isNotNull()).alias("region_ocean"),
        F.min(v).alias("low"), F.max(v).alias("high"))

    def axis(name):
        centres = field.select(product, name).distinct()
        w = W.partitionBy(product).orderBy(name)  # one row per axis index
        stepped = centres.withColumn("_s", F.lead(name).over(w) - F.col(name))
        return stepped.groupBy(product).agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.percentile("_s", 0.5).alias(f"_step_{name}"),
            F.avg(name).alias(f"_mid_{name}"))

    out = used.join(counts, product).join(axis("lat"), product).join(axis("lon"), product)
    return out.select(
        product, "newest", "used", "probes", F.datediff(F.lit(today).cast("date"), "newest").alias("lag_days"),
        "n_lat", "n_lon", "n_cells", "n_ocean", "n_land", "region_cells", "region_ocean", "low", "high",
        (F.col("_step_lat") * cfg.km_per_lat).alias("cell_km_lat"),
        (F.col("_step_lon") * cfg.km_per_lon * F.cos(F.radians("_mid_lat"))).alias("cell_km_lon"))


def cell_series(points: DataFrame, grid: DataFrame, point_key: str = "point_id") -> DataFrame:
    """Value per day at each point's cell: (point, date, value); points carry (i, j)."""
    return points.join(grid.select("i", "j", "date", "value"), ["i", "j"]).select(
        point_key, "i", "j", "date", "value")


def cell_readout(series: DataFrame, point_key: str = "point_id") -> DataFrame:
    """Mean and range over all days, with the days that hold a value; all null = masked."""
    v = C.clean("value")
    return series.groupBy(point_key).agg(
        F.count(v).alias("n_days"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high")
    ).withColumn("status", F.when(F.col("n_days") > 0, "water").otherwise("land or masked"))
