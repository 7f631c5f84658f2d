"""Regular grids in long form: edges, reachability, runs, cell polygons, clipping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinewave.config import GridConfig
from brinewave.functions import columns as C
from brinewave.functions import geometry as G
from brinewave.operators.components import connected_components
from brinewave.operators.sizing import join_checked, small
from brinewave.session import cut_lineage, stored_table


def axis_of(grid: DataFrame, index: str, centre: str) -> DataFrame:
    """Distinct axis centres: (idx, centre)."""
    return grid.select(F.col(index).alias("idx"), F.col(centre).alias("centre")).distinct()


def axis_neighbours(axis: DataFrame, per_chunk: int = 10_000) -> DataFrame:
    """The axis with the centres before and after each one: (idx, centre, before, after).

    The axis is cut into spans of equal width, about ``per_chunk`` centres each; the ends of
    the spans reach their neighbours through a summary with one row per span.
    """
    axis = stored_table(axis.select("idx", "centre"), "axis")  # asked twice; its source may be a whole grid
    facts = axis.agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.count(F.lit(1)).alias("n")).first()
    span = F.lit(0)
    if facts["n"] > per_chunk and facts["high"] > facts["low"]:
        n = -(-facts["n"] // per_chunk)
        share = (F.col("centre") - F.lit(facts["low"])) / F.lit(facts["high"] - facts["low"])
        span = F.coalesce(F.least(F.lit(n - 1), F.floor(share * n)), F.lit(0))
    cut = axis.withColumn("_span", span)
    inside, across = W.partitionBy("_span").orderBy("centre"), W.orderBy("_span")
    ends = cut.groupBy("_span").agg(F.min("centre").alias("_a"), F.max("centre").alias("_b")).select(
        "_span", F.lag("_b").over(across).alias("_prev"), F.lead("_a").over(across).alias("_next"))
    return cut.withColumns({"_lag": F.lag("centre").over(inside), "_lead": F.lead("centre").over(inside)}).join(ends, "_span").select(
        "idx", "centre", F.coalesce("_lag", "_prev").alias("before"), F.coalesce("_lead", "_next").alias("after"))


def axis_edges(axis: DataFrame) -> DataFrame:
    """(idx, centre, lo, hi): spacing per interval, ends extrapolated, one cell is +/- 0.5."""
    c = F.col("centre")
    before, after = c - F.col("before"), F.col("after") - c
    lo = F.coalesce(before, after, F.lit(1.0)) / 2
    hi = F.coalesce(after, before, F.lit(1.0)) / 2
    return axis_neighbours(axis).select("idx", "centre", (c - lo).alias("lo"), (c + hi).alias("hi"))


def ever_water(grid: DataFrame) -> DataFrame:
    """Cells with a value on any day, so that a gap on one day does not change the shape."""
    return grid.groupBy("i", "j").agg((F.count(C.clean("value")) > 0).alias("water")).where("water").select("i", "j")


def row_runs(cells: DataFrame, row: str = "i", col: str = "j", keys: tuple = ()) -> DataFrame:
    """Each cell with the start of its horizontal run (gaps and islands in one row)."""
    w = W.partitionBy(*keys, row).orderBy(col)
    return cells.withColumn("_isle", F.col(col) - F.row_number().over(w)).withColumn(
        "run_start", F.min(col).over(W.partitionBy(*keys, row, "_isle"))).drop("_isle")


def water_components(grid: DataFrame) -> DataFrame:
    """(i, j, component) for water cells, connected through shared sides.

    The graph is built on horizontal runs, far fewer than cells; two runs touch where a
    cell has its neighbour in the next row.
    """
    # a run is named by its first cell, row above column, in one LONG
    runs = cut_lineage(row_runs(ever_water(grid)).select(
        "i", "j", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("run_start")).alias("run")))
    below = runs.select((F.col("i") - 1).alias("i"), "j", F.col("run").alias("b"))
    edges = runs.join(below, ["i", "j"]).select(F.col("run").alias("a"), "b").distinct()
    labels = connected_components(runs.select(F.col("run").alias("node")).distinct(), edges)
    return runs.join(labels.withColumnRenamed("node", "run"), "run").select("i", "j", "component")


def flag_disconnected(grid: DataFrame) -> DataFrame:
    """(i, j, flagged) for water cells: everything but the largest component is flagged.

    Equal sizes: the component found first in row order stays.
    """
    cells = water_components(grid)
    sizes = cells.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("c")).scalar()
    return cells.select("i", "j", (F.col("component") != main).alias("flagged"))


def day_summary(grid: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(date, cells, low, high, mean, flagged) per day."""
    v = C.clean("value")
    if flags is None:
        joined = grid.withColumn("flagged", F.lit(False))
    else:
        joined = grid.join(flags, ["i", "j"], "left")
    return joined.groupBy("date").agg(
        F.count(v).alias("cells"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"),
        F.count_if(v.isNotNull() & F.coalesce("flagged", F.lit(False))).alias("flagged"))


def cell_rectangles(grid: DataFrame, decimals: int = 3) -> DataFrame:
    """Water cells with rounded bounds: south, north, west, east."""
    def rounded(axis, index, low, high):
        return axis_edges(axis).select(
            F.col("idx").alias(index), C.tidy_round("lo", decimals).alias(low), C.tidy_round("hi", decimals).alias(high))

    lat = rounded(axis_of(grid, "i", "lat"), "i", "south", "north")
    lon = rounded(axis_of(grid, "j", "lon"), "j", "west", "east")
    return grid.where(C.clean("value").isNotNull()).join(lat, "i").join(lon, "j")


def merge_runs(mask: DataFrame, keys: tuple = ("i", "j"), row: str = "r", col: str = "c") -> DataFrame:
    """Half-open rectangles (r0, r1, c0, c1) covering the given pixels of each key.

    Horizontal runs first, then identical runs of touching rows are stacked.
    """
    keys = list(keys)
    isle = F.col(col) - F.row_number().over(W.partitionBy(*keys, row).orderBy(col))
    runs = mask.withColumn("_s", isle).groupBy(*keys, row, "_s").agg(
        F.min(col).alias("c0"), (F.max(col) + 1).alias("c1")).drop("_s")
    stack = F.col(row) - F.row_number().over(W.partitionBy(*keys, "c0", "c1").orderBy(row))
    return runs.withColumn("_s", stack).groupBy(*keys, "c0", "c1", "_s").agg(
        F.min(row).alias("r0"), (F.max(row) + 1).alias("r1")).select(*keys, "r0", "r1", "c0", "c1")


def mask_axes(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, lat) and (c, lon) of a mask, written out: one row per axis index."""
    return (cut_lineage(mask.select("r", "lat").distinct()), cut_lineage(mask.select("c", "lon").distinct()))


def mask_in_cells(cells: DataFrame, mask: DataFrame, cfg: GridConfig = GridConfig(), axes=None) -> DataFrame:
    """Mask pixels with the coarse cell that owns their centre: [lo - eps, hi - eps).

    ``cells`` are distinct (i, j, south, north, west, east); ``mask`` has (r, c, lat, lon,
    water). Axis by axis, so each axis is a small table of intervals turned into bins.
    """
    def owner(mask_axis, cell_axis, x, low, high, index):
        width = cell_axis.agg(F.avg(F.col(high) - F.col(low)).alias("w")).scalar()
        eps = cfg.mask_epsilon
        bins = cell_axis.withColumn("_w", width).withColumn("_bin", F.explode(F.sequence(
            F.floor((F.col(low) - eps) / F.col("_w")), F.floor((F.col(high) - eps) / F.col("_w"))))).drop("_w")
        at = mask_axis.withColumn("_w", width).withColumn("_bin", F.floor(F.col(x) / F.col("_w"))).drop("_w")
        return at.join(bins, "_bin").where(
            (F.col(x) >= F.col(low) - eps) & (F.col(x) < F.col(high) - eps)).drop("_bin", x)

    by_row, by_col = axes or mask_axes(mask)
    rows = owner(by_row, cells.select("i", "south", "north").distinct(),
                 "lat", "south", "north", "i")
    cols = owner(by_col, cells.select("j", "west", "east").distinct(),
                 "lon", "west", "east", "j")
    placed = join_checked(join_checked(mask, rows.select("r", "i"), ["r"]), cols.select("c", "j"), ["c"])
    return placed.join(cells.select("i", "j").distinct(), ["i", "j"], "left_semi")


@dataclass(frozen=True)
class PackedMask:
    """A mask with 32 neighbouring pixels of a row in one row.

    ``blocks``: r, lat, k and the bits of the columns 32k to 32k + 31 that are there (seen), water
    (wet) and land (dry). ``rows``: r, lat; ``columns``: c, lon.
    """

    blocks: DataFrame
    rows: DataFrame
    columns: DataFrame


def pack_mask(mask: DataFrame | PackedMask) -> PackedMask:
    """The mask (r, c, lat, lon, water), packed and written out; a packed one as it is.

    The bits are put together before the exchange. Pixels listed more than once are told by
    their count and go to further blocks of the same columns, so that each still counts.
    """
    if isinstance(mask, PackedMask):
        return mask
    pixels = mask.where(F.col("c").isNotNull()).select(
        "r", "lat", "c", F.expr("shiftright(cast(c AS bigint), 5)").alias("k"), F.expr("shiftleft(1L, cast(c & 31 AS int))").alias("_bit"), "water")

    def packed(df, *more):
        return df.groupBy("r", "lat", "k", *more).agg(
            F.count(F.lit(1)).alias("_n"), F.bit_or("_bit").alias("seen"),
            F.coalesce(F.bit_or(F.when(F.col("water"), F.col("_bit"))), F.lit(0)).alias("wet"),
            F.coalesce(F.bit_or(F.when(~F.col("water"), F.col("_bit"))), F.lit(0)).alias("dry"))

    blocks = stored_table(packed(pixels), "mask-blocks")
    if not blocks.where(F.col("_n") > F.bit_count("seen")).isEmpty():
        copies = pixels.withColumn("_copy", F.row_number().over(W.partitionBy("r", "lat", "c").orderBy("water")))
        blocks = stored_table(packed(copies, "_copy"), "mask-blocks")
    return PackedMask(blocks.select("r", "lat", "k", "seen", "wet", "dry"), cut_lineage(blocks.select("r", "lat").distinct()),
                      cut_lineage(mask.select("c", "lon").distinct()))


def blocks_within(rectangles: DataFrame, mask: PackedMask, closed: bool = False) -> DataFrame:
    """The mask under each rectangle (s, n, w, e and more): pixel centres in [lo, hi), or [lo, hi] when ``closed``.

    A row per rectangle, mask row and block, with r, k, the bits seen, wet and dry of the pixels
    inside, and the outermost columns, first and last, that the rectangle has in the block.
    """
    def binned(df, width, low, high):
        return df.withColumn("_w", width).withColumn(
            "_bin", F.explode(F.sequence(F.floor(F.col(low) / F.col("_w")), F.floor(F.col(high) / F.col("_w"))))).drop("_w")

    def at(df, width, x):
        return df.withColumn("_w", width).withColumn("_bin", F.floor(F.col(x) / F.col("_w"))).drop("_w")

    def inside(x, low, high):
        return (F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high) if closed else F.col(x) < F.col(high))

    lat_width = rectangles.agg(F.avg(F.col("n") - F.col("s")).alias("v")).scalar()
    lon_width = rectangles.agg(F.avg(F.col("e") - F.col("w")).alias("v")).scalar()
    spans = binned(rectangles.select("w", "e").distinct(), lon_width, "w", "e")
    held = at(mask.columns, lon_width, "lon").join(spans, "_bin").where(inside("lon", "w", "e")).groupBy(
        "w", "e", F.expr("shiftright(cast(c AS bigint), 5)").alias("k")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(c & 31 AS int))")).alias("_bits"), F.min("c").alias("first"), F.max("c").alias("last"))
    boxes = join_checked(binned(rectangles, lat_width, "s", "n"), held, ["w", "e"])
    hit = at(mask.blocks, lat_width, "lat").join(boxes, ["_bin", "k"]).where(inside("lat", "s", "n"))
    return hit.select(*rectangles.columns, "r", "k", "first", "last", *[
        F.col(b).bitwiseAND(F.col("_bits")).alias(b) for b in ("seen", "wet", "dry")]).where("seen <> 0")


def clip_parts(cells: DataFrame, mask: DataFrame | PackedMask, cfg: GridConfig = GridConfig()) -> DataFrame:
    """(i, j, s, n, w, e): the water rectangles of every cell.

    All water or outside the mask: the cell itself. No water: no row. Mixed: merged runs,
    clamped to the cell, rounded, the collapsed ones dropped. A cell owns the pixels of
    ``mask_in_cells``; they travel as blocks, and only water of mixed cells is unpacked.
    """
    # the blocks of each cell are written once: counts and runs read them with other columns
    bounds = cut_lineage(cells.select("i", "j", "south", "north", "west", "east").distinct())
    mask = pack_mask(mask)
    owned = bounds.select("i", "j", *[(F.col(x) - cfg.mask_epsilon).alias(x[0]) for x in ("south", "north", "west", "east")])
    placed = stored_table(blocks_within(owned, mask).select("i", "j", "r", "k", "first", "last", "seen", "wet"), "clip-blocks")
    cover = stored_table(placed.groupBy("i", "j").agg(
        F.sum(F.bit_count("seen")).alias("n_pixels"), F.sum(F.bit_count("wet")).alias("n_water")), "clip-cover")
    whole = bounds.join(cover, ["i", "j"], "left").where(
        F.col("n_pixels").isNull() | (F.col("n_water") == F.col("n_pixels"))).select(
        "i", "j", F.col("south").alias("s"), F.col("north").alias("n"), F.col("west").alias("w"), F.col("east").alias("e"))
    # the exchange on the cell serves both run windows and both groupings; a cell holds a fixed number of mask pixels
    mixed = cover.where("n_water > 0 AND n_water < n_pixels").select("i", "j")
    wet = placed.where("wet <> 0").join(mixed, ["i", "j"]).select(
        "i", "j", "r", "k", "wet", F.explode(F.sequence("first", "last")).alias("c")).where(
        F.getbit("wet", (F.col("c") - F.col("k") * 32).cast("int")) == 1)
    boxes = merge_runs(wet.select("i", "j", "r", "c"))
    lat = small(axis_edges(mask.rows.toDF("idx", "centre")))
    lon = small(axis_edges(mask.columns.toDF("idx", "centre")))
    sized = (
        boxes.join(lat.select(F.col("idx").alias("r0"), F.col("lo").alias("_s")), "r0")
        .withColumn("_r", F.col("r1") - 1)
        .join(lat.select(F.col("idx").alias("_r"), F.col("hi").alias("_n")), "_r")
        .join(lon.select(F.col("idx").alias("c0"), F.col("lo").alias("_w")), "c0")
        .withColumn("_c", F.col("c1") - 1)
        .join(lon.select(F.col("idx").alias("_c"), F.col("hi").alias("_e")), "_c")
        .join(bounds, ["i", "j"])
    )
    d = cfg.decimals
    parts = sized.select(
        "i", "j",
        C.tidy_round(F.greatest("_s", "south"), d).alias("s"), C.tidy_round(F.least("_n", "north"), d).alias("n"),
        C.tidy_round(F.greatest("_w", "west"), d).alias("w"), C.tidy_round(F.least("_e", "east"), d).alias("e"),
    ).where((F.col("n") > F.col("s")) & (F.col("e") > F.col("w")))
    return whole.unionByName(parts)


def cell_polygons(grid: DataFrame, date=None, decimals: int = 3, mask: DataFrame | None = None,
                  flags: DataFrame | None = None, cfg: GridConfig | None = None) -> DataFrame:
    """One feature row per water cell of one date (newest by default).

    Columns: i, j, date, value, lat, lon, flagged and the geometry: ``ring`` for a plain
    cell, ``parts`` (a multi-polygon) when clipped to ``mask``. Land and, when clipping,
    cells without any water are absent.
    """
    cfg = cfg or GridConfig(decimals=decimals)
    flags = flag_disconnected(grid) if flags is None else flags
    if date is None:
        day = grid.where(F.col("date") == grid.agg(F.max("date").alias("d")).scalar())
    else:
        day = grid.where(F.col("date") == F.lit(date).cast("date"))
        if day.isEmpty():
            raise KeyError(f"{date} is not in the grid")
    return polygons_of(grid, day, cfg, mask, flags)


def polygons_of(grid: DataFrame, days: DataFrame, cfg: GridConfig, mask: DataFrame | PackedMask | None,
                flags: DataFrame) -> DataFrame:
    """Features of all rows in ``days``; axes come from the whole ``grid``."""
    d = cfg.decimals
    lat = axis_edges(axis_of(grid, "i", "lat")).select(
        F.col("idx").alias("i"), C.tidy_round("lo", d).alias("south"), C.tidy_round("hi", d).alias("north"))
    lon = axis_edges(axis_of(grid, "j", "lon")).select(
        F.col("idx").alias("j"), C.tidy_round("lo", d).alias("west"), C.tidy_round("hi", d).alias("east"))
    cells = join_checked(join_checked(days.where(C.clean("value").isNotNull()), lat, "i"), lon, "j").join(flags, ["i", "j"], "left")
    out = cells.select(
        "i", "j", "date", C.tidy_round("value", 2).alias("value"), C.tidy_round("lat", 4).alias("lat"),
        C.tidy_round("lon", 4).alias("lon"), F.coalesce("flagged", F.lit(False)).alias("flagged"),
        "south", "north", "west", "east")
    if mask is None:
        return out.withColumn("ring", G.rectangle(
            F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    # days and shapes are written once and apart: a shape is held per cell, not per cell and day
    out = stored_table(out, "layer-cells")
    # a cell has a bounded number of parts: at most the mask pixels inside one cell
    parts = clip_parts(out.select("i", "j", "south", "north", "west", "east").distinct(), mask, cfg)
    shapes = parts.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("s", "n", "w", "e"))).alias("_p"))
    shapes = shapes.withColumn("parts", F.transform("_p", lambda p: F.array(
        G.rectangle(p["s"], p["n"], p["w"], p["e"])))).drop("_p")
    return out.join(stored_table(shapes, "layer-shapes"), ["i", "j"])


def land_share(rectangles: DataFrame, mask: DataFrame | PackedMask) -> DataFrame:
    """Share of land pixels under drawn rectangles (s, n, w, e): pixel centres in [lo, hi)."""
    hit = blocks_within(rectangles.select("s", "n", "w", "e"), pack_mask(mask))
    return hit.agg(*[F.coalesce(F.sum(F.bit_count(b).cast("long")), F.lit(0)).alias(name) for b, name in (("seen", "pixels"), ("dry", "land"))]).select(
        "pixels", "land", F.when(F.col("pixels") > 0, F.col("land") / F.col("pixels")).otherwise(0.0).alias("share"))


def part_stats(parts: DataFrame) -> DataFrame:
    per_cell = parts.groupBy("i", "j").agg(F.count(F.lit(1)).alias("_n"))
    return per_cell.agg(F.count(F.lit(1)).alias("cells"), F.avg("_n").alias("mean_parts"), F.max("_n").alias("max_parts"))


def depth_section(df: DataFrame, variable: str, key: str = "deployment") -> DataFrame:
    """(time, depth, value) points per deployment, depth positive down turned to height."""
    from brinewave.operators.screening import require

    return require(df, ["depth", variable]).select(
        key, "time", C.depth_down_negative("depth").alias("z"), F.col(variable).alias("value"))


def vertical_profile(df: DataFrame, variable: str, key: str = "deployment") -> DataFrame:
    """One cast ordered by depth magnitude."""
    from brinewave.operators.screening import require

    return require(df, ["depth", variable]).select(
        key, F.abs("depth").alias("depth"), F.col(variable).alias("value")).orderBy(key, "depth")
