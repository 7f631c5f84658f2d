from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.config import Box, GridConfig
from brinewave.operators import components
from brinewave.operators import grid as R
from brinewave.operators import spatial as P


def grid_of(spark, field, date="2020-01-01", lat0=48.0, lon0=-126.0, step=0.05, lats=None):
    rows = []
    for i, line in enumerate(field):
        for j, v in enumerate(line):
            lat = lats[i] if lats else lat0 + i * step
            rows.append((date, i, j, lat, lon0 + j * step, None if v is None else float(v)))
    return spark.createDataFrame(rows, "date string, i bigint, j bigint, lat double, lon double, value double").withColumn(
        "date", F.col("date").cast("date"))


def field(text):
    return [[None if c == "." else 12.0 for c in line] for line in text.split()]


def flagged(spark, *texts):
    g = None
    for k, t in enumerate(texts):
        day = grid_of(spark, field(t), f"2020-01-0{k + 1}")
        g = day if g is None else g.unionByName(day)
    return {(r["i"], r["j"]) for r in R.flag_disconnected(g).where("flagged").collect()}


def test_largest_basin_stays(spark):
    assert flagged(spark, "##.# ##.# ##..") == {(0, 3), (1, 3)}


def test_diagonal_contact_does_not_connect(spark):
    assert flagged(spark, "##. ##. ..#") == {(2, 2)}


def test_equal_basins_keep_the_first(spark):
    assert flagged(spark, "#.# #.#") == {(0, 2), (1, 2)}


def test_one_basin_or_one_cell_flags_nothing(spark):
    assert flagged(spark, "### ###") == set() and flagged(spark, "#") == set()


def test_a_gap_on_one_day_does_not_split_the_water(spark):
    assert flagged(spark, "###", "#.#") == set()


def test_snaking_water_is_one_component(spark):
    text = "####### ......# ####### #...... ####### ......# #######"
    assert flagged(spark, text) == set()


def test_random_components_equal_flood_fill(spark):
    rng = np.random.default_rng(11)
    water = rng.random((18, 23)) < 0.58
    label = -np.ones(water.shape, int)
    count = 0
    for i, j in zip(*np.nonzero(water)):
        if label[i, j] < 0:
            stack = [(i, j)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 18 and 0 <= b < 23 and water[a, b] and label[a, b] < 0:
                    label[a, b] = count
                    stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
            count += 1
    g = grid_of(spark, [[12.0 if w else None for w in line] for line in water])
    got = {}
    for r in R.water_components(g).collect():
        got.setdefault(r["component"], set()).add((r["i"], r["j"]))
    want = {}
    for i, j in zip(*np.nonzero(water)):
        want.setdefault(label[i, j], set()).add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_settles_in_few_rounds(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(0, 302).select(F.col("id").alias("node"))
    out = components.connected_components(nodes, edges)
    assert {r["component"]: r["count"] for r in out.groupBy("component").count().collect()} == {0: 301, 301: 1}


def test_edges_on_irregular_and_single_axes(spark):
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "idx bigint, centre double")
    assert [tuple(r)[2:] for r in R.axis_edges(axis).orderBy("idx").collect()] == [(0.5, 1.5), (1.5, 3.0), (3.0, 5.0)]
    single = spark.createDataFrame([(0, 5.0)], "idx bigint, centre double")
    assert tuple(R.axis_edges(single).first())[2:] == (4.5, 5.5)


def test_snap_is_open_below_and_closed_above(spark):
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "idx bigint, centre double")
    pts = spark.createDataFrame([(k, x) for k, x in enumerate([0.5, 0.51, 1.5, 1.51, 3.0, 5.0, 5.01])], "id bigint, x double")
    got = {r["id"]: r["c"] for r in P.snap_axis(pts, R.axis_edges(axis), "x", "c").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    near = {r["id"]: r["c"] for r in P.nearest_index(pts, axis, "x", "c").collect()}
    assert near == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}  # ties go to the lower index


def test_point_outside_the_grid_is_an_error(spark):
    g = grid_of(spark, field("## ##"))
    lat, lon = R.axis_edges(R.axis_of(g, "i", "lat")), R.axis_edges(R.axis_of(g, "j", "lon"))
    pts = spark.createDataFrame([(1, 48.01, -126.0), (2, 60.0, -126.0)], "point_id bigint, lat double, lon double")
    assert P.resolve_cell(pts, lat, lon).count() == 1
    with pytest.raises(Exception, match="outside the grid"):
        P.resolve_cell(pts, lat, lon, strict=True).collect()


def test_nearest_site_and_first_track(spark):
    pts = spark.createDataFrame([(1, -125.0, 48.0), (2, -120.0, 48.0)], "point_id bigint, lon double, lat double")
    sites = spark.createDataFrame([(9, -125.02, 48.0), (4, -124.98, 48.0), (5, -125.029, 48.029), (6, -125.03, 48.0)],
                                  "site bigint, lon double, lat double")
    out = P.nearest_site(pts, sites, "point_id", "site").collect()
    assert [(r["point_id"], r["site"]) for r in out] == [(1, 4)] or [(r["point_id"], r["site"]) for r in out] == [(1, 9)]
    fixes = spark.createDataFrame([("b", -125.0, 48.0), ("a", -125.049, 48.049), ("a", -125.2, 48.0)], "name string, lon double, lat double")
    assert [(r["point_id"], r["name"]) for r in P.first_track(pts, fixes, "point_id", "name").collect()] == [(1, "a")]


def test_distance_to_water_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    cells = [(float(x), float(y), 10.0 if k % 3 else None) for k, (x, y) in enumerate(zip(rng.uniform(-128, -120, 150), rng.uniform(45, 50, 150)))]
    sites = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-140, -110, 25), rng.uniform(35, 60, 25)))] + [(99, 170.0, -80.0)]
    got = P.distance_to_water(spark.createDataFrame(sites, "site bigint, lon double, lat double"),
                              spark.createDataFrame(cells, "lon double, lat double, value double"), "site").collect()
    assert len(got) == len(sites)
    for r in got:
        _, x, y = next(s for s in sites if s[0] == r["site"])
        want = min(math.hypot((cx - x) * 111.32 * math.cos(math.radians(y)), (cy - y) * 110.57) for cx, cy, v in cells if v)
        assert r["km"] == pytest.approx(want)


def test_nearest_step_prefers_the_newer_on_a_tie(frame):
    steps = frame([("p", "2020-01-01 12:00:00"), ("p", "2020-01-03 12:00:00"), ("p", "2020-06-01 00:00:00")], "product string, time timestamp")
    targets = frame([("p", 1, "2020-01-02 12:00:00"), ("p", 2, "2020-01-02 11:59:00"), ("p", 3, "2019-01-01 00:00:00"),
                     ("p", 4, "2021-01-01 00:00:00"), ("p", 5, "2020-03-01 00:00:00")], "product string, id bigint, time timestamp")
    got = {r["id"]: str(r["step_time"]) for r in P.nearest_step(targets, steps, "product", "id").collect()}
    assert got == {1: "2020-01-03 12:00:00", 2: "2020-01-01 12:00:00", 3: "2020-01-01 12:00:00", 4: "2020-06-01 00:00:00", 5: "2020-01-03 12:00:00"}


def test_coverage_crop_names_both_extents(spark):
    bathy = spark.createDataFrame([(0.0, 0.0, -5.0)], "lon double, lat double, depth double")
    data = spark.createDataFrame([(0.01, 0.01)], "lon double, lat double")
    assert P.coverage_crop(bathy, data).count() == 1
    with pytest.raises(ValueError, match="does not overlap"):
        P.coverage_crop(bathy, data.select((F.col("lon") + 5).alias("lon"), "lat"))


def test_same_cell_guard(spark):
    def at(lat):
        return spark.createDataFrame([("a", lat, -125.275)], "site string, lat double, lon double")

    P.require_same_cell(at(48.825), at(48.8250000001), "site")
    with pytest.raises(ValueError, match="another cell"):
        P.require_same_cell(at(48.825), at(48.875), "site")


def test_region_uses_population_deviation(spark):
    cells = spark.createDataFrame([("a", -125.2, 48.8, 1.0), ("a", -125.2, 48.9, 3.0), ("b", -125.2, 48.8, 1.0), ("b", -125.2, 48.9, 1.5),
                                   ("a", -130.0, 48.8, 99.0)], "product string, lon double, lat double, value double")
    stats = P.region_stats(cells)
    assert {r["product"]: r["std"] for r in stats.collect()} == {"a": 1.0, "b": 0.25}
    row = P.variability_ratio(stats, "a", "b").first()
    assert row["std_ratio"] == 0.25 and row["verdict"] == "interpolation"
    assert P.region_stats(cells, box=Box(0, 1, 0, 1)).count() == 0


def rect_brute(pixels):
    """Reference cover: runs per row, equal runs of touching rows stacked."""
    runs = []
    for r in sorted({p[0] for p in pixels}):
        cols = sorted(c for q, c in pixels if q == r)
        start = prev = cols[0]
        for c in cols[1:] + [None]:
            if c != (prev + 1):
                runs.append((r, start, prev + 1))
                start = c
            prev = c
    out, used = [], set()
    for r, a, b in runs:
        if (r, a, b) in used:
            continue
        end = r
        while (end, a, b) in runs:
            used.add((end, a, b))
            end += 1
        out.append((r, end, a, b))
    return sorted(out)


def test_merge_runs_covers_exactly(spark):
    rng = np.random.default_rng(5)
    pixels = [(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((9, 9)) < 0.6))]
    df = spark.createDataFrame([(0, 0, r, c) for r, c in pixels], "i bigint, j bigint, r bigint, c bigint")
    got = sorted((r["r0"], r["r1"], r["c0"], r["c1"]) for r in R.merge_runs(df).collect())
    assert got == rect_brute(pixels)


def mask_of(spark, text, lat0=47.98, lon0=-126.02):
    rows = [(r, c, lat0 + r * 0.01, lon0 + c * 0.01, ch == "~") for r, line in enumerate(text.split()) for c, ch in enumerate(line)]
    return spark.createDataFrame(rows, "r bigint, c bigint, lat double, lon double, water boolean")


CELL = [(0, 0, 47.975, 48.025, -126.025, -125.975)]
CELLS = "i bigint, j bigint, south double, north double, west double, east double"


@pytest.mark.parametrize("text,parts", [
    ("~~~~~ ~~~~~ ~~~~~ ~~~~~ ~~~~~", [(47.975, 48.025, -126.025, -125.975)]),
    (".....  ..... ..... ..... .....", []),
    ("~~~~~ ~~~~~ ~~... ~~... ~~...", [(47.975, 47.995, -126.025, -125.975), (47.995, 48.025, -126.025, -126.005)]),
])
def test_clip_cases(spark, text, parts):
    cells = spark.createDataFrame(CELL, CELLS)
    got = [tuple(r)[2:] for r in R.clip_parts(cells, mask_of(spark, text), GridConfig()).orderBy("s", "w").collect()]
    assert got == parts


def test_cell_outside_the_mask_stays_whole(spark):
    cells = spark.createDataFrame([*CELL, (5, 5, 50.0, 50.05, -120.0, -119.95)], CELLS)
    out = R.clip_parts(cells, mask_of(spark, "....."), GridConfig())
    assert [tuple(r)[2:] for r in out.where("i = 5").collect()] == [(50.0, 50.05, -120.0, -119.95)]


def test_polygons_default_to_the_newest_date_and_skip_land(spark):
    g = grid_of(spark, field("#. ##"), "2020-01-01").unionByName(grid_of(spark, field("## .#"), "2020-01-02"))
    out = R.cell_polygons(g)
    assert {(r["i"], r["j"]) for r in out.collect()} == {(0, 0), (0, 1), (1, 1)}
    assert str(out.first()["date"]) == "2020-01-02" and len(out.first()["ring"]) == 5
    assert R.cell_polygons(g, date="2020-01-01").count() == 3
    with pytest.raises(KeyError):
        R.cell_polygons(g, date="2021-01-01")


def test_clipped_polygons_are_multi_part(spark):
    g = grid_of(spark, [[12.345]], lat0=48.0, lon0=-126.0)
    g = g.unionByName(grid_of(spark, [[None, 1.0]], lat0=48.0, lon0=-126.0).where("j = 1"))
    out = R.cell_polygons(g, mask=mask_of(spark, "~~~~~..... ~~~~~..... ~~........ ~~........ ~~........"))
    row = out.collect()
    assert len(row) == 1 and len(row[0]["parts"]) == 2 and row[0]["value"] == pytest.approx(12.34, abs=0.011)


def test_axis_spans_do_not_change_edges(spark):
    import random

    from brinewave.operators.grid import axis_neighbours

    r = random.Random(1)
    centres = sorted({round(r.random() ** 4 * 100, 5) for _ in range(300)})
    axis = spark.createDataFrame([(len(centres) - k, c) for k, c in enumerate(centres)], "idx int, centre double")
    want = {c: (a, b) for a, c, b in zip([None, *centres], centres, [*centres[1:], None])}
    for size in (1, 7, 1000):
        assert {x["centre"]: (x["before"], x["after"]) for x in axis_neighbours(axis, size).collect()} == want
    one = axis_neighbours(axis.limit(1)).collect()
    assert len(one) == 1 and one[0]["before"] is None and one[0]["after"] is None


def test_first_track_with_positions_that_do_not_repeat(spark):
    import random

    r = random.Random(2)
    fixes = [(k, -125 + r.random() * 0.5, 48 + r.random() * 0.5) for k in r.sample(range(10_000), 2500)]
    points = [(p, -125.1 + r.random() * 0.7, 47.9 + r.random() * 0.7) for p in range(80)] + [(100, -125.0, 48.0), (101, -124.75, 48.25)]
    tol = 0.05
    want = {p: min(hit) for p, x, y in points if (hit := [k for k, a, b in fixes if abs(a - x) < tol and abs(b - y) < tol])}
    got = P.first_track(spark.createDataFrame(points, "point int, lon double, lat double"), spark.createDataFrame(fixes, "track int, lon double, lat double"),
                        "point", "track", tol).collect()
    assert {x["point"]: x["track"] for x in got} == want


def test_clipped_layer_has_every_day(spark):
    """One feature for each day of each wet cell with water, not those of the newest day alone."""
    import os

    from brinewave.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    registry.load()
    grid = registry.Frames(spark, folder).grid.where("value is not null")
    made = registry.QUERIES["clipped_layer_every_day"](spark, folder).toPandas()
    drawn = set(zip(made["i"], made["j"]))
    want = sorted((str(r["date"]), r["i"], r["j"]) for r in grid.collect() if (r["i"], r["j"]) in drawn)
    assert sorted(zip(made["date"].astype(str), made["i"], made["j"])) == want
    assert len({d for d, _, _ in want}) == grid.select("date").distinct().count() > 1
    newest = registry.QUERIES["clipped_layer_features"](spark, folder).toPandas()
    last = made[made["date"].astype(str) == max(d for d, _, _ in want)]
    assert sorted(zip(last["i"], last["j"], last["parts"])) == sorted(zip(newest["i"], newest["j"], newest["parts"]))


def test_packed_mask_counts_every_pixel_once_per_row(spark):
    """Blocks of 32 columns, also left of zero; a pixel listed twice counts twice, one without a word on water is neither."""
    rng = np.random.default_rng(11)
    rows = [(r, c, 47.98 + r * 0.01, -126.02 + c * 0.01, [True, False, None][int(rng.integers(3))])
            for r in range(7) for c in range(-40, 60)]
    rows += [(*rows[k][:4], [True, False][k % 2]) for k in range(0, 300, 7)]
    mask = spark.createDataFrame(rows, "r bigint, c bigint, lat double, lon double, water boolean")
    packed = R.pack_mask(mask)
    assert packed.blocks.count() <= 2 * 7 * 4  # a row per block of the columns and copy, not one per pixel
    assert R.pack_mask(packed) is packed
    rects = [(47.975 + a * 0.013, 47.975 + a * 0.013 + 0.031, -126.3 + b * 0.037, -126.3 + b * 0.037 + 0.22) for a in range(3) for b in range(14)]
    df = spark.createDataFrame(rects, "s double, n double, w double, e double")
    hit = [x for s, n, w, e in rects for x in rows if s <= x[2] < n and w <= x[3] < e]
    got = R.land_share(df, mask).first()
    assert (got["pixels"], got["land"]) == (len(hit), sum(x[4] is False for x in hit))
    assert got["share"] == pytest.approx(got["land"] / got["pixels"])
    far = R.land_share(spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "s double, n double, w double, e double"), packed).first()
    assert (far["pixels"], far["land"], far["share"]) == (0, 0, 0.0)


def test_clip_over_blocks_like_the_pixels_each_cell_owns(spark):
    """Parts from blocks, for cells that straddle them, against runs of the pixels that ``mask_in_cells`` gives."""
    rng = np.random.default_rng(12)
    rows = [(r, c, 47.98 + r * 0.01, -126.02 + c * 0.01, bool(rng.random() < 0.7)) for r in range(10) for c in range(80)]
    mask = spark.createDataFrame(rows, "r bigint, c bigint, lat double, lon double, water boolean")
    cells = [(i, j, 47.975 + i * 0.05, 48.025 + i * 0.05, -126.025 + j * 0.05, -125.975 + j * 0.05) for i in range(2) for j in range(16)]
    frame_ = spark.createDataFrame(cells, CELLS)
    owned = {}
    for x in R.mask_in_cells(frame_, mask, GridConfig()).collect():
        owned.setdefault((x["i"], x["j"]), []).append((x["r"], x["c"], x["water"]))
    want = {}
    for key, pixels in owned.items():
        water = [(r, c) for r, c, wet in pixels if wet]
        want[key] = 1 if len(water) == len(pixels) else len(rect_brute(water)) if water else 0
    assert len(want) == 32
    got = {}
    for x in R.clip_parts(frame_, mask, GridConfig()).collect():
        got[x["i"], x["j"]] = got.get((x["i"], x["j"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
