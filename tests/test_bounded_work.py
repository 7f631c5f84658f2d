"""Operators whose work must stay bounded when one mission, record or place holds most rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.config import SeriesConfig
from brinewave.operators import catalogue as K
from brinewave.operators import chunked, sequences
from brinewave.operators import spatial as P
from brinewave.operators.grid import axis_edges
from brinewave.sources import features


def read_in_name_order(rows):
    """What the rule says, row by row: {name: replaced by}."""
    out, missions = {}, {}
    for name, glider, start, end in sorted(rows, key=lambda r: r[0]):
        held = missions.setdefault((glider, start), {"best": None, "holder": None})
        if held["best"] is None or (end is not None and end > held["best"]):
            if held["holder"] is not None:
                out[held["holder"]] = name
            held["holder"] = name
            held["best"] = end if end is not None else held["best"]
        else:
            out[name] = held["holder"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_superseded_equals_the_loop_over_cut_missions(spark, seed):
    r = random.Random(seed)
    days = [None, *[f"2021-{m:02d}-{d:02d} 00:00:00" for m in range(1, 10) for d in (1, 5, 9)]]
    rows = []
    for k in range(900):
        glider, start = ("one", "2020-01-01") if k % 3 else (r.choice(["a", "b", None]), r.choice(["2020-01-01", None]))
        rows.append((f"n{r.randrange(10 ** 6):06d}-{k}", glider, start, r.choice(days)))
    frame = spark.createDataFrame(rows, "name string, glider string, start string, end string").select(
        "name", "glider", F.col("start").cast("date"), F.col("end").cast("timestamp"))
    want = {n: f"superseded by {by}" for n, by in read_in_name_order(rows).items()}
    for parts in (1, 7, 40):
        assert {x["name"]: x["skip"] for x in K.superseded(frame, parts).collect()} == want
    assert K.superseded(frame.limit(0)).count() == 0


def test_one_mission_is_many_parts(spark):
    names = spark.range(40_000).select(F.format_string("d%06d", "id").alias("name"), F.lit("g").alias("glider"),
                                       F.lit("2020-01-01").cast("date").alias("start"), F.timestamp_seconds("id").alias("end"))
    sizes = [x["count"] for x in chunked.range_parts(names, ["glider", "start", "name"], 16).groupBy(chunked.PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    lost = K.superseded(names, 16)
    assert lost.count() == 39_999
    assert lost.where("skip <> concat('superseded by ', format_string('d%06d', cast(substring(name, 2) AS int) + 1))").count() == 0


def thinned(days, stride, tail):
    keep, last, cut = [], None, max(days) - dt.timedelta(days=tail)
    for d in sorted(days):
        if d > cut:
            keep.append(d)
        elif last is None or (d - last).days >= stride:
            keep.append(d)
            last = d
    return keep


@pytest.mark.parametrize("stride,tail", [(7, 7), (1, 0), (30, 3), (2, 400)])
def test_thinning_by_spans_equals_the_loop(spark, stride, tail):
    r = random.Random(stride)
    first = dt.date(1969, 6, 1)
    records = {"dense": list(range(2_500)), "sparse": r.sample(range(20_000), 60), "mixed": r.sample(range(9_000), 1_500), "one": [5], "two": [0, 4_000]}
    rows = [(k, first + dt.timedelta(days=d), 1.0) for k, days in records.items() for d in days]
    rows += [("mixed", rows[0][1], None), ("dense", first + dt.timedelta(days=9), 2.0)]  # no value; a day twice
    frame, cfg = spark.createDataFrame(rows, "site string, day date, value double"), SeriesConfig(stride_days=stride, tail_days=tail)
    want = {k: thinned([first + dt.timedelta(days=d) for d in days], stride, tail) for k, days in records.items()}
    for span in (10, 512):
        got = sequences.thin_series(frame, cfg=cfg, span=span).select("site", "day").distinct().collect()
        assert {k: sorted(x["day"] for x in got if x["site"] == k) for k in records} == want
    assert sequences.thin_series(spark.createDataFrame([], "site string, day date, value double")).count() == 0


def crowded(n, seed):
    """Most places within a hundredth of the tolerance, others spread out, some repeated."""
    r = np.random.default_rng(seed)
    near = [(-125.0 + x * 3e-4, 48.0 + y * 3e-4) for x, y in r.uniform(-1, 1, (n, 2))]
    far = [(-125.2 + x * 0.4, 47.8 + y * 0.4) for x, y in r.uniform(0, 1, (n // 5, 2))]
    return [(float(x), float(y)) for x, y in near + far + near[:20]]


def places(spark, rows, key):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], f"{key} int, lon double, lat double")


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_nearest_site_in_a_crowd_equals_brute_force(spark, leaf):
    sites, points, tol = crowded(800, 3), crowded(60, 4) + [(-125.0, 48.0), (-130.0, 40.0)], 0.03
    want = {}
    for p, (x, y) in enumerate(points):
        hits = [(max(abs(x - a), abs(y - b)), s) for s, (a, b) in enumerate(sites) if abs(x - a) < tol and abs(y - b) < tol]
        if hits:
            want[p] = min(hits)
    got = P.nearest_site(places(spark, points, "point"), places(spark, sites, "site"), "point", "site", tol, leaf).collect()
    assert {x["point"]: (x["distance"], x["site"]) for x in got} == want
    none = spark.createDataFrame([], "site int, lon double, lat double")
    assert P.nearest_site(places(spark, points, "point"), none, "point", "site", tol, leaf).count() == 0


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_first_track_in_a_crowd_equals_brute_force(spark, leaf):
    fixes, points, tol = crowded(600, 5), crowded(60, 6) + [(-125.0 - 0.05, 48.05), (-130.0, 40.0)], 0.05
    track = random.Random(7).sample(range(5_000), len(fixes))
    want = {}
    for p, (x, y) in enumerate(points):
        hits = [t for t, (a, b) in zip(track, fixes) if abs(x - a) < tol and abs(y - b) < tol]
        if hits:
            want[p] = min(hits)
    frame = spark.createDataFrame([(t, x, y) for t, (x, y) in zip(track, fixes)], "track int, lon double, lat double")
    got = P.first_track(places(spark, points, "point"), frame, "point", "track", tol, leaf).collect()
    assert {x["point"]: x["track"] for x in got} == want


def test_a_crowd_of_sites_is_not_met_by_every_point(spark):
    """All sites within one square of the tolerance: the last bins hold few, and a point keeps few of them."""
    sites = places(spark, crowded(4_000, 8)[:4_000], "site")
    bins = P._Bins(sites, "site", 0.03, 64)
    assert bins._crowd(0) >= 1_000 and bins._crowd(bins.deepest) <= 64
    points = places(spark, crowded(200, 9)[:200], "point")
    compared = []
    whole = P._Bins.positions

    def counted(self, met):
        compared.append(whole(self, met).count())
        return whole(self, met)

    P._Bins.positions = counted
    try:
        assert P.nearest_site(points, sites, "point", "site", 0.03).count() == 200
    finally:
        P._Bins.positions = whole
    assert compared[0] < 200 * 4_000 / 10


def test_axis_without_cells_and_spans(spark):
    points = spark.createDataFrame([(1, 2.0)], "id int, x double")
    none = spark.createDataFrame([], "idx bigint, centre double")
    assert P.snap_axis(points, axis_edges(none), "x", "c").count() == 0
    assert P.nearest_index(points, none, "x", "c").count() == 0


def under_broadcasts(df) -> list[str]:
    """The lines of a plan that lie below a broadcast."""
    lines, depth, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), None, []
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            found.append(line)
            continue
        depth = at if "BroadcastExchange" in line else None
    return found


def test_rows_of_sites_are_not_broadcast(spark):
    """Spark takes a site with a row per bin for as small as the site, and would gather all of them in the driver."""
    sites = spark.range(60).select(F.col("id").alias("site"), (F.col("id") % 7 - 126.5).alias("lon"), (F.col("id") % 5 + 40.1).alias("lat"))
    cells = spark.range(400).select((F.col("id") % 20 * 0.1 - 126.0).alias("lon"), (F.floor(F.col("id") / 20) * 0.1 + 40.0).alias("lat"), F.lit(1.0).alias("value"))
    got = P.distance_to_water(sites, cells, "site")
    below = under_broadcasts(got)
    assert below and not any("Generate" in line or "Range" in line for line in below)
    ocean = [(r["lon"], r["lat"]) for r in cells.collect()]
    for r in got.join(sites, "site").collect():
        k = 111.32 * np.cos(np.radians(r["lat"]))
        assert r["km"] == pytest.approx(min(np.hypot((x - r["lon"]) * k, (y - r["lat"]) * 110.57) for x, y in ocean))
    assert got.count() == 60


def test_nearest_step_has_no_frame_to_the_end(spark):
    """Such a frame is read through again at each row, which is the square of the rows of a chunk."""
    steps = spark.range(90).select(F.concat(F.lit("s"), F.col("id") % 2).alias("site"), F.timestamp_seconds(F.col("id") * F.col("id") * 9_001).alias("time"))
    targets = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 2).alias("site"), F.col("id").alias("target"),
                                      F.timestamp_seconds(F.col("id") * 400_009 - 5_000_000).alias("time"))
    got = P.nearest_step(targets, steps, "site", "target")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    held = {s: sorted(r["time"] for r in steps.where(F.col("site") == s).collect()) for s in ("s0", "s1")}
    rows = got.collect()
    assert len(rows) == 200
    for r in rows:
        assert r["step_time"] == min(held[r["site"]], key=lambda t: (abs(t - r["target_time"]), -t.timestamp()))


def odd_vertices(spark):
    """Short tracks, one longer, and rows without a name, a time or a position."""
    n = F.col("id")
    return spark.range(3_000).select(
        F.when(n % 17 != 0, F.concat(F.lit("t"), F.when(n % 3 == 0, F.lit(0)).otherwise(n % 400))).alias("name"),
        F.when(n % 13 != 0, F.timestamp_seconds(n * 7919 % 90_000)).alias("time"),
        F.when(n % 11 != 0, -126.0 + (n % 100) / 100).alias("lon"), (48.0 + (n * 37 % 100) / 100).alias("lat"))


def test_tracks_that_fit_a_chunk_are_shuffled_once(spark, monkeypatch):
    vertices = odd_vertices(spark)
    names = vertices.select("name").distinct().withColumns({"glider": F.lit("g"), "project": F.lit("p")})

    def made():
        return features.track_lines(chunked.with_row_number(vertices, ["name"], ["time", "lon", "lat"], "seq"), names, piece_points=3)

    whole = made()
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1  # with the deployments; counts and totals of chunks are not joined
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # vertices and distinct names
    got = sorted(map(tuple, whole.collect()), key=str)
    monkeypatch.setattr(chunked, "keys_fit", lambda df, keys, rows=0: False)
    assert got and got == sorted(map(tuple, made().collect()), key=str)


def test_running_sums_of_whole_keys_equal_those_of_chunks(spark):
    df, order = odd_vertices(spark), ["time", "lon", "lat"]
    assert chunked.keys_fit(df, ["name"]) and not chunked.keys_fit(df, ["name"], 900)
    whole = chunked.with_running_sum(df, ["name"], order, F.round(F.col("lat") * 100), "s")
    parts = chunked.with_running_sum(df, ["name"], order, F.round(F.col("lat") * 100), "s", 600)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert chunked.keys_fit(df.limit(0), ["name"])
