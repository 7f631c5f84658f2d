from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brinewave.config import ScreenConfig
from brinewave.operators import screening as S
from brinewave.operators.rolling import range_medians, time_frames


def test_gross_range_blanks_and_keeps_rows_with_any_science(frame):
    df = frame([
        ("a", 30.0, 42.0, 5.0), ("b", 30.0000001, 35.0, 5.0), ("c", 99.0, 1.0, 5.0), ("d", None, None, 5.0),
        ("e", 10.0, None, 5000.0), ("f", float("nan"), 1.0, 5.0)],
        "id string, temperature double, salinity double, depth double")
    out = {r["id"]: r for r in S.gross_range(df).collect()}
    assert set(out) == {"a", "b", "e"}
    assert out["b"]["temperature"] is None and out["b"]["salinity"] == 35.0
    assert out["e"]["depth"] is None
    tally = {r["variable"]: (r["present"], r["flagged"]) for r in S.range_tally(df).collect()}
    assert tally == {"temperature": (4, 2), "salinity": (4, 2), "depth": (6, 1)}


def test_no_science_column_drops_nothing(frame):
    df = frame([("a", 5.0)], "id string, depth double")
    assert S.gross_range(df).count() == 1


def test_copied_channel_needs_ten_shared_values_and_cascades(frame):
    rows = [("x", float(i), float(i), float(i)) for i in range(10)]
    rows += [("y", float(i), float(i), None) for i in range(9)]
    rows += [("z", float(i), float(i) + (i == 3), float(i) + (i == 3)) for i in range(10)]
    df = frame(rows, "deployment string, temperature double, chlorophyll double, oxygen_concentration double")
    out = S.blank_copied_channels(df).groupBy("deployment").agg(
        F.count("temperature"), F.count("chlorophyll"), F.count("oxygen_concentration")).collect()
    got = {r[0]: tuple(r)[1:] for r in out}
    assert got["x"] == (10, 0, 0)
    assert got["y"] == (9, 9, 0)
    assert got["z"] == (10, 10, 0)  # oxygen copies chlorophyll there, which itself stays


@pytest.mark.parametrize("chunk_hours", [14, 31, 168])
def test_despike_equals_pandas_across_chunks(spark, chunk_hours):
    rng = np.random.default_rng(7)
    frames = []
    for site in ("a", "b"):
        at = np.sort(rng.choice(np.arange(0, 20 * 24 * 12), 900, replace=False)) * 5
        values = 10 + np.sin(at / 400) + rng.normal(0, 0.6, at.size)
        values[rng.choice(at.size, 40, replace=False)] += 6
        frames.append(pd.DataFrame({"site": site, "time": pd.Timestamp("2020-01-01") + pd.to_timedelta(at, unit="m"),
                                    "value": values}))
    pdf = pd.concat(frames)
    want = []
    for site, g in pdf.groupby("site"):
        s = g.set_index("time")["value"]
        med = s.rolling("13h", center=True, min_periods=5).median()
        res = s - med
        mad = res.abs().rolling("13h", center=True, min_periods=5).median()
        keep = s[res.abs() <= np.maximum(1.5, 5 * 1.4826 * mad)]
        want += [(site, t, v) for t, v in keep.items()]
    got = S.despike(spark.createDataFrame(pdf), chunk_hours=chunk_hours).toPandas()
    assert sorted(zip(got.site, got.time, got.value)) == sorted(want)
    assert len(got) < len(pdf)


def test_yearday_outliers_equal_numpy(spark):
    rng = np.random.default_rng(3)
    t = pd.date_range("2018-01-01", "2020-12-31", freq="18h")
    pdf = pd.DataFrame({"site": "a", "time": t, "value": rng.normal(10, 1, len(t)).round(2)})
    pdf.loc[::37, "value"] += 9
    # a site with one value only: zero scale drops any deviation
    flat = pd.DataFrame({"site": "b", "time": t[:60], "value": 5.0})
    flat.loc[10, "value"] = 5.1
    cfg = ScreenConfig(sds=3.0)

    def brute(g):
        doy = g.time.dt.dayofyear.to_numpy()
        yd = np.where(g.time.dt.is_leap_year & (doy >= 60), doy - 1, doy)
        keep = []
        for d, v in zip(yd, g.value):
            days = (np.arange(d - 7, d + 8) - 1) % 365 + 1
            pool = g.value.to_numpy()[np.isin(yd, days)]
            c = np.median(pool)
            keep.append(not abs(v - c) > 3.0 * 1.4826 * np.median(np.abs(pool - c)))
        return g[np.array(keep)]

    want = pd.concat([brute(pdf), brute(flat)])
    got = S.drop_yearday_outliers(spark.createDataFrame(pd.concat([pdf, flat])), cfg=cfg).toPandas()
    assert sorted(zip(got.site, got.time, got.value)) == sorted(zip(want.site, want.time, want.value))
    assert len(want) < len(pdf) + len(flat)


def held_rows():
    rows = [("a", f"2020-01-01 {h:02d}:00:00", -125.0, 48.0) for h in range(0, 9)]       # 8 h exactly
    rows += [("a", "2020-01-01 09:00:00", -125.1, 48.0)]
    rows += [("a", f"2020-01-0{2 + h // 24} {h % 24:02d}:00:00", -125.2, 48.1) for h in range(0, 30)]  # 29 h over midnight
    rows += [("b", f"2020-01-01 {h:02d}:00:00", -125.0, 48.0) for h in range(0, 8)]      # 7 h
    rows += [("b", f"2020-01-01 {h:02d}:30:00", None, 48.0) for h in range(9, 22)]       # nulls never hold
    rows += [("c", f"2020-01-{1 + d:02d} 12:00:00", -125.3, 48.2) for d in range(0, 5)]   # one fix a day, same place
    return rows


@pytest.mark.parametrize("seconds", [3600, 7 * 3600, 86_400, 366 * 86_400])
def test_held_positions_do_not_depend_on_chunks(frame, seconds):
    df = frame(held_rows(), "deployment string, time timestamp, longitude double, latitude double")
    runs = {(r["deployment"], str(r["held_from"]), str(r["held_to"])) for r in S.held_runs(df, seconds=seconds).collect()}
    assert runs == {("a", "2020-01-01 00:00:00", "2020-01-01 08:00:00"), ("a", "2020-01-02 00:00:00", "2020-01-03 05:00:00"),
                    ("c", "2020-01-01 12:00:00", "2020-01-05 12:00:00")}
    kept = S.mask_held_positions(df, seconds=seconds)
    assert {r["deployment"]: r["count"] for r in kept.groupBy("deployment").count().collect()} == {"a": 1, "b": 21}
    assert S.mask_held_positions(df, max_hold_hours=None).count() == df.count()


def test_product_truth(frame):
    names = frame([("a",), ("b",), ("c",)], "deployment string")
    df = frame([("a", 1.0), ("a", None), ("b", float("nan"))], "deployment string, temperature_adjusted double")
    out = {r["deployment"]: (r["accepted"], r["reason"]) for r in S.product_truth(df, names).collect()}
    assert out["a"] == (True, "1 finite temperature_adjusted points")
    assert out["b"] == out["c"] == (False, "temperature_adjusted present but entirely NaN")
    raw = frame([("a", 1.0)], "deployment string, salinity_adjusted double")
    assert "has: salinity_adjusted" in S.product_truth(raw, names).first()["reason"]


def test_buoy_tally_adds_up(spark):
    rng = np.random.default_rng(1)
    t = pd.date_range("2019-01-01", periods=600, freq="1h")
    v = rng.normal(10, 0.3, 600)
    v[5], v[100], v[300] = -51.0, 79.0, 18.0
    pdf = pd.DataFrame({"site": "a", "time": t, "value": v})
    row = S.screen_tally(spark.createDataFrame(pdf)).first()
    assert row["raw_records"] == 600 and row["out_of_range"] == 2 and row["spikes"] >= 1
    assert row["kept"] == row["hourly_bins"] - row["day_of_year_outliers"]
    assert S.screen_buoy(spark.createDataFrame(pdf)).count() == row["kept"]


def test_chunks_follow_the_density(frame):
    from brinewave.operators import chunked

    rows = [("a", f"2020-01-01 00:{m:02d}:{s:02d}", float(m)) for m in range(30) for s in range(40)] + [("b", "2020-03-01 00:00:00", 1.0)]
    df = frame(rows, "site string, time timestamp, value double")
    assert chunked.width_for(df, ["site"], "time", rows=1200) == 86_400
    assert chunked.width_for(df, ["site"], "time", rows=100) == 60
    narrow = chunked.width_for(df, ["site"], "time", rows=10)
    assert narrow == 1
    for seconds in (86_400, 60, narrow):
        got = chunked.with_row_number(df, ["site"], ["time"], "row", seconds).where("site = 'a'").orderBy("time").collect()
        assert [r["row"] for r in got] == list(range(1, 1201))
    assert chunked.width_for(df.limit(0), ["site"], "time") == 86_400


@pytest.mark.parametrize("kind", ["few values", "many values", "one value", "with gaps"])
def test_range_medians_by_ordering_each_range(kind):
    rng = np.random.default_rng(2)
    n = 700
    values = {"few values": rng.choice([1.0, 2.0, 7.5], n), "one value": np.full(n, 3.0)}.get(kind, rng.normal(0, 1, n))
    if kind == "with gaps":
        values[rng.choice(n, 300, replace=False)] = np.nan
    first = rng.integers(0, n + 1, 400)
    last = np.minimum(first + rng.integers(0, 120, 400), n)
    got = range_medians(values, first, last, least=5)
    for a, b, x in zip(first, last, got):
        held = values[a:b][~np.isnan(values[a:b])]
        assert (np.isnan(x) and len(held) < 5) or x == np.median(held)
    assert len(range_medians(np.empty(0), np.zeros(1, int), np.zeros(1, int))) == 1


def test_cost_of_medians_follows_rows_not_frames():
    """Frames of 60,000 rows take about as long as frames of 6 rows."""
    rng = np.random.default_rng(5)
    values, at = rng.normal(0, 1, 120_000), np.arange(120_000)
    seconds = []
    for half in (3, 3, 30_000):
        start = time.perf_counter()
        range_medians(values, *time_frames(at, half))
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 6 * seconds[1] + 0.5


def test_despike_of_dense_rows(spark):
    """Ten readings a minute: a frame holds 7,800 rows."""
    rng = np.random.default_rng(6)
    values = rng.normal(0, 0.3, 30_000)
    values[::997] += 9
    pdf = pd.DataFrame({"site": "a", "time": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(30_000) * 6, unit="s"), "value": values})
    s = pdf.set_index("time")["value"]
    res = s - s.rolling("13h", center=True, min_periods=5).median()
    mad = res.abs().rolling("13h", center=True, min_periods=5).median()
    want = s[res.abs() <= np.maximum(1.5, 5 * 1.4826 * mad)]
    got = S.despike(spark.createDataFrame(pdf)).toPandas()
    assert sorted(got.time) == list(want.index) and len(got) == 30_000 - 31
