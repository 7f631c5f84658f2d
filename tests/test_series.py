from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brinewave.config import Completeness, SeriesConfig, YeardayConfig
from brinewave.operators import chunked, monthly, profile, resample, sequences, yearday
from brinewave.operators.quantile import group_quantiles
from brinewave.plans import dayofyear, registry
from brinewave.plans.registry import Frames


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_daily_threshold_and_empty_days(frame):
    data = [("s", f"2020-01-01 {h:02d}:00:00", 1.0) for h in range(18)]
    data += [("s", f"2020-01-02 {h:02d}:00:00", 2.0) for h in range(17)] + [("s", "2020-01-02 20:00:00", None)]
    data += [("s", "2020-01-04 00:00:00", None)]
    out = resample.to_daily(frame(data, "site string, time timestamp, value double"))
    assert [(str(d), v, n, ok) for _, d, v, n, ok in rows(out, "day")] == [
        ("2020-01-01", 1.0, 18, True), ("2020-01-02", None, 17, False), ("2020-01-03", None, 0, False),
        ("2020-01-04", None, 0, False)]


def daily(frame, spans):
    data = [("s", str(d.date()), 1.0 + d.month, 24, True) for a, b in spans for d in pd.date_range(a, b)]
    return frame(data, "site string, day date, value double, n bigint, ok boolean")


def test_partial_end_is_dropped_only_when_unfinished(frame):
    whole = daily(frame, [("2020-01-01", "2020-02-29")])
    cut = daily(frame, [("2020-01-01", "2020-02-28")])
    assert [str(r[1]) for r in rows(resample.to_monthly(whole), "month")] == ["2020-01-01", "2020-02-01"]
    assert [str(r[1]) for r in rows(resample.to_monthly(cut), "month")] == ["2020-01-01"]
    kept = resample.to_monthly(cut, rule=Completeness(drop_partial_end=False))
    assert [str(r[1]) for r in rows(kept, "month")] == ["2020-01-01", "2020-02-01"]


def test_month_spine_has_empty_months_and_min_days(frame):
    d = daily(frame, [("2020-01-01", "2020-01-14"), ("2020-03-01", "2020-03-31")])
    out = rows(resample.to_monthly(d), "month")
    assert [(str(m), v, n, ok) for _, m, v, n, ok in out] == [
        ("2020-01-01", None, 14, False), ("2020-02-01", None, 0, False), ("2020-03-01", 4.0, 31, True)]


def months(frame):
    rng = np.random.default_rng(2)
    data = []
    for site in ("a", "b"):
        for m in pd.date_range("2010-01-01", "2014-12-01", freq="MS"):
            v = float(rng.normal(10, 2))
            ok = bool(rng.random() > 0.15)
            data.append((site, str(m.date()), v if ok else None, 20, ok))
    return data, frame(data, "site string, month date, value double, n bigint, ok boolean")


def test_climatology_anomalies_and_exceedance_against_pandas(frame):
    data, df = months(frame)
    pdf = pd.DataFrame(data, columns=["site", "month", "value", "n", "ok"])
    pdf["cm"] = pd.to_datetime(pdf.month).dt.month
    use = pdf[pdf.ok]
    clim = use.groupby(["site", "cm"]).value.agg(["mean", "std", "size"])
    got = monthly.climatology(df).toPandas().set_index(["site", "calendar_month"]).sort_index()
    assert len(got) == 24
    assert np.allclose(got.clim, clim["mean"]) and np.allclose(got["std"], clim["std"])
    pdf["anom"] = pdf.value - pdf.set_index(["site", "cm"]).index.map(clim["mean"])
    anom = monthly.anomalies(df)
    thr = monthly.thresholds(anom).toPandas().set_index("site")
    for site, g in pdf.groupby("site"):
        assert np.allclose(thr.loc[site, ["p90", "p95", "p99"]].astype(float), g.anom.dropna().quantile([0.9, 0.95, 0.99]))
    flags = monthly.exceedances(anom).toPandas()
    assert ((flags.severity == 99) == flags.exceeds_p99).all()
    assert (flags.exceeds_p90 | ~flags.exceeds_p95).all()
    assert not flags[flags.anom.isna()].exceeds_p90.any()


def test_common_baseline_uses_shared_months_only(frame):
    data, df = months(frame)
    pdf = pd.DataFrame(data, columns=["site", "month", "value", "n", "ok"]).pivot(index="month", columns="site", values="value")
    both = pdf.dropna()
    cm = pd.to_datetime(both.index).month
    want = both - both.groupby(cm).transform("mean")
    got = monthly.common_baseline(df, "a", "b").toPandas().set_index("month").sort_index()
    assert got.ok.sum() == len(both)
    assert np.allclose(got[got.ok].anom_a, want.a) and np.allclose(got[got.ok].anom_b, want.b)
    joint = monthly.common_baseline(df, "a", "b").dropna(subset=["anom_a", "anom_b"])
    assert monthly.correlation(joint).first()["r"] == pytest.approx(want.a.corr(want.b))


def test_unfinished_month_is_shown_but_does_not_count(frame):
    d = daily(frame, [("2019-01-01", "2021-01-20")])
    d = d.withColumn("value", F.when(F.col("day") >= "2021-01-01", 50.0).otherwise(F.col("value")))
    kept = monthly.series_anomalies(d)
    last = kept.where("month = date'2021-01-01'").first()
    assert last["partial"] and last["clim"] == 2.0 and last["anom"] == 48.0
    mixed = monthly.series_anomalies(d, partial_in_baseline=True).where("month = date'2021-01-01'").first()
    assert mixed["clim"] == pytest.approx((2 + 2 + 50) / 3)


def record(seed=5, years=4):
    rng = np.random.default_rng(seed)
    t = pd.date_range("2015-01-01", periods=years * 365 * 3, freq="8h")
    return pd.DataFrame({"site": "a", "time": t, "value": (10 + 4 * np.sin(t.dayofyear / 58) + rng.normal(0, 1, len(t))).round(3)})


def brute_climatology(pdf, cfg):
    doy = pdf.time.dt.dayofyear.to_numpy()
    yd = np.where(pdf.time.dt.is_leap_year & (doy >= 60), doy - 1, doy)
    v, y = pdf.value.to_numpy(), pdf.time.dt.year.to_numpy()
    out = []
    for day in range(1, 366):
        pick = np.isin(yd, (np.arange(day - cfg.window_days, day + cfg.window_days + 1) - 1) % 365 + 1)
        w = v[pick]
        ok = len(np.unique(y[pick])) >= cfg.min_years
        out.append([w.mean() if ok else np.nan, w.std(ddof=1) if ok else np.nan, len(w), len(np.unique(y[pick])),
                    *(np.percentile(w, cfg.percentiles) if ok else [np.nan] * len(cfg.percentiles))])
    out = np.array(out)
    if cfg.smooth_days > 1 and not np.isnan(out[:, 0]).any():
        k = cfg.smooth_days // 2
        for c in (0, 1):
            out[:, c] = np.mean([np.roll(out[:, c], s) for s in range(-k, k + 1)], axis=0)
    return out


def test_yearday_climatology_equals_numpy(spark):
    pdf, cfg = record(), YeardayConfig()
    got = yearday.build_climatology(spark.createDataFrame(pdf), cfg=cfg).orderBy("yearday").toPandas()
    want = brute_climatology(pdf, cfg)
    cols = ["mean", "sd", "n", "n_years", *[f"p{p:02d}" for p in cfg.percentiles]]
    assert len(got) == 365
    assert np.allclose(got[cols].to_numpy(float), want)
    assert np.allclose(got.lo2, got["mean"] - 2 * got.sd)


def test_too_few_years_leave_statistics_null_but_counts(spark):
    got = yearday.build_climatology(spark.createDataFrame(record(years=2))).toPandas()
    assert got["mean"].isna().all() and got.p50.isna().all() and (got.n > 0).all() and got.n_years.max() <= 2


def test_readings_scored_with_exact_rank(spark, frame):
    pdf = record()
    obs = spark.createDataFrame(pdf)
    clim = yearday.build_climatology(obs, percentiles=False)
    asks = [(1, "a", "2020-02-29 03:00:00", 12.0), (2, "a", "2020-12-31 00:00:00", -50.0), (3, "a", "2020-01-01 00:00:00", 99.0),
            (4, "a", "2020-01-01 00:00:00", float(pdf.value.iloc[0])), (5, "a", "2020-02-28 00:00:00", 12.0)]
    out = yearday.score_readings(frame(asks, "reading_id bigint, site string, time timestamp, value double"), clim, obs).toPandas().set_index("reading_id")
    doy = pdf.time.dt.dayofyear.to_numpy()
    yd = np.where(pdf.time.dt.is_leap_year & (doy >= 60), doy - 1, doy)
    for i, _, _, value in asks:
        day = out.loc[i, "yearday"]
        pool = pdf.value.to_numpy()[np.isin(yd, (np.arange(day - 7, day + 8) - 1) % 365 + 1)]
        assert out.loc[i, "percentile"] == pytest.approx((pool < value).mean() * 100)
        assert out.loc[i, "n_compared"] == len(pool) and out.loc[i, "window_min"] == pool.min()
    assert out.loc[1, "yearday"] == 59 and out.loc[5, "yearday"] == 59


ODD_READINGS = [
    ("r1", "a", "2020-02-29 03:00:00", 12.0), ("r2", "a", "2020-06-01 00:00:00", -0.0), ("r3", "a", "2020-06-01 00:00:00", 0.0),
    ("none", "a", "2020-06-01 00:00:00", None), ("late", "a", None, 11.0), ("away", "z", "2020-06-01 00:00:00", 11.0), ("key", None, "2020-06-01 00:00:00", 11.0),
    (None, "a", "2020-06-01 00:00:00", 11.0), ("nan", "a", "2020-06-01 00:00:00", float("nan")),
    ("two", "a", "2020-06-01 00:00:00", 9.0), ("two", "a", "2020-06-02 00:00:00", 13.0), ("half", "a", "2020-06-01 00:00:00", 9.0), ("half", "a", "2020-06-01 00:00:00", None),
    *[(f"c{i}", "a", "2020-06-01 00:00:00", 10.0 + i % 4 / 8) for i in range(40)]]


@pytest.mark.parametrize("most", [3, 500_000])
def test_window_rank_of_odd_readings_equals_brute_force(spark, frame, most):
    pdf = record()
    pdf.loc[pdf.index % 5 == 0, "value"] = pdf.value.round(1)
    pdf.loc[pdf.index % 50 == 0, "value"] = 0.0
    readings = frame(ODD_READINGS, "reading_id string, site string, time timestamp, value double")
    doy = pdf.time.dt.dayofyear.to_numpy()
    yd = np.where(pdf.time.dt.is_leap_year & (doy >= 60), doy - 1, doy)

    def rank(reading_id, site, time, value):
        if site != "a" or time is None or value is None or reading_id is None:
            return None
        at = pd.Timestamp(time).dayofyear - 1  # 2020 after February
        held = pdf.value.to_numpy()[np.isin(yd, (np.arange(at - 7, at + 8) - 1) % 365 + 1)]
        below = len(held) if np.isnan(value) else (held < value).sum()
        return (round(below / len(held) * 100, 6), len(held), held.min(), held.max())

    want = []
    for row in ODD_READINGS:  # rows of one id have the ranks of all of them
        ranks = [rank(*r) for r in ODD_READINGS if r[0] is not None and r[0] == row[0]]
        want += [(row[0], row[1], str(row[3]), r) for r in [r for r in ranks if r] or [None]]
    got = yearday.window_rank(readings, spark.createDataFrame(pdf), most=most).collect()
    got = [(r["reading_id"], r["site"], str(r["value"]), r["n_compared"] and (round(r["percentile"], 6), r["n_compared"], r["window_min"], r["window_max"])) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranks_travel_with_their_readings(spark, frame):
    obs = spark.createDataFrame(record())
    readings = spark.range(200).select("id", F.lit("a").alias("site"), F.timestamp_seconds(F.col("id") * 86_400).alias("time"),
                                       (F.col("id") % 20 + 0.5).alias("value")).withColumnRenamed("id", "reading_id")
    scored = yearday.score_readings(readings, yearday.build_climatology(obs, percentiles=False), obs, strict=False)
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "reading_id" in line]  # they were joined back by id
    assert scored.count() == 200 and scored.where("percentile is null").count() == 0


def test_reading_without_climatology_is_an_error(spark, frame):
    obs = spark.createDataFrame(record(years=2))
    clim = yearday.build_climatology(obs, percentiles=False)
    ask = frame([(1, "a", "2020-01-01 00:00:00", 1.0)], "reading_id bigint, site string, time timestamp, value double")
    with pytest.raises(Exception, match="no usable climatology"):
        yearday.score_readings(ask, clim, obs).collect()
    scored = yearday.classify_series(clim, ask).first()
    assert scored["band"] == 2 and scored["label"] == "no climatology" and scored["scored"] is False


def test_group_quantiles_with_copies_and_one_hot_key(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": ["hot"] * 5000 + ["one"] + ["two"] * 2, "v": np.r_[rng.integers(0, 40, 4000), np.full(1000, 7), 3.5, 1.0, 2.0]})
    got = group_quantiles(spark.createDataFrame(pdf), ["k"], "v", [0.0, 0.02, 0.5, 0.9, 1.0]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, "q"], np.quantile(g.v, [0.0, 0.02, 0.5, 0.9, 1.0]))


@pytest.mark.parametrize("seconds", [60, 3600, 86_400 * 400])
def test_chunked_windows_equal_plain_windows(spark, seconds):
    rng = np.random.default_rng(4)
    t = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40_000, 400)), unit="s")
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "t": t, "id": range(400)}).sort_values(["k", "t", "id"])
    df = spark.createDataFrame(pdf)
    got = chunked.with_previous(df, ["k"], ["t", "id"], ["id"], "prev", seconds)
    got = chunked.with_next(got.select("k", "t", "id", F.col("prev.id").alias("p")), ["k"], ["t", "id"], ["id"], "next", seconds)
    got = chunked.with_row_number(got.select("k", "t", "id", "p", F.col("next.id").alias("n")), ["k"], ["t", "id"], "row", seconds)
    got = got.toPandas().sort_values(["k", "t", "id"])
    g = pdf.groupby("k").id
    assert got.p.fillna(-1).tolist() == g.shift(1).fillna(-1).tolist()
    assert got.n.fillna(-1).tolist() == g.shift(-1).fillna(-1).tolist()
    assert got.row.tolist() == (g.cumcount() + 1).tolist()


def test_gap_table_measures_valid_samples(frame):
    df = frame([("s", "2020-01-01 00:00:00", 1.0), ("s", "2020-01-05 00:00:00", None), ("s", "2020-01-08 00:00:00", 1.0),
                ("s", "2020-01-15 01:00:00", 1.0), ("s", "2020-01-15 01:00:00", 1.0)], "site string, time timestamp, value double")
    out = profile.gap_table(df).collect()
    assert [(str(r["gap_start"]), str(r["gap_end"]), r["missing_hours"]) for r in out] == [
        ("2020-01-08 00:00:00", "2020-01-15 01:00:00", 168)]  # exactly seven days is not longer


def test_sampling_steps_count_copies_as_zero(frame):
    df = frame([("s", "2020-01-01 00:00:00"), ("s", "2020-01-01 00:00:00"), ("s", "2020-01-01 01:00:00"), ("s", "2020-01-03 00:00:00")],
               "site string, time timestamp")
    assert {(r["step_seconds"], r["n"]) for r in profile.sampling_steps(df).collect()} == {(0.0, 1), (3600.0, 1), (169200.0, 1)}


def test_arrival_order(frame):
    df = frame([("a", "2020-01-01 00:00:00", 1), ("a", "2020-01-02 00:00:00", 200_000), ("b", "2020-01-02 00:00:00", 1),
                ("b", "2020-01-01 00:00:00", 300_000)], "site string, time timestamp, seq bigint")
    assert {r["site"]: r["monotonic"] for r in profile.arrival_order(df, "site", "time", "seq").collect()} == {"a": True, "b": False}


def test_thinning_is_greedy_and_keeps_the_tail(frame):
    days = pd.date_range("2020-01-01", "2020-03-01").append(pd.DatetimeIndex(["2020-04-20"]))
    df = frame([("s", str(d.date()), 1.0) for d in days], "site string, day date, value double")
    got = [str(r["day"]) for r in sequences.thin_series(df).orderBy("day").collect()]
    keep, last, cutoff = [], None, days.max() - pd.Timedelta(days=7)
    for d in days:
        if d > cutoff or last is None or (d - last).days >= 7:
            keep.append(str(d.date()))
            last = d if d <= cutoff else last
    assert got == keep


def test_gap_breaks_are_inserted_once(frame):
    df = frame([("s", "2020-01-01", 1.0), ("s", "2020-01-22", 2.0), ("s", "2020-02-13", 3.0)], "site string, day date, value double")
    out = [(str(r["day"]), r["value"]) for r in sequences.break_gaps(df, cfg=SeriesConfig()).orderBy("day").collect()]
    assert out == [("2020-01-01", 1.0), ("2020-01-22", 2.0), ("2020-01-23", None), ("2020-02-13", 3.0)]


def test_dedup_treats_null_depths_as_equal_and_newest_fix_breaks_ties(frame):
    df = frame([("a", "2020-01-01 00:00:00", None, 2), ("a", "2020-01-01 00:00:00", None, 1), ("a", "2020-01-01 00:00:00", 1.0, 3)],
               "deployment string, time timestamp, depth double, id bigint")
    assert sorted(r["id"] for r in sequences.dedup_observations(df, ["id"]).collect()) == [1, 3]
    assert sequences.newest_fix(df, tie="id").first()["id"] == 1


def test_trailing_window_edges(frame):
    df = frame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-09 00:00:00"), ("b", "2019-01-01 00:00:00")], "deployment string, time timestamp")
    assert sequences.trailing_own(df, 8).count() == 3
    assert sequences.trailing_own(df, 8, strict=True).count() == 2
    assert sequences.trailing_now(df, "2020-01-09", 8).count() == 2


def test_calendar_chunks_do_not_overlap(frame):
    df = frame([("s", "2019-07-22", "2022-03-01")], "site string, a date, b date")
    out = [(str(r["chunk_start"]), str(r["chunk_end"])) for r in sequences.calendar_chunks(df, "site", "a", "b").orderBy("chunk").collect()]
    assert out == [("2019-07-22", "2020-07-21"), ("2020-07-22", "2021-07-21"), ("2021-07-22", "2022-03-01")]


@pytest.mark.parametrize("shape", ["outlier", "crowd", "repeated", "two values"])
def test_quantile_cells_stay_small_and_exact(spark, shape):
    """One extreme outlier, a third of all rows within a thousandth of the range, a value that a third repeat."""
    from brinewave.operators.quantile import build_pool, pool_quantiles

    rng = np.random.default_rng(8)
    n = 12_000
    v = rng.normal(10, 1, n)
    if shape == "outlier":
        v[0] = 1e15
    elif shape == "crowd":
        v[: n // 3] = 10 + rng.uniform(0, 0.006, n // 3)
        v[n // 3] = -1e9
    elif shape == "repeated":
        v[: n // 3] = 10.0
    else:
        v = rng.choice([1.0, 2.0], n)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "v": v})
    most = 100
    pool = build_pool(spark.createDataFrame(pdf), ["k"], "v", ranks=4, most=most)
    cells = pool.cells.groupBy("k", "_b").agg(F.sum("_c").alias("n"), F.min("_min").alias("low"), F.max("_max").alias("high")).toPandas()
    assert (cells[cells.low < cells.high].n <= most).all()
    assert cells.sort_values(["k", "_b"]).groupby("k").apply(lambda c: (c.high.shift() < c.low).iloc[1:].all(), include_groups=False).all()
    asked = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = pool_quantiles(pool, asked).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, "q"], np.quantile(g.v, asked), rtol=1e-12)
    # values that are not in the record find their place between its cells
    marks = spark.createDataFrame([("a", float(x)) for x in (-2e9, 9.5, 10.0, 11.25, 2e15)], "k string, _v double")
    placed = [r["_b"] for r in pool.place(marks).orderBy("_v").collect()]
    assert placed == sorted(placed)


def test_deviation_with_split_cells(spark):
    from brinewave.operators.quantile import build_pool, pool_deviation, pool_quantiles

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": "a", "v": np.concatenate([rng.normal(0, 1e-6, 3000), rng.normal(0, 5, 3000), [1e12]])})
    pool = build_pool(spark.createDataFrame(pdf), ["k"], "v", most=50)
    centre = pool_quantiles(pool, [0.5]).select("k", "_t", F.element_at("q", 1).alias("centre"))
    got = pool_deviation(pool, centre).first()["spread"]
    assert np.isclose(got, np.median(np.abs(pdf.v - np.median(pdf.v))), rtol=1e-12)


def test_coverage_of_each_deployment_is_ordered(frame):
    df = frame([("a", 1.0, None), ("a", 2.0, 5.0), ("b", None, 1.0), ("b", float("nan"), None), ("c", None, None)], "deployment string, temperature double, salinity double")
    got = [tuple(r) for r in profile.coverage_by(df, names=("temperature", "salinity")).orderBy("deployment", "place").collect()]
    assert got == [("a", "temperature", 100.0, 1), ("a", "salinity", 50.0, 2), ("b", "salinity", 50.0, 1), ("b", "temperature", 0.0, 2),
                   ("c", "salinity", 0.0, 1), ("c", "temperature", 0.0, 2)]


def test_frames_unite_by_name(frame):
    a = frame([("a", 1.0)], "deployment string, temperature double")
    b = frame([(2.0, "b", 3)], "cdom double, deployment string, n int")
    got = {r["deployment"]: r.asDict() for r in sequences.united([a, b]).collect()}
    assert got == {"a": {"deployment": "a", "temperature": 1.0, "cdom": None, "n": None}, "b": {"deployment": "b", "temperature": None, "cdom": 2.0, "n": 3}}
    with pytest.raises(ValueError, match="temperature is double in one frame and string"):
        sequences.united([a, frame([("c", "x")], "deployment string, temperature string")])
    with pytest.raises(ValueError):
        sequences.united([])


def test_score_table_has_the_archive_and_the_sites_in_order(frame):
    clim = frame([("s", 5, 10.0, 2.0, 8.0, 12.0, 6.0, 14.0), ("t", 5, 1.0, 1.0, 0.0, 2.0, -1.0, 3.0)],
                 "site string, yearday int, mean double, sd double, lo1 double, hi1 double, lo2 double, hi2 double")
    obs = frame([("s", "2020-01-05 00:00:00", 9.0), ("s", "2020-01-06 00:00:00", 11.0), ("s", "2020-01-07 00:00:00", None), ("t", "2020-01-04 00:00:00", 1.0)],
                "site string, time timestamp, value double")
    readings = frame([("r1", "s", "2021-01-05 00:00:00", 15.0), ("r2", "t", "2021-01-05 00:00:00", 1.5)], "reading_id string, site string, time timestamp, value double")
    sites = frame([("s", 20.0), ("t", None)], "site string, depth double")
    got = {r["reading_id"]: r for r in yearday.score_table(readings, clim, obs, sites).collect()}
    r = got["r1"]
    assert (r["place"], r["depth"], r["reading"], r["lo1"], r["hi2"], r["z"], r["percentile"]) == (2, 20.0, 15.0, 8.0, 14.0, 2.5, 100.0)
    assert (r["archived_last"], str(r["archived_time"])) == (11.0, "2020-01-06 00:00:00") and r["verdict"] == "extreme warm (outside 2 sigma)"
    assert (got["r2"]["place"], got["r2"]["depth"], got["r2"]["verdict"]) == (1, None, "normal")


def order_lines(spark, folder):
    """Orders over years, one of them twice, and lines that come twice or lack a number."""
    when = F.timestamp_seconds(F.lit(8 * 365 * 86_400) + F.col("o_orderkey") * 86_400 * 5)
    orders = spark.range(400).select(F.col("id").alias("o_orderkey")).select(
        "o_orderkey", when.alias("o_orderdate"), (F.col("o_orderkey") * 317 % 1000 * 100.0).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    orders = orders.unionByName(orders.where("o_orderkey = 8").withColumn("o_totalprice", F.lit(7.0)))
    lines = orders.dropDuplicates(["o_orderkey"]).select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 7 > 0, F.lit(1)).cast("bigint").alias("l_linenumber"),
        F.lit(3).cast("bigint").alias("l_partkey"), F.lit(4).cast("bigint").alias("l_suppkey"), F.col("o_orderdate").alias("l_shipdate"),
        (F.col("o_orderkey") * 211 % 1000 * 100.0).alias("l_extendedprice"))
    lines = lines.unionByName(lines.where("l_orderkey in (8, 9)"))
    for name, rows_of in (("orders", orders), ("lineitem", lines)):
        rows_of.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_readings_know_which_of_them_share_an_id(spark, tmp_path):
    order_lines(spark, tmp_path)
    found = dayofyear.readings(Frames(spark, str(tmp_path))).toPandas()
    shared = found.reading_id.duplicated(keep=False)
    assert set(found.reading_id[shared]) == {"8-1-1", "8-1-2"} and len(found) == 404
    assert (found.repeated == shared).all()


@pytest.mark.parametrize("apart", [True, False])
def test_known_repeated_ids_and_hashes_change_no_score(spark, tmp_path, monkeypatch, apart):
    order_lines(spark, tmp_path)
    v = Frames(spark, str(tmp_path))
    clim = dayofyear.station_clim(v, False)
    plain = sorted(map(str, yearday.score_readings(dayofyear.readings(v), clim, v.station, strict=False).collect()))
    if not apart:
        monkeypatch.setattr(yearday, "hashes_apart", lambda *a: False)
    asked = []
    monkeypatch.setattr(yearday, "shared_ids", lambda r, f=yearday.shared_ids: asked.append(r.count()) or f(r))
    told = yearday.score_readings(dayofyear.readings(v), clim, v.station, strict=False, repeated="repeated")
    assert sorted(map(str, told.collect())) == plain and len(plain) == 404 + 4  # rows of an id have the ranks of both
    assert asked == [4]  # all readings were counted by id


def test_table_of_readings_rounds_by_row_only_what_is_made_by_row(spark, tmp_path):
    order_lines(spark, tmp_path)
    out = registry.QUERIES["readings_table"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert plan.count("round(") == 7 and plan.count("rint(") > 0  # twelve, all of them by text
    got = out.toPandas()
    doubles = ["reading", "clim_mean", "sd", "lo1", "hi1", "lo2", "hi2", "anomaly", "z", "percentile", "archived_last"]
    assert np.allclose(got[doubles], got[doubles].round(6), rtol=0, atol=1e-12, equal_nan=True)


def test_hashes_apart(frame):
    cells = frame([("a", 1), ("b", 1), ("a", 2)], "site string, t int")
    assert yearday.hashes_apart(cells, ["site", "t"]) and not yearday.hashes_apart(cells, ["t"])
