from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from brinewave.operators import catalogue as K
from brinewave.operators import incremental as I
from brinewave.operators.profile import high_water_marks
from brinewave.schema import OBSERVATIONS
from brinewave.sources import archive, features


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def obs(spark, rows):
    """(deployment, time, depth, temperature) as full observations."""
    raw = spark.createDataFrame(rows, "deployment string, t string, depth double, temperature double")
    named = {"time": F.col("t").cast("timestamp"), "depth": F.col("depth"), "temperature": F.col("temperature"),
             "deployment": F.col("deployment"), "glider": F.split_part("deployment", F.lit("-"), F.lit(2)),
             "latitude": F.lit(48.5), "longitude": F.lit(-125.5)}
    return raw.select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATIONS])


def test_update_is_idempotent_and_back_fills(spark, folder):
    first = [("o-a-20200101", "2020-01-01 00:00:00", 1.0, 10.0), ("o-a-20200101", "2020-01-02 00:00:00", 1.0, 99.0),
             ("o-a-20200101", "2020-01-01 00:00:00", 1.0, 11.0)]
    assert I.update_archive(spark, obs(spark, first), folder, "realtime")["appended"] == 1
    assert I.update_archive(spark, obs(spark, first), folder, "realtime")["appended"] == 0
    later = first + [("o-a-20200101", "2019-12-31 00:00:00", 1.0, 9.0), ("o-a-20200101", "2020-02-05 00:00:00", 1.0, 9.0),
                     ("o-b-20200101", "2019-01-01 00:00:00", 1.0, 9.0)]
    done = I.update_archive(spark, obs(spark, later), folder, "realtime")
    assert done["appended"] == 2 and done["total"] == 3  # older than the mark is refused, a new deployment passes
    assert I.update_archive(spark, obs(spark, later), folder, "delayed")["appended"] == 4  # feeds are apart
    notes = [r["appended"] for r in archive.read_history(spark, folder).orderBy("at").collect()]
    assert notes == [1, 2, 4]


def test_append_of_nothing_writes_nothing(spark, folder):
    assert archive.append_archive(spark, folder, obs(spark, []), "realtime") == 0
    assert not archive.archive_exists(spark, folder)
    empty = archive.read_archive(spark, folder, variables=["cdom"])
    assert empty.columns[-1] == "cdom" and empty.count() == 0


def test_archive_window_is_inclusive_and_prunes(spark, folder):
    rows = [("o-a-20200101", f"2020-0{m}-01 00:00:00", 1.0, 10.0) for m in range(1, 7)]
    archive.append_archive(spark, folder, obs(spark, rows), "realtime")
    got = archive.read_archive(spark, folder, "realtime", "2020-02-01", "2020-04-01", variables=["temperature"])
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "salinity" not in plan and "PartitionFilters" in plan
    assert archive.read_archive(spark, folder, last_days=31, now="2020-06-01").count() == 2
    with pytest.raises(ValueError, match="not measured here"):
        archive.read_archive(spark, folder, variables=["nope"])


def test_marks_are_strict_per_deployment(spark):
    held = obs(spark, [("a-a-1", "2020-01-02 00:00:00", 1.0, 1.0)])
    rows = obs(spark, [("a-a-1", "2020-01-02 00:00:00", 1.0, 1.0), ("a-a-1", "2020-01-02 00:00:01", 1.0, 1.0), ("b-b-1", "2000-01-01 00:00:00", 1.0, 1.0)])
    assert I.after_marks(rows, high_water_marks(held)).count() == 2
    assert I.after_marks(rows, high_water_marks(held), lateness_seconds=1).count() == 3


def catalogue(frame):
    return frame([("d1", "g1", "2020-01-01", "2020-02-01 00:00:00"), ("d2", "g1", "2020-01-01", "2020-03-01 00:00:00"),
                  ("d3", "g1", "2020-01-01", "2020-03-01 00:00:00"), ("d4", "g2", "2020-01-01", "2020-01-05 00:00:00"),
                  ("d5", "g3", None, "2020-01-05 00:00:00")], "name string, glider string, start date, end timestamp")


def test_missions_collapse_to_the_latest_end(frame):
    cat = catalogue(frame)
    assert sorted(r["name"] for r in K.collapse_missions(cat).collect()) == ["d2", "d4", "d5"]
    lost = {r["name"]: r["skip"] for r in K.superseded(cat).collect()}
    assert lost == {"d1": "superseded by d2", "d3": "superseded by d2"}


def test_available_now_needs_a_recent_fix_and_a_vertex_in_the_box(frame):
    v = frame([("d2", -125.0, 48.5), ("d2", 0.0, 0.0), ("d4", 0.0, 0.0)], "name string, lon double, lat double")
    cat = catalogue(frame)
    assert [r["name"] for r in K.available_now(cat, v, "2020-03-15", 14).collect()] == ["d2"]
    assert K.available_now(cat, v, "2020-03-15 00:00:01", 14).count() == 0


def test_tracks_without_vertices_inside_have_no_bounds(frame):
    v = frame([("in", -125.00004, 48.5), ("in", 0.0, 0.0), ("out", 0.0, 0.0)], "name string, lon double, lat double")
    out = {r["name"]: r for r in K.describe_tracks(v).collect()}
    assert (out["in"]["profiles_total"], out["in"]["profiles_in_box"], out["in"]["lon_min"]) == (2, 1, -125.0)
    assert out["out"]["profiles_in_box"] == 0 and out["out"]["lon_min"] is None


def test_diff_and_ledger(frame):
    s = "deployment string, last_fix string"
    prev = frame([("stay", "1"), ("move", "1"), ("gone", "1")], s)
    now = frame([("stay", "1"), ("move", "2"), ("fresh", "2"), ("back", "2")], s).withColumn("profiles_in_box", F.lit(5).cast("bigint"))
    ledger = frame([("stay", "2019", "1", 1), ("back", "2018", "0", 1), ("gone", "2017", "1", 1)],
                   "deployment string, first_seen string, last_fix string, profiles_in_box bigint")
    assert {r["deployment"]: r["change"] for r in K.snapshot_diff(prev, now, ledger).collect()} == {
        "move": "advanced", "gone": "departed", "fresh": "new", "back": "returned"}
    merged = {r["deployment"]: tuple(r)[1:] for r in K.merge_ledger(ledger, now, "2020").collect()}
    assert merged["back"] == ("2018", "2", 5) and merged["fresh"] == ("2020", "2", 5) and merged["gone"] == ("2017", "1", 1)


def test_candidate_files_fall_back_to_own_prefix(frame):
    dep = frame([("d1",), ("d2",), ("d3",)], "name string")
    files = frame([("d1", "d1_grid.nc"), ("d1", "d1_grid_adjusted.nc"), ("d2", "d2_delayed.nc"), ("d2", "d2_new.nc"), ("d3", "d9_grid.nc")],
                  "name string, file string")
    got = {r["name"]: r["file"] for r in K.resolve_candidates(dep, files, ["_grid.nc", "_grid_adjusted.nc"]).collect()}
    assert got == {"d1": "d1_grid.nc", "d2": "d2_new.nc", "d3": None}
    skips = {r["name"]: r["skip"] for r in K.match_wanted(dep, files).collect()}
    assert skips == {"d1": None, "d2": "no _grid_adjusted.nc (publishes: d2_delayed.nc, d2_new.nc)", "d3": "no _grid_adjusted.nc (publishes: nothing)"}


def test_modal_month_tie_goes_to_the_first(frame):
    df = frame([("a", "2020-03-30 00:00:00"), ("a", "2020-04-01 00:00:00")], "deployment string, time timestamp")
    assert K.modal_month(df).first()["observed_month"] == "2020-03"


def test_track_older_than_its_name_is_noted(frame):
    df = frame([("o-a-20200401", "2020-03-30 00:00:00"), ("o-a-20200401", "2020-04-01 00:00:00")], "deployment string, time timestamp")
    assert K.track_statistics(df).first()["early_months"] == "2020-03"


def test_groups_match_exactly_and_first_wins(frame):
    df = frame([(" p ", "c"), ("x", "c"), ("P", "z"), (None, None)], "project string, comment string")
    out = [r["group"] for r in K.assign_group(df, [("one", "project", "p"), ("two", "comment", "c")]).collect()]
    assert out == ["one", "two", None, None]


def test_search_hits_are_checked_again_for_the_institution(frame):
    cat = frame([("o-a-1",), ("o-a-1-delayed",), ("o-b-1-delayed",)], "dataset_id string")
    hits = frame([("o-a-1", "us"), ("o-a-1-delayed", "us"), ("o-b-1-delayed", "us and them")], "dataset_id string, institution string")
    assert [r["dataset_id"] for r in K.find_deployments(cat, hits, "delayed", "us").collect()] == ["o-a-1-delayed"]
    assert [r["glider"] for r in K.find_deployments(cat, hits, "realtime", "us").collect()] == ["a"]


def test_upsert_never_takes_a_null(frame):
    base = frame([("s", "2020-01-01", 1.0), ("s", "2020-01-02", 2.0)], "site string, day date, value double")
    new = frame([("s", "2020-01-02", 3.0), ("s", "2020-01-03", None), ("s", "2020-01-04", 4.0)], "site string, day date, value double")
    assert [r["value"] for r in I.upsert(base, new, ["site", "day"]).orderBy("day").collect()] == [1.0, 3.0, 4.0]


def test_missing_chunks_only_where_a_date_is_missing(frame):
    spans = frame([("s", 0, "2020-01-01", "2020-01-15"), ("s", 1, "2020-01-16", "2020-01-20")], "site string, chunk int, chunk_start date, chunk_end date")
    held = frame([("s", "2020-01-01"), ("s", "2020-01-08"), ("s", "2020-01-15")], "site string, date date")
    assert [(r["chunk"], r["missing"]) for r in I.missing_chunks(spans, held, "site").collect()] == [(1, 1)]


def test_change_gate_ignores_the_stamp(frame):
    a = frame([("x", 1, "t1"), ("y", 2, "t1")], "k string, v int, updated string")
    b = frame([("y", 2, "t2"), ("x", 1, "t2")], "k string, v int, updated string")
    c = frame([("y", 2, "t2"), ("x", 3, "t2")], "k string, v int, updated string")
    assert not I.has_changed(a, b) and I.has_changed(a, c)
    assert I.content_hash(a).first() == I.content_hash(b).first() != I.content_hash(c).first()


def test_label_upgrade_is_stale(frame):
    want = frame([("2020-01-01", "final"), ("2020-01-02", "prelim")], "date date, label string")
    held = frame([("2020-01-01", "prelim"), ("2020-01-02", "prelim")], "date date, label string")
    assert I.stale_steps(want, held).count() == 1 and I.stale_steps(want, want).count() == 0


def test_lines_need_two_points_and_long_tracks_share_vertices(frame):
    v = frame([("a", k, -125.0 - k / 100, 48.0) for k in range(7)] + [("b", 0, -125.0, 48.0)], "name string, seq bigint, lon double, lat double")
    dep = frame([("a", "g", "p"), ("b", "g", "p")], "name string, glider string, project string")
    import json

    whole = features.track_lines(v, dep).collect()
    assert [(r["name"], r["n_points"]) for r in whole] == [("a", 7)]
    track = json.loads(whole[0]["feature"])["geometry"]["coordinates"]
    for size in (2, 3, 4, 5, 7):
        parts = features.track_lines(v, dep, piece_points=size).orderBy("piece").collect()
        lines = [json.loads(r["feature"])["geometry"]["coordinates"] for r in parts]
        assert lines[0] + [p for x in lines[1:] for p in x[1:]] == track and {r["n_points"] for r in parts} == {7}
        assert all(2 <= len(x) <= size for x in lines) and all(x[-1] == y[0] for x, y in zip(lines, lines[1:]))


def test_the_box_is_cut_before_pieces(frame):
    inside = {1, 5, 6}
    v = frame([("a", k, -125.0 if k in inside else -10.0, 48.0 + k / 100) for k in range(8)], "name string, seq bigint, lon double, lat double")
    dep = frame([("a", "g", "p")], "name string, glider string, project string")
    import json

    parts = features.track_lines(v, dep, piece_points=2).orderBy("piece").collect()
    assert [json.loads(r["feature"])["geometry"]["coordinates"] for r in parts] == [[[-125.0, 48.01], [-125.0, 48.05]], [[-125.0, 48.05], [-125.0, 48.06]]]


def test_missions_without_an_end_stay(spark):
    from brinewave.operators import catalogue

    rows = spark.createDataFrame([("a", "g", "s", None), ("b", "g", "s", None), ("c", "h", "s", "1"), ("d", "h", "s", None)], "name string, glider string, start string, end string")
    assert sorted(r["name"] for r in catalogue.collapse_missions(rows).collect()) == ["a", "c"]


def test_publish_replaces_as_a_whole(spark, folder):
    features.publish(spark.range(5), folder)
    features.publish(spark.range(3), folder)
    assert spark.read.parquet(folder).count() == 3
