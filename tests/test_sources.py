from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brinewave.sources import exchange, features, text_tables

STATION = """## preamble
#STNNAME: "Ridge, East"  / Station Name
#LATITUDE: 48.81  / degrees
#LONGITUDE: -125.28  / degrees
#DEPTH: 98.5m  / metres
#Note: prose
## END HEADER
2020-01-01T00:00:00.000Z, 9.5, 1, 3600
2020-01-01T01:00:00.000Z,  NaN, 9, 0
"""


def test_station_files(spark, tmp_path):
    (tmp_path / "Ridge_East_variables_20110203T170000Z_20260811T180000Z-NaN.csv").write_text(STATION)
    (tmp_path / "Ridge_West_variables_x.csv").write_text(STATION.replace("98.5m", "12"))
    rows = text_tables.station_rows(spark, str(tmp_path))
    assert [(str(r["time"]), r["value"], r["flag"], r["count"]) for r in rows.where(F.contains("file", F.lit("East"))).orderBy("time").collect()] == [
        ("2020-01-01 00:00:00", 9.5, 1, 3600), ("2020-01-01 01:00:00", None, 9, 0)]
    header = text_tables.station_header(spark, str(tmp_path))
    assert set(header.columns) == {"file", "STNNAME", "LATITUDE", "LONGITUDE", "DEPTH"}
    assert header.first()["STNNAME"] == "Ridge, East"
    out = {r["depth_m"]: r for r in text_tables.station_fields(header, rows).collect()}
    assert str(out[98.5]["record_start"]) == "2011-02-03" and str(out[98.5]["record_end"]) == "2026-08-11"
    assert str(out[12.0]["record_start"]) == "2020-01-01"


def test_header_without_a_position_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STATION.replace("#LATITUDE: 48.81  / degrees\n", ""))
    header = text_tables.station_header(spark, str(tmp_path), ["LATITUDE", "LONGITUDE"])
    with pytest.raises(Exception, match="header has no LATITUDE"):
        text_tables.station_fields(header).collect()


def test_buoy_keeps_the_first_duplicate_and_ignores_the_flag(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        "STN_ID,DATE,LATITUDE,LONGITUDE,DEPTH,Q_FLAG,SeaWaterTemperature\n"
        "C1,01/02/1990 03:04,48.8,125.9,73,4,9.5\nC1,01/02/1990 03:04,48.8,125.9,73,1,-51\nC1,01/02/1990 03:05,48.8,125.9,73,1,\n")
    out = text_tables.buoy_rows(spark, str(tmp_path)).orderBy("time").collect()
    assert [(str(r["time"]), r["value"]) for r in out] == [("1990-01-02 03:04:00", 9.5), ("1990-01-02 03:05:00", None)]


def test_commented_series_keeps_its_header(spark, tmp_path):
    (tmp_path / "in.csv").write_text("# one cell\n# cell_lat: 48.825\n# stride_days: 7  -- weekly\ndate,sst_c\n2020-01-08,9.5\n2020-01-01,9.25\n")
    path = str(tmp_path / "in.csv")
    series = text_tables.commented_series(spark, path, "sst_c")
    header = text_tables.commented_header(spark, path)
    assert {r["key"]: r["value"] for r in header.collect()}["cell_lat"] == "48.825"
    extra = spark.sql("select 'x' as file, date'2020-01-15' as day, 9.0d as value")
    text_tables.write_commented_series(series.unionByName(extra), header, str(tmp_path / "out"), "sst_c")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ("# one cell\n# cell_lat: 48.825\n# stride_days: 7  -- weekly\ndate,sst_c\n"
                    "2020-01-01,9.25\n2020-01-08,9.5\n2020-01-15,9.0\n")


def test_catalogue_flattens_and_drops_empty_tracks(spark, tmp_path):
    def feature(name, kind, coordinates, **extra):
        return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates},
                "properties": {"deployment_name": name, "glider_name": "eva", "glider_serial": "035",
                               "deployment_start": "2020-01-01T00:00:00", "deployment_end": "2020-02-01T00:00:00", **extra}}

    payload = {"type": "FeatureCollection", "features": [
        feature("org-eva035-20200101", "LineString", [[-125.0, 48.0, 3.0], [-125.1, 48.1, 4.0]], active=True),
        feature("org-eva035-20200201", "MultiLineString", [[[-1.0, 1.0]], [[-2.0, 2.0], [-3.0, 3.0]]], url="u"),
        feature("org-eva035-20200301", "LineString", [])]}
    (tmp_path / "c.json").write_text(json.dumps(payload))
    deployments, vertices = exchange.read_catalogue(spark, str(tmp_path / "c.json"), "s")
    got = {r["name"]: r for r in deployments.collect()}
    assert set(got) == {"org-eva035-20200101", "org-eva035-20200201"}
    first = got["org-eva035-20200101"]
    assert (first["glider"], first["url"], first["active"], first["color"]) == ("eva035", "s/org-eva035/org-eva035-20200101", True, "#f4a261")
    assert [tuple(r)[1:] for r in vertices.where("name like '%0201'").orderBy("seq").collect()] == [(0, -1.0, 1.0), (1, -2.0, 2.0), (2, -3.0, 3.0)]
    assert vertices.where("name like '%0101'").count() == 2


def test_long_tracks_travel_in_pieces(spark, frame, tmp_path):
    """A deployment with most vertices is many bounded features in several documents, and comes back whole and in order."""
    from brinewave.plans.catalogues import write_catalogue

    rows = [("org-g1x1", f"2020-01-01T{i // 60:02d}:{i % 60:02d}:00", i / 100, -i / 100) for i in range(94)] + [
        ("org-g1x1", None, 0.94, -0.94)] + [
        (f"org-g2x{k}", "2020-01-01T00:00:00", float(k), 1.0) for k in range(2, 7)]
    path = str(tmp_path / "collections")
    write_catalogue(frame(rows[::-1], "name string, time timestamp, lon double, lat double"), path, piece_points=10, features=4)
    documents = [json.loads(r["value"]) for r in spark.read.option("wholetext", True).text(path).collect()]
    made = [f for d in documents for f in d["features"]]
    assert len(documents) > 1 and len(made) == 10 + 5
    assert max(len(f["geometry"]["coordinates"]) for f in made) == 10
    assert max(sum(f["properties"]["deployment_name"] == "org-g1x1" for f in d["features"]) for d in documents) < 10
    deployments, vertices = exchange.read_catalogue(spark, path, "s")
    assert sorted(r["name"] for r in deployments.collect()) == ["org-g1x1"] + [f"org-g2x{k}" for k in range(2, 7)]
    got = [(r["seq"], r["lon"], r["lat"]) for r in vertices.where("name = 'org-g1x1'").orderBy("seq").collect()]
    assert got == [(i, i / 100, -i / 100) for i in range(95)]


def test_manifest_versions(spark, tmp_path):
    empty = exchange.read_manifest(spark, str(tmp_path / "absent.json"))
    assert empty["transects"].count() == 0 and empty["ledger"].count() == 0
    body = {"schema": 1, "transects": [{"deployment": "a", "last_fix": "2020", "files": {"grid": "x"}, "bbox_in_box": {"lon": [1.0, 2.0], "lat": [3.0, 4.0]}}],
            "seen": {"a": {"first_seen": "2019", "last_fix": "2020", "profiles_in_box": 3}}}
    (tmp_path / "m.json").write_text(json.dumps(body))
    read = exchange.read_manifest(spark, str(tmp_path / "m.json"))
    assert read["transects"].first()["files"] == {"grid": "x"} and read["ledger"].first()["first_seen"] == "2019"
    with pytest.raises(ValueError, match="manifest schema 1"):
        exchange.read_manifest(spark, str(tmp_path / "m.json"), version=2)


def test_a_manifest_of_many_documents_needs_one_version(spark, tmp_path):
    for i, version in enumerate([1, 1, 1]):
        (tmp_path / f"m{i}.json").write_text(json.dumps({"schema": version, "transects": [], "seen": {f"d{i}": {}}}))
    assert exchange.read_manifest(spark, str(tmp_path))["ledger"].count() == 3
    (tmp_path / "m9.json").write_text(json.dumps({"schema": 2, "transects": [], "seen": {}}))
    with pytest.raises(ValueError, match="schema 2"):
        exchange.read_manifest(spark, str(tmp_path))


def test_platform_columns(frame):
    raw = frame([("234.5", 48.0, 5.0, 9.0), ("bad", 48.0, 5.0, 9.0), ("10", 48.0, None, 9.0)], "LNG string, Lat_Dec double, z double, Temp double")
    out = exchange.load_platform(raw, "temp")
    assert out.columns == ["Longitude", "Latitude", "Depth", "temp"] and [tuple(r) for r in out.collect()] == [(-125.5, 48.0, 5.0, 9.0)]
    with pytest.raises(KeyError):
        exchange.load_platform(raw.drop("z"), "temp")
    with pytest.raises(KeyError):
        exchange.resolve_column(raw.columns, "lon", "absent")  # an override beats the aliases
    assert exchange.resolve_column(["X", "lon"], "lon") == "lon"
    bathy = frame([(234.5, 48.0, 7.0)], "x double, y double, Elevation double")
    assert tuple(exchange.load_bathymetry(bathy, positive_down=True).first()) == (-125.5, 48.0, -7.0)


def test_site_discovery_prefers_the_richer_format(frame):
    files = frame([("/d/Loc_FolgerPinnacle_variables_1.csv", "## x"), ("/d/Loc_FolgerPinnacle_variables_2.nc", None),
                   ("/d/LaPerouse_Temp_1990.csv", "STN_ID,DATE"), ("/d/Loc_Folger_variables_3.csv", "#A"), ("/d/readme.txt", "#")],
                  "path string, first_line string")
    got = {r["site"]: (r["kind"], r["path"][-4:]) for r in exchange.discover_sites(files).collect()}
    assert got == {"pinnacle": ("station_binary", "2.nc"), "laperouse": ("buoy", ".csv"), "folger": ("station_text", ".csv")}


def test_listing_reads_first_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STN_ID,DATE\n1,2\n")
    assert [r["first_line"] for r in exchange.list_files(spark, str(tmp_path)).collect()] == ["STN_ID,DATE"]


def test_multipoints_have_one_time_per_coordinate(frame):
    df = frame([("o-g1-20200101", "2020-01-02 00:00:30", -125.1234567, 48.0), ("o-g1-20200101", "2020-01-01 00:00:00", -125.0, 48.0),
                ("o-g2-20200101", "2020-01-01 00:00:00", None, 48.0)], "deployment string, time timestamp, lon double, lat double")
    out = features.profile_points(df).collect()
    body = json.loads(out[0]["feature"])
    assert len(out) == 1 and body["geometry"]["coordinates"] == [[-125.0, 48.0], [-125.12346, 48.0]]
    assert body["properties"]["times"] == ["2020-01-01T00:00", "2020-01-02T00:00"]
    assert [r[0] for r in features.empty_tracks(df, features.profile_points(df)).collect()] == ["o-g2-20200101"]


def test_sites_keep_two_depths_and_skip_the_outside(frame):
    df = frame([("a", -125.0, 48.5, None, 73.0), ("b", 0.0, 0.0, 5.0, None)], "site string, lon double, lat double, depth_m double, water_depth_m double")
    out = [json.loads(r["feature"]) for r in features.site_features(df).collect()]
    assert len(out) == 1 and out[0]["properties"]["water_depth_m"] == 73.0


def test_tables_are_rounded(frame, tmp_path):
    text_tables.write_table(frame([(1.00005, "a")], "v double, k string"), str(tmp_path / "t"))
    assert "1.0,a" in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))


def test_short_tracks_do_not_make_many_documents(spark, frame, tmp_path):
    """Documents are counted by what they hold and are files of one folder; the reader keeps to their text."""
    from brinewave.plans.catalogues import write_catalogue

    rows = [(f"org-g{k % 7}x{k}", "2020-01-01T00:00:00", k / 100, 1.0) for k in range(600)]
    path = tmp_path / "collections"
    write_catalogue(frame(rows, "name string, time timestamp, lon double, lat double"), str(path), piece_points=100, features=10)
    documents = [json.loads(p.read_text()) for p in path.glob("*.txt")]
    assert not [p for p in path.iterdir() if p.is_dir()] and 1 < len(documents) <= 600 * 11 // 1000
    assert sum(len(d["features"]) for d in documents) == 600
    deployments, vertices = exchange.read_catalogue(spark, str(path), "s")
    assert deployments.count() == 600
    assert sorted((r["name"], r["seq"], r["lon"]) for r in vertices.collect()) == sorted((n, 0, x) for n, _, x, _ in rows)


def test_a_list_of_collections_in_one_document(spark, tmp_path):
    def made(name):
        return {"type": "FeatureCollection", "features": [{"properties": {"deployment_name": name}, "geometry": {"type": "LineString", "coordinates": [[1, 2, 9], [3, 4]]}}]}

    (tmp_path / "a.json").write_text(json.dumps([made("a-1"), made("b-1")], indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    deployments, vertices = exchange.read_catalogue(spark, str(tmp_path), "s")
    assert sorted(r["url"] for r in deployments.collect()) == ["s/a/a-1", "s/b/b-1"]
    assert vertices.count() == 4 and vertices.agg({"lat": "max"}).first()[0] == 4.0
