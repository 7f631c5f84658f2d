"""Published versions, the mark log, partition fingerprints, retention on storage, late rows of long streams."""

from __future__ import annotations

import os
import shutil
import threading
import uuid

import pytest
from pyspark.sql import functions as F
from test_catalogue_ingest import obs

from brinewave.operators import incremental as I
from brinewave.sources import archive, features, marks, versions
from brinewave.streaming import feeds


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


# -- versions ----------------------------------------------------------------------------


def test_a_reader_in_a_loop_never_misses_the_table(spark, folder):
    """Every read meets one whole version: n rows that all carry n."""
    def table(n):
        return spark.range(n, numPartitions=3).select(F.lit(n).alias("n"))

    versions.publish_version(table(10), folder)
    seen, wrong, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                got = [r["n"] for r in versions.read_version(spark, folder).collect()]
                seen.append(got[0])
                if len(got) != got[0] or len(set(got)) != 1:
                    wrong.append(got)
            except Exception as e:  # a missing table is what must not happen
                wrong.append(repr(e)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(11, 19):
        versions.publish_version(table(n), folder, keep=4)
    stop.set()
    reader.join()
    assert not wrong and len(set(seen)) > 1 and seen == sorted(seen)
    assert versions.committed(spark, folder) == [6, 7, 8, 9]
    assert sorted(x for x in os.listdir(folder) if x.startswith("version=")) == [f"version={n}" for n in (6, 7, 8, 9)]


def test_a_version_not_committed_is_none(spark, folder):
    versions.publish_version(spark.range(4), folder)
    spark.range(99).write.parquet(f"{folder}/version=2")  # a writer that stopped before its commit
    assert versions.read_version(spark, folder).count() == 4
    assert versions.publish_version(spark.range(5), folder) == 3 and versions.read_version(spark, folder).count() == 5
    with pytest.raises(Exception):
        versions.publish_version(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), folder)
    assert versions.read_version(spark, folder).count() == 5
    assert versions.current(spark, str(folder) + "-none") == str(folder) + "-none"


# -- marks -------------------------------------------------------------------------------

ROWS = [("o-a-20200101", "2020-01-01 00:00:00", 1.0, 10.0), ("o-a-20200101", "2020-01-02 00:00:00", 1.0, 9.0), ("o-b-20200101", "2020-01-01 00:00:00", 1.0, 8.0)]


def test_an_update_never_reads_the_archive(spark, folder, monkeypatch):
    assert I.update_archive(spark, obs(spark, ROWS[:1]), folder, "realtime")["total"] == 1
    monkeypatch.setattr(archive, "read_archive", lambda *a, **k: pytest.fail("the archive was scanned"))
    assert I.update_archive(spark, obs(spark, ROWS), folder, "realtime") == {"mode": "realtime", "path": folder, "appended": 2, "total": 3}
    before = sorted(os.listdir(f"{folder}_log/realtime"))
    assert I.update_archive(spark, obs(spark, ROWS), folder, "realtime")["appended"] == 0
    assert sorted(os.listdir(f"{folder}_log/realtime")) == before  # nothing new writes nothing


def test_marks_survive_a_lost_log_and_a_stopped_update(spark, folder):
    I.update_archive(spark, obs(spark, ROWS[:1]), folder, "realtime")
    shutil.rmtree(f"{folder}_log")  # an archive from before the log
    assert I.update_archive(spark, obs(spark, ROWS), folder, "realtime")["total"] == 3
    # rows written, then stopped before the commit
    late = ROWS + [("o-a-20200101", "2020-01-03 00:00:00", 1.0, 7.0)]
    fresh = I.newer_rows(obs(spark, late), marks.read_marks(spark, folder, "realtime"))
    marks.begin(spark, folder, "realtime")
    archive.append_archive(spark, folder, fresh, "realtime")
    done = I.update_archive(spark, obs(spark, late), folder, "realtime")
    assert (done["appended"], done["total"]) == (0, 4) and archive.read_archive(spark, folder, "realtime").count() == 4


def test_the_log_is_folded_and_stays_equal_to_the_archive(spark, folder, monkeypatch):
    monkeypatch.setattr(marks, "FOLD", 3)
    for day in range(1, 6):
        I.update_archive(spark, obs(spark, [(f"o-{x}-20200101", f"2020-01-0{day} 00:00:00", 1.0, 9.0) for x in "ab"[: 1 + day % 2]]), folder, "realtime")
    got = {tuple(r) for r in marks.read_marks(spark, folder, "realtime").collect()}
    assert got == {tuple(r) for r in marks.marks_of(archive.read_archive(spark, folder, "realtime")).collect()}
    names = [n for n in os.listdir(f"{folder}_log/realtime") if not n.startswith(".")]
    assert len([n for n in names if n.startswith("base=")]) == 1 and len(names) == 3


# -- change gate -------------------------------------------------------------------------


def test_partition_fingerprints_find_the_altered_partition(frame):
    schema = "site string, day date, value double, updated string"
    before = frame([("a", "2020-01-01", 1.0, "x"), ("a", "2020-01-02", 2.0, "x"), ("a", "2020-02-01", None, "x"), ("a", "2020-03-01", 1.0, "x")], schema)
    after = frame([("a", "2020-01-02", 2.0, "y"), ("a", "2020-01-01", 1.0, "y"), ("a", "2020-02-01", 0.0, "y"), ("a", "2020-04-01", 1.0, "y")], schema)
    month = F.date_format("day", "yyyy-MM")
    one, two = (I.partition_hashes(x, month, "month") for x in (before, after))
    got = {r["month"]: (r["n"], r["same"]) for r in I.compared_partitions(one, two, "month").collect()}
    assert got == {"2020-01": (2, True), "2020-02": (1, False), "2020-03": (0, False), "2020-04": (1, False)}


# -- retention ---------------------------------------------------------------------------


def test_retention_counts_filled_steps_and_never_a_missing_one(spark, frame, folder):
    layer = frame([("2020-01-01", 1.0), ("2020-01-02", 1.0), ("2020-01-03", None), ("2020-01-04", 1.0), (None, 5.0), ("2020-01-05", None)], "date date, value double")
    features.publish(layer, folder, "date")
    assert archive.retire_steps(spark, folder, 2) == ["2020-01-01", ""]
    assert sorted(str(r["date"]) for r in spark.read.parquet(folder).collect()) == ["2020-01-02", "2020-01-03", "2020-01-04", "2020-01-05"]
    assert archive.retire_steps(spark, folder, 2) == []


# -- streams -----------------------------------------------------------------------------


def test_late_rows_are_counted_beyond_the_newest_reports(spark, frame, tmp_path):
    """Every late row of 130 batches counts, though a query keeps 100 reports; with the span as lateness none is late."""
    schema = "site string, time timestamp, value double"
    days = [200] + [1 + d % 90 for d in range(130)]  # the first part is the newest
    rows = frame([("s", f"2020-01-01 00:00:{i % 60:02d}", float(d)) for i, d in enumerate(days)], schema).withColumn("time", F.expr("timestampadd(DAY, cast(value AS int), time)"))
    held = sorted(rows.collect(), key=lambda r: days.index(int(r["value"])) if int(r["value"]) == 200 else 1)
    for i, r in enumerate(held):
        part = tmp_path / "in" / f"{i:04d}"
        spark.createDataFrame([r], rows.schema).coalesce(1).write.parquet(str(part))
        os.utime(part, (1_600_000_000 + i, 1_600_000_000 + i))
    wanted = rows.select("site", "time").distinct().count()
    for lateness, name in (("2 days", "short"), (feeds.span_of(rows), "span")):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        if name == "span":
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 20).parquet(str(tmp_path / "in" / "*"))
        with feeds.LateRows(spark) as late:
            running = feeds.distinct_times(stream, ["site"], lateness).writeStream.format("parquet").option("path", str(tmp_path / name)).option(
                "checkpointLocation", str(tmp_path / f"{name}_p")).trigger(availableNow=True).start()
            running.awaitTermination()
            dropped = late.of(running)
        out = spark.read.schema("site string, time timestamp").parquet(str(tmp_path / name)).count()
        if name == "span":
            assert dropped == 0 and out == wanted
        else:
            assert dropped > 100 > feeds.refused_rows(running) and dropped + out == len(days)


def test_span_covers_any_order(frame):
    rows = frame([("a", "2020-01-01 00:00:00.5"), ("a", "2020-01-03 00:00:00")], "site string, time timestamp")
    assert feeds.span_of(rows) == f"{2 * 86_400} seconds" and feeds.span_of(rows.limit(0)) == "0 seconds"
