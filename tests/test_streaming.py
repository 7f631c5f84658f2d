from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brinewave.operators import resample, screening
from brinewave.operators.incremental import fresh_rows
from brinewave.schema import OBSERVATIONS
from brinewave.streaming import feeds
from test_catalogue_ingest import obs
from test_screening import held_rows


class Feed:
    """Files landed one by one; every drain is one or more micro-batches."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, str(root), 0

    def land(self, df):
        self.n += 1
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        return self

    def stream(self, schema):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_ingest_refuses_late_rows_per_deployment(spark, feed, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    parts = [[("o-a-1", "2020-01-01 00:00:00", 1.0, 10.0), ("o-a-1", "2020-01-01 00:00:00", 1.0, 12.0)],
             [("o-a-1", "2019-12-31 00:00:00", 1.0, 10.0), ("o-a-1", "2020-01-02 00:00:00", 1.0, 99.0), ("o-b-1", "2019-01-01 00:00:00", 1.0, 10.0)],
             [("o-a-1", "2020-01-03 00:00:00", 1.0, 10.0)]]
    for rows in parts:
        feed.land(obs(spark, rows))
        drain(feeds.ingest_stream(feed.stream(OBSERVATIONS), out, mark, "realtime"))
    got = {(r["deployment"], str(r["time"])) for r in spark.read.parquet(out).collect()}
    assert got == {("o-a-1", "2020-01-01 00:00:00"), ("o-b-1", "2019-01-01 00:00:00"), ("o-a-1", "2020-01-03 00:00:00")}
    assert spark.read.parquet(out).count() == 3
    assert sum(r["refused"] for r in spark.read.parquet(out + "_refused").collect()) == 1
    assert fresh_rows(obs(spark, parts[0]), spark.read.parquet(out)).count() == 0


def test_replayed_batch_replaces_itself(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    feed.land(obs(spark, [("o-a-1", "2020-01-01 00:00:00", 1.0, 10.0)]))
    for k in range(2):  # a lost progress log replays batch 0
        drain(feeds.ingest_stream(feed.stream(OBSERVATIONS), out, str(tmp_path / f"mark{k}"), "realtime"))
    assert spark.read.parquet(out).count() == 1


@pytest.mark.parametrize("size,last", [(5, 20), (17, 99)])
def test_held_positions_equal_the_batch_operator(spark, feed, frame, tmp_path, size, last):
    schema = "deployment string, time timestamp, longitude double, latitude double"
    rows = sorted((r for r in held_rows() if r[2] is not None), key=lambda r: r[1])[:last]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for k in range(0, len(rows), size):
        feed.land(frame(rows[k:k + size], schema))
        drain(feeds.held_position_stream(feed.stream(frame(rows[:1], schema).schema), out, mark))
    key = ["deployment", "held_from", "held_to"]
    want = sorted(tuple(r) for r in screening.held_runs(frame(rows, schema)).select(*key).collect())
    got = sorted(tuple(r) for r in feeds.held_positions_so_far(spark, out).select(*key).collect())
    assert got == want


def test_daily_completeness_equals_batch_on_closed_days(spark, feed, frame, tmp_path):
    rows = [("s", f"2020-01-0{d} {h:02d}:00:00", float(h) if h % 5 else None) for d in range(1, 5) for h in range(24 if d != 2 else 20)]
    schema = "site string, time timestamp, value double"
    df = frame(rows, schema)
    for d in range(1, 5):
        feed.land(df.where(F.dayofmonth("time") == d))
    stream = feeds.daily_completeness(feed.stream(df.schema), "1 hour")
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "mark")))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("day", "value", "n", "ok").collect())
    want = sorted(tuple(r) for r in resample.to_daily(df).where("day < date'2020-01-04'").select("day", "value", "n", "ok").collect())
    assert got == want and len(got) == 3


def test_duplicates_and_latest(spark, feed, frame, tmp_path):
    schema = "site string, time timestamp, value double"
    df = frame([("s", "2020-01-01 00:00:00", 1.0), ("s", "2020-01-01 00:00:00", 2.0), ("s", "2020-01-01 00:10:00", 3.0), ("r", "2020-01-01 00:00:00", 4.0)], schema)
    feed.land(df)
    distinct = feeds.distinct_times(feed.stream(df.schema), ["site"], "1 hour")
    drain(distinct.writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "m1")))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    seen = []
    latest = feeds.latest_values(feed.stream(df.schema), "site", ["value"])
    drain(latest.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "m2")))
    assert {r["site"]: r["value"] for r in seen} == {"s": 3.0, "r": 4.0}


def test_rows_beyond_the_lateness_are_counted(spark, feed, frame, tmp_path):
    schema = "site string, time timestamp, value double"
    for day in (5, 9, 1, 8):
        feed.land(frame([("s", f"2020-01-0{day} 00:00:00", 1.0)], schema))
    stream = feed.stream(frame([("s", "2020-01-01 00:00:00", 1.0)], schema).schema)
    for lateness, refused in (("2 days", 1), ("20 days", 0)):
        out = str(tmp_path / lateness.replace(" ", ""))
        running = feeds.distinct_times(stream, ["site"], lateness).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", out + "_p").trigger(availableNow=True).start()
        running.awaitTermination()
        assert feeds.refused_rows(running) == refused and spark.read.parquet(out).count() == 4 - refused


def test_streams_are_whole_on_a_folder_of_parts(spark, tmp_path):
    import os

    import __spark_entry__ as entry

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("test tables are not here")
    spark.read.parquet(f"{source}/events.parquet").repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    for name in [n for n in entry.queries() if n.startswith("stream_") and n != "stream_ingest" and n != "stream_held_positions"]:
        one = sorted(map(str, entry.queries()[name](spark, source).collect()))
        many = sorted(map(str, entry.queries()[name](spark, str(tmp_path)).collect()))
        assert one == many and one, name
    for name in ("stream_ingest", "stream_held_positions"):  # parts out of order: late rows are refused by rule, the queries run
        assert entry.queries()[name](spark, str(tmp_path)).count() >= 0
