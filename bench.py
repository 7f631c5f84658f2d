"""Timings of the headline queries: one JSON line.

Each query is run once to warm up and then twice (BENCH_ROUNDS); the median counts. Results are
written to the no-op sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brinewave.plans import registry  # noqa: E402

HEADLINE = (
    "monthly_anomaly_exceedance",
    "gross_range_screen",
    "copied_channels_blanked",
    "held_positions_masked",
    "live_view",
    "observations_deduplicated",
    "yearday_climatology",
    "series_classified",
    "readings_scored",
    "rolling_despike",
    "yearday_outliers_dropped",
    "common_baseline",
    "gap_table",
    "series_thinned",
    "cell_snap",
    "nearest_site",
    "first_track_hit",
    "distance_to_water",
    "unreachable_water",
    "clipped_cells",
    "missions_collapsed",
    "snapshot_diff",
    "archive_update_idempotent",
    "stream_daily_completeness",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    timings = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run = registry.QUERIES[name]
        seconds = []
        for _ in range(rounds + 1):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:] or seconds), 3)
    print(json.dumps({
        "metric": "total median seconds of headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
