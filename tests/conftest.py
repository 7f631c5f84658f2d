from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from brinewave import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="brinewave-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame; ISO text in timestamp and date columns is cast."""
    from pyspark.sql import functions as F

    def make(rows, schema):
        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if t in ('timestamp', 'date') else t}" for n, t in fields)
        df = spark.createDataFrame(rows, raw)
        return df.select(*[F.col(n).cast(t).alias(n) if t in ("timestamp", "date") else F.col(n) for n, t in fields])

    return make
