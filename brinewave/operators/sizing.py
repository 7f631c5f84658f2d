"""Joins against a summary table whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brinewave.session import cut_lineage

BROADCAST_ROWS = 200_000


def measured(summary: DataFrame) -> tuple[DataFrame, int]:
    """The summary written out, and its rows, counted while they are written."""
    seen = Observation()
    held = cut_lineage(summary.observe(seen, F.count(F.lit(1)).alias("n")))
    return held, seen.get["n"]


def small(summary: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a narrow summary out, count it, and mark it for broadcast up to ``limit`` rows."""
    held, n = measured(summary)
    return F.broadcast(held) if n <= limit else held


def join_checked(big: DataFrame, summary: DataFrame, keys, how: str = "inner",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table to a narrow per-key summary.

    Up to ``limit`` rows the summary is broadcast, and the large side is not shuffled;
    beyond that the join is left to shuffle, where skewed keys are split at run time.
    """
    return big.join(small(summary, limit), keys, how)
