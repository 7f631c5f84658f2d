"""Registered queries: name -> Spark callable and, where SQL can say it, reference SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from brinewave.plans.views import edge, view, with_views
from brinewave.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}

MODULES = ("platforms", "resampling", "dayofyear", "sequences", "spatial", "gridded",
           "catalogues", "ingest", "quality", "streams")


class Frames:
    """Views of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

        self._stored: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def stored(self, name: str) -> DataFrame:
        """The view as a table in the shared folder, for queries that read it many times."""
        if name not in self._stored:
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            view(self.spark, self.folder, name).write.parquet(path)
            self._stored[name] = self.spark.read.parquet(path)
        return self._stored[name]


def query(name: str, covers: str, views: str = "", sql: str | None = None):
    """Register a query. ``views`` names the views its SQL starts from; ``sql`` continues
    after them (it may open with a comma for more expressions)."""
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return edge(fn(Frames(spark, folder)))

        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            head = with_views(*views.split()) if views else ""
            ORACLE[name] = f"{head}\n{sql.strip()}"
        return fn

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"brinewave.plans.{module}")
