"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

from brinewave.config import SCIENCE

OBSERVATION_KEYS = ("deployment", "glider", "time", "latitude", "longitude", "depth")

OBSERVATIONS = T.StructType(
    [
        T.StructField("deployment", T.StringType()),
        T.StructField("glider", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("depth", T.DoubleType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in SCIENCE]
)

BBOX = T.StructType(
    [
        T.StructField("lon", T.ArrayType(T.DoubleType())),
        T.StructField("lat", T.ArrayType(T.DoubleType())),
    ]
)

TRANSECT = T.StructType(
    [
        T.StructField("deployment", T.StringType()),
        T.StructField("glider", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("last_fix", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("color", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("profiles_total", T.LongType()),
        T.StructField("profiles_in_box", T.LongType()),
        T.StructField("bbox_in_box", BBOX),
        T.StructField("files", T.MapType(T.StringType(), T.StringType())),
        T.StructField("first_seen", T.StringType()),
    ]
)

LEDGER_ENTRY = T.StructType(
    [
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_fix", T.StringType()),
        T.StructField("profiles_in_box", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("box", BBOX),
        T.StructField("lookback_days", T.DoubleType()),
        T.StructField("catalogue_deployments", T.LongType()),
        T.StructField("updated", T.StringType()),
        T.StructField("transects", T.ArrayType(TRANSECT)),
        T.StructField("seen", T.MapType(T.StringType(), LEDGER_ENTRY)),
    ]
)

CATALOGUE_FEATURES = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("deployment_name", T.StringType()),
                                    T.StructField("glider_name", T.StringType()),
                                    T.StructField("glider_serial", T.StringType()),
                                    T.StructField("deployment_start", T.StringType()),
                                    T.StructField("deployment_end", T.StringType()),
                                    T.StructField("active", T.BooleanType()),
                                    T.StructField("project", T.StringType()),
                                    T.StructField("comment", T.StringType()),
                                    T.StructField("url", T.StringType()),
                                    T.StructField("color", T.StringType()),
                                    # of a piece of a longer track: its first vertex, from 0
                                    T.StructField("first_vertex", T.LongType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    # kept as JSON text: the depth of nesting depends on the type
                                    T.StructField("coordinates", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

STATION_ROWS = T.StructType(
    [
        T.StructField("time_text", T.StringType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("count", T.IntegerType()),
    ]
)

CHECK_COLUMNS = ("suite", "check", "passed", "detail")
