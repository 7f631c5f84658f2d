"""The given tables seen as observation data.

Each view is one SQL text. Spark runs it over parquet; the reference SQL of a query uses
the same text as a common table expression, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.functions import columns as C
from brinewave.session import prepare

VIEWS = {
    # moving platforms: one row per observation, wide by sensor
    "obs": ("events", """
SELECT concat('org-g', user_id % 7, '-',
              replace(cast(date '2023-06-01' + cast(user_id % 400 AS int) AS string), '-', ''),
              CASE WHEN event_id % 4 <> 0 THEN '-delayed' ELSE '' END) AS deployment,
       concat('g', user_id % 7) AS glider,
       ts AS time,
       47.5e0 + ((user_id * 17 + DAYNO[ts] * 5 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id END) % 211) / 100e0 AS latitude,
       -127e0 + ((user_id * 13 + DAYNO[ts] * 7 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id END) % 300) / 100e0 AS longitude,
       CASE WHEN event_id % 50 <> 0 THEN (event_id * 37) % 1300 - 2e0 END AS depth,
       CASE WHEN event_type <> 'error' OR event_id % 3 <> 0 THEN value / 7.9e0 END AS temperature,
       cast(regexp_extract(props, '([0-9]+)', 1) AS double) * 0.5e0 AS salinity,
       CASE WHEN event_type IN ('click', 'view') THEN 990e0 + event_id % 60 END AS density,
       CASE WHEN user_id % 11 = 0 AND event_type IN ('error', 'click') THEN value / 1000e0
            WHEN user_id % 11 <> 0 AND event_type = 'signup' THEN value * 3e0 END AS oxygen_concentration,
       CASE WHEN event_type IN ('view', 'signup') THEN value / 10e0 - 3e0 END AS chlorophyll,
       CASE WHEN event_type IN ('error', 'click') THEN value / 1000e0 END AS backscatter_700,
       CASE WHEN event_type = 'purchase' THEN value - 6e0 END AS cdom,
       event_id
FROM events"""),
    # fixed sensors, irregular samples over a month
    "sensor": ("events", """
SELECT event_type AS site, ts AS time, event_id AS id,
       CASE WHEN cast(regexp_extract(props, '([0-9]+)', 1) AS int) >= 5 THEN value / 4.1e0 END AS value,
       cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 10 AS flag
FROM events"""),
    # multi-year stations
    "station": ("orders", """
SELECT o_orderpriority AS site, o_orderdate + HOURS[o_orderkey % 24] AS time,
       o_totalprice / 9973e0 AS value, o_orderkey AS id
FROM orders"""),
    "mooring": ("lineitem", """
SELECT l_returnflag AS site, l_shipdate + HOURS[(l_orderkey * 7 + l_linenumber) % 24] AS time,
       l_extendedprice / 4999e0 AS value
FROM lineitem"""),
    # a regular grid through time; NULL is land
    "grid": ("lineitem", """
SELECT i, j, make_date(cast(y AS int), 1, 1) AS date, 40e0 + i * 0.005e0 AS lat, -126.8e0 + j * 0.005e0 AS lon,
       CASE WHEN j <> 40 AND (i * 7 + j * 13) % 17 <> 0 THEN v END AS value,
       CASE WHEN y >= 2001 THEN 'prelim' ELSE 'final' END AS source
FROM (SELECT l_suppkey AS i, l_partkey % 96 AS j, year(l_shipdate) AS y, avg(l_discount) * 97.3108713e0 + 10 AS v
      FROM lineitem GROUP BY l_suppkey, l_partkey % 96, year(l_shipdate)) g"""),
    # a fine water mask, five by five pixels per cell; some cells are not covered
    "mask": ("lineitem", """
SELECT i * 5 + a AS r, j * 5 + b AS c,
       40e0 + i * 0.005e0 + (a - 2) * 0.001e0 AS lat, -126.8e0 + j * 0.005e0 + (b - 2) * 0.001e0 AS lon,
       (i * j) % 13 <> 0 AND ((i + j) % 3 = 0
         OR ((i * 5 + a) * 31 + (j * 5 + b) * 17 + ((i * 5 + a) * (j * 5 + b)) % 7) % 11 > 3) AS water
FROM (SELECT DISTINCT l_suppkey AS i, l_partkey % 96 AS j FROM lineitem
      WHERE (l_suppkey + 2 * (l_partkey % 96)) % 29 <> 0) m FIVE[a] FIVE[b]"""),
    "sites": ("supplier", """
SELECT s_suppkey AS site, -126.8e0 + ((s_suppkey * 37) % 1000) * 0.0023e0 AS lon,
       47.85e0 + ((s_suppkey * 61) % 1000) * 0.0015e0 AS lat, cast((s_suppkey * 7) % 500 AS double) AS depth
FROM supplier"""),
    "points": ("customer", """
SELECT c_custkey AS point_id, -126.8e0 + ((c_custkey * 53) % 2311) * 0.001e0 AS lon,
       47.85e0 + ((c_custkey * 29) % 1511) * 0.001e0 AS lat
FROM customer"""),
    # deployments and their tracks
    "catalogue": ("orders lineitem", """
SELECT concat('org-g', o_orderkey % 97, 'x', o_orderkey) AS name, concat('org-g', o_orderkey % 97) AS glider,
       cast(date_trunc('month', o_orderdate) AS date) AS start, coalesce(e, o_orderdate) AS "end",
       o_orderpriority AS project, o_orderstatus AS comment, o_orderkey AS id
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY l_orderkey) l
  ON o_orderkey = l_orderkey"""),
    "vertices": ("lineitem", """
SELECT concat('org-g', l_orderkey % 97, 'x', l_orderkey) AS name,
       -127e0 + (l_partkey % 300) / 100e0 AS lon, 47.5e0 + (l_suppkey * 7 % 211) / 100e0 AS lat,
       l_shipdate AS time
FROM lineitem"""),
}


def _spark_text(sql: str) -> str:
    sql = re.sub(r"HOURS\[([^\]]+)\]", r"make_dt_interval(0, cast(\1 AS int), 0, 0)", sql)
    sql = re.sub(r"DAYNO\[([^\]]+)\]", r"cast(floor(unix_micros(\1) / 86400e6) AS bigint)", sql)
    sql = re.sub(r"FIVE\[(\w)\]", r"LATERAL VIEW explode(array(0, 1, 2, 3, 4)) t\1 AS \1", sql)
    return sql.replace('"end"', "`end`")


def _duck_text(sql: str) -> str:
    sql = re.sub(r"HOURS\[([^\]]+)\]", r"to_hours(cast(\1 AS int))", sql)
    sql = re.sub(r"DAYNO\[([^\]]+)\]", r"cast(floor(epoch_us(\1) / 86400e6) AS bigint)", sql)
    return re.sub(r"FIVE\[(\w)\]", r"CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS \1) t\1", sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps become UTC timestamps at ingress."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in ntz}) if ntz else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    tables, sql = VIEWS[name]
    text = _spark_text(sql)
    frames = {}
    for t in tables.split():
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        frames[t] = table(spark, folder, t)
    return spark.sql(text, **frames)


def with_views(*names: str) -> str:
    """The opening WITH of a reference SQL."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_duck_text(VIEWS[n][1])})" for n in names)


#: says in a column's metadata to how many places its values are rounded already
ROUNDED = "places"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """``df`` with these doubles in result form, which ``edge`` then leaves as they are."""
    return df.withColumns({n: C.rounded(n, places).alias(n, metadata={ROUNDED: places}) for n in names})


def edge(df: DataFrame, places: int = 6) -> DataFrame:
    """Result form for comparison: rounded doubles, BIGINT integers, dates as text,
    zone-less times."""
    out = []
    for field in df.schema:
        name, kind = field.name, field.dataType.simpleString()
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            if field.metadata.get(ROUNDED) != places:
                c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)
