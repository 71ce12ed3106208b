"""What the registered queries share: rounding, and the test tables as sensor data in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    c = F.round(c, digits)
    return F.when(c == 0, 0.0).otherwise(c)


def rounded_all(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.col(n) if n in keep or t != "double" else rounded(n, digits).alias(n) for n, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


POINTS = """points AS (
    SELECT l_orderkey AS frame_id, l_linenumber AS k1, l_partkey AS k2, l_suppkey AS k3, l_extendedprice AS k4,
           l_quantity / 15 * cos(radians(l_suppkey % 41 - 20)) * cos(radians(l_partkey % 121 - 60)) AS x,
           l_quantity / 15 * cos(radians(l_suppkey % 41 - 20)) * sin(radians(l_partkey % 121 - 60)) AS y,
           l_quantity / 15 * sin(radians(l_suppkey % 41 - 20)) AS z,
           l_extendedprice / 250 AS snr, (l_discount * 100 - 5) / 10 AS doppler
    FROM lineitem)"""

CAMERA = """camera AS (
    SELECT o_orderkey AS frame_id, 0.5 + o_totalprice / 250000 AS cam_range,
           (0.5 + o_totalprice / 250000) * cos(radians(o_custkey % 121 - 60)) AS px,
           (0.5 + o_totalprice / 250000) * sin(radians(o_custkey % 121 - 60)) AS py, 0.0::DOUBLE AS pz
    FROM orders)"""

BACKGROUND = "background AS (SELECT DISTINCT x AS bx, y AS by_, z AS bz FROM points WHERE frame_id IN (SELECT DISTINCT frame_id FROM points ORDER BY frame_id LIMIT 15))"


def stream(name: str, kind: str) -> str:
    return f"{name} AS (SELECT event_id AS id, epoch_us(ts) AS stamp_us, value FROM events WHERE event_type = '{kind}')"


TRACKS = """tracks AS (
    SELECT user_id AS session, epoch_us(ts) AS stamp_us, event_id AS id,
           value / 100 AS cx, (event_id % 7) / 20 AS cy, (event_id % 11) / 25 AS cz,
           value / 90 AS px, (event_id % 5) / 15 AS py, (event_id % 13) / 30 AS pz
    FROM events)"""

#: Queries that sum many values take them in a unit of which no small power is a fraction, so that no sum
#: falls on an edge of rounding, where the engines' orders of summation would show.
UNIT = 2 ** (1 / 3)

#: A rotation about a slanted axis and a translation, as literals for queries that need an extrinsic.
R = [0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6]
T = [0.2, -0.1, 0.3]
#: A pinhole camera, and its distortion.
K = [500.0, 0.0, 480.0, 0.0, 510.0, 270.0, 0.0, 0.0, 1.0]
D = [0.1, -0.05, 0.001, -0.002, 0.01]


def turned_sql(m: list[float], p: list[str]) -> list[str]:
    return [" + ".join(f"({m[3 * i + j]}::DOUBLE) * {p[j]}" for j in range(3)) for i in range(3)]


def rigid_sql(m: list[float], t: list[float], p: list[str]) -> list[str]:
    return [f"({x} + ({t[i]}::DOUBLE))" for i, x in enumerate(turned_sql(m, p))]
