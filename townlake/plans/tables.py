"""The test tables as a small city: places with coordinates from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extent of the made city, in degrees.
WEST, SOUTH, WIDTH, HEIGHT = 23.1, 42.5, 0.5, 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(key: Column, factor: int) -> Column:
    return (key * F.lit(factor).cast("long") % 10007).cast("double") / F.lit(10007.0)


def placed(rows: DataFrame, key: Column) -> DataFrame:
    """Add lon and lat that ``key`` decides."""
    return rows.withColumns(
        {"lon": F.lit(WEST) + _spread(key, 7919) * WIDTH, "lat": F.lit(SOUTH) + _spread(key, 104729) * HEIGHT}
    )


def lon_sql(key: str) -> str:
    return f"(23.1e0 + CAST(({key}) * 7919 % 10007 AS DOUBLE) / 10007e0 * 0.5e0)"


def lat_sql(key: str) -> str:
    return f"(42.5e0 + CAST(({key}) * 104729 % 10007 AS DOUBLE) / 10007e0 * 0.4e0)"


def metres_sql(a: str, b: str) -> str:
    """Ellipsoid metres between (a.lon, a.lat) and (b.lon, b.lat) in plain SQL."""
    w = f"(1 - 0.0066943799901413165e0 * pow(sin(radians(({a}.lat + {b}.lat) / 2)), 2))"
    north = f"6378137e0 * (1 - 0.0066943799901413165e0) / ({w} * sqrt({w})) * radians({b}.lat - {a}.lat)"
    east = f"6378137e0 / sqrt({w}) * cos(radians(({a}.lat + {b}.lat) / 2)) * radians({b}.lon - {a}.lon)"
    return f"sqrt(pow({north}, 2) + pow({east}, 2))"


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as buildings with an area of three levels and a weight."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed(rows, F.col("c_custkey"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as facilities; those with an even key exist, the others are planned."""
    return placed(table(spark, sf_dir, "supplier"), F.col("s_suppkey") + 500)


BUILDINGS_SQL = f"""buildings AS (
  SELECT c.*, n.n_regionkey, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat
  FROM customer c JOIN nation n ON c_nationkey = n_nationkey)"""
FACILITIES_SQL = f"""facilities AS (
  SELECT *, {lon_sql('s_suppkey + 500')} AS lon, {lat_sql('s_suppkey + 500')} AS lat FROM supplier)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as grid boxes that leave a gap of the city uncovered, with 2 % overlap."""
    column, row = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("area"),
        (F.lit(WEST) + column * 0.09).alias("x0"),
        (F.lit(SOUTH) + row * 0.08).alias("y0"),
        (F.lit(WEST) + column * 0.09 + 0.0918).alias("x1"),
        (F.lit(SOUTH) + row * 0.08 + 0.0816).alias("y1"),
    )


BOXES_SQL = """boxes AS (
  SELECT n_nationkey AS area, 23.1e0 + (n_nationkey % 5) * 0.09e0 AS x0, 42.5e0 + (n_nationkey // 5) * 0.08e0 AS y0,
         23.1e0 + (n_nationkey % 5) * 0.09e0 + 0.0918e0 AS x1, 42.5e0 + (n_nationkey // 5) * 0.08e0 + 0.0816e0 AS y1
  FROM nation)"""
