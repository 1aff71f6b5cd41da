"""Results as GeoJSON, CSV and replaced partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_feature(lon: Column, lat: Column, properties: Sequence[str], digits: int = 6) -> Column:
    """A GeoJSON feature as text; null properties stay in it as null."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, digits), F.round(lat, digits)).alias("coordinates"))
    parts = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.to_json(parts, {"ignoreNullFields": "false"})


def write_feature_lines(rows: DataFrame, path: str, properties: Sequence[str]) -> None:
    """One feature a line, written by all tasks; rows have lon and lat."""
    rows.select(point_feature(F.col("lon"), F.col("lat"), properties).alias("value")).write.mode("overwrite").text(path)


def replace_layers(rows: DataFrame, table: str) -> None:
    """Replace the layers (``layer_id``) that ``rows`` holds and leave the others."""
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("layer_id").parquet(table)
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
