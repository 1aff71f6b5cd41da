"""One fact table summed at several area levels at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_rollup(facts: DataFrame, levels: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """Aggregate ``measures`` by (area_kind, area_id) for each level of ``levels``.

    Each fact is read once and counted in every level in which its area is known; a null area is
    left out. ``measures`` are aggregate expressions.
    """
    areas = F.array(
        *[F.struct(F.lit(kind).alias("area_kind"), area.cast("string").alias("area_id")) for kind, area in levels.items()]
    )
    placed = facts.select("*", F.inline(areas)).where("area_id is not null")
    return placed.groupBy("area_kind", "area_id").agg(*[m.alias(name) for name, m in measures.items()])
