"""Read-only SQL for people and tools: one query, capped rows and text, a time limit."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Limits of a result (fixed values): rows, characters a cell, characters in all, seconds.
MOST_ROWS, MOST_CELL, MOST_TEXT, MOST_SECONDS = 200, 300, 20_000, 15
#: Limits of a map (fixed values): features, bytes.
MOST_FEATURES, MOST_BYTES = 5_000, 8_000_000
#: Functions that reach beyond the tables, as an analysed plan names them.
_DENIED = re.compile(r"(?i)\b(java_method|reflect|try_reflect|input_file_name|input_file_block_start|input_file_block_length|version|current_user|session_user)\(")


#: A session has one setting of what a query may read; it is changed for one query at a time, while that is analysed.
_ANALYSING = threading.Lock()


class Refused(ValueError):
    """A text that is not one query over the registered tables."""


class _Sandboxed:
    """A query as a temporary view: Spark's parser takes nothing but a query there, and runs none of it."""

    def __init__(self, spark: SparkSession, query: str) -> None:
        self.spark, self.name, self.query = spark, f"sandbox_{uuid.uuid4().hex}", query.strip().rstrip(";").strip()

    def __enter__(self) -> DataFrame:
        if not self.query:
            raise Refused("the query is empty")
        with _ANALYSING:
            return self._analysed()

    def _analysed(self) -> DataFrame:
        setting = "spark.sql.runSQLOnFiles"
        before = self.spark.conf.get(setting, "true")
        self.spark.conf.set(setting, "false")  # files are no tables, however they are written
        try:
            self.spark.sql(f"CREATE TEMPORARY VIEW {self.name} AS\n{self.query}\n")
            # The analysed plan has functions by their own names, without quotes or comments.
            if _DENIED.search(self.spark.sql(f"EXPLAIN EXTENDED SELECT * FROM {self.name}").first()[0]):
                self.__exit__()
                raise Refused("only queries over the registered tables are allowed")
            return self.spark.table(self.name)
        except Refused:
            raise
        except Exception as e:
            raise Refused(str(e).split("\n")[0][:500]) from e
        finally:
            self.spark.conf.set(setting, before)

    def __exit__(self, *_: object) -> None:
        self.spark.catalog.dropTempView(self.name)


def _taken(spark: SparkSession, rows: DataFrame, most: int, seconds: float) -> list:
    """At most ``most`` rows, within ``seconds``."""
    tag, context = f"sandbox-{uuid.uuid4().hex}", spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return rows.limit(most).collect()
    except Exception as e:
        raise Refused(f"stopped after {seconds} seconds: filter or aggregate more" if late.is_set() else str(e).split("\n")[0][:500]) from e
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _cell(value: object) -> object:
    if value is None or isinstance(value, (bool, int, float)):
        return value
    text = str(value)
    if text.startswith('{"type"') and '"coordinates"' in text:
        return _summary(text)
    return text if len(text) <= MOST_CELL else text[:MOST_CELL] + "…"


def _summary(geometry: str) -> str:
    """A GeoJSON text as its kind and its number of points."""
    try:
        shape = json.loads(geometry)
        return f"{shape['type']} of {sum(1 for _ in _positions(shape['coordinates']))} points"
    except (ValueError, KeyError, TypeError):
        return geometry[:MOST_CELL]


def _fitting(parts: list, most: int) -> list:
    """As many of the first ``parts`` as have at most ``most`` characters as JSON together."""
    sizes = accumulate(len(json.dumps(p, default=str, ensure_ascii=False)) + 2 for p in parts)
    return [p for p, size in zip(parts, sizes, strict=True) if size <= most]


def run_query(spark: SparkSession, query: str, seconds: float = MOST_SECONDS) -> dict:
    """``{columns, rows, row_count, truncated}`` of one query, or ``{error}``."""
    try:
        with _Sandboxed(spark, query) as found:
            columns, rows = found.columns, [[_cell(v) for v in r] for r in _taken(spark, found, MOST_ROWS + 1, seconds)]
    except Refused as e:
        return {"error": str(e)}
    kept = _fitting(rows[:MOST_ROWS], MOST_TEXT - len(json.dumps(columns)))
    return {"columns": columns, "rows": kept, "row_count": len(kept), "truncated": len(kept) < len(rows)}


def query_features(spark: SparkSession, query: str, seconds: float = MOST_SECONDS) -> dict:
    """A FeatureCollection of a query with a ``geom`` column of GeoJSON text, or ``{error}``.

    Rows without a geometry are counted and left out. Beyond MOST_FEATURES rows or MOST_BYTES the
    rest is cut off, and ``truncated`` says so.
    """
    try:
        with _Sandboxed(spark, query) as found:
            if "geom" not in found.columns:
                return {"error": "the query needs a column named geom with GeoJSON text"}
            rows = [r.asDict() for r in _taken(spark, found, MOST_FEATURES + 1, seconds)]
    except Refused as e:
        return {"error": str(e)}
    features, empty, kinds = [], 0, set()
    low, high = [float("inf")] * 2, [float("-inf")] * 2
    for values in rows[:MOST_FEATURES]:
        text = values.pop("geom")
        if text is None:
            empty += 1
            continue
        try:
            geometry = json.loads(text)
            kinds.add(geometry["type"])
            for x, y in _positions(geometry["coordinates"]):
                low, high = [min(low[0], x), min(low[1], y)], [max(high[0], x), max(high[1], y)]
        except (ValueError, TypeError, KeyError):
            return {"error": "geom has a text that is not GeoJSON"}
        features.append({"type": "Feature", "geometry": geometry, "properties": {k: _cell(v) for k, v in values.items()}})
    kept = _fitting(features, MOST_BYTES)
    truncated = len(rows) > MOST_FEATURES or len(kept) < len(features)
    return {"type": "FeatureCollection", "features": kept, "bbox": [*low, *high] if features else None, "types": sorted(kinds), "without_geometry": empty, "truncated": truncated}


def _positions(coordinates: list) -> Iterator[tuple[float, float]]:
    if coordinates and isinstance(coordinates[0], (int, float)):
        yield coordinates[0], coordinates[1]
    else:
        for part in coordinates:
            yield from _positions(part)


def describe_tables(spark: SparkSession, sample: int = 0) -> list[dict]:
    """Names, columns, comments and ``sample`` rows of the registered tables."""
    return [
        {
            "table": t.name,
            "columns": [{"name": c.name, "type": c.dataType, "comment": c.description} for c in spark.catalog.listColumns(t.name)],
            "rows": [[_cell(v) for v in r] for r in spark.table(t.name).limit(sample).collect()] if sample else [],
        }
        for t in spark.catalog.listTables()
    ]
