"""Readers of open-data files: one row per feature with its properties as a map of text.

Files are listed and read by Spark. GeoJSON and JSON go through Spark's JSON functions, CSV lines
through column expressions, split as Spark splits the file. Python only opens archives and
workbooks, which yield their members and rows piece by piece. A table's header is worked out once,
as a row of data for each source, and joined to the table's lines.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: source, own id or position in it, properties, geometry as GeoJSON text, its coordinate system.
FEATURE_COLUMNS = ("source", "fid", "properties", "geometry", "srid")
#: Names of coordinate columns, as patterns (fixed values): Latin, one misspelled, and Cyrillic.
LATITUDE_NAME = r"(?i)^\s*lat(itude)?\b|ширина"
LONGITUDE_NAME = r"(?i)^\s*(lon|lng|long|longitude|longtitude)\b|дължина"
#: Separators of text tables.
SEPARATORS = (",", ";", "\t")
#: Rows of a workbook that are handed on together.
ROWS_AT_ONCE = 5_000


# Cells


def cell_text(cell: Column) -> Column:
    """A trimmed cell; empty as null."""
    return F.nullif(F.trim(cell), F.lit(""))


def number_text(value: Column) -> Column:
    """Numbers without a fraction that is zero; other texts as they are."""
    return F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1")


def coordinate(value: Column) -> Column:
    """A number with a decimal point or comma, else null."""
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def point_of(properties: Column) -> Column:
    """A GeoJSON point of the first columns named for coordinates; null if one is missing, or both are 0, or out of range."""
    named = lambda pattern: F.get(F.filter(F.map_keys(properties), lambda k: k.rlike(pattern)), F.lit(0))
    lon, lat = (coordinate(F.try_element_at(properties, named(p))) for p in (LONGITUDE_NAME, LATITUDE_NAME))
    fits = lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.when(fits, F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


_HIGH_BYTES = bytes(range(128, 256))


def text_of(raw: Column) -> Column:
    """Bytes as text: UTF-8, or else Windows-1251, without a mark of the byte order."""
    read = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(cyrillic(raw))
    return F.regexp_replace(read, "^\ufeff", "")


def cyrillic(raw: Column) -> Column:
    """Bytes of Windows-1251, which Spark does not decode, by way of Latin-1."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _HIGH_BYTES.decode("latin-1"), _HIGH_BYTES.decode("cp1251", "replace"))


# GeoJSON and JSON


def epsg(crs_name: Column) -> Column:
    """The number of a declared coordinate system: 4326 for none and for CRS84; any other name is an error."""
    code = F.regexp_extract(crs_name, r"(?i)EPSG:+(\d+)$", 1)
    unknown = F.raise_error(F.concat(F.lit("unknown coordinate system "), crs_name)).cast("int")
    return (
        F.when(crs_name.isNull() | (crs_name == "") | F.upper(crs_name).endswith("CRS84"), F.lit(4326))
        .when(code != "", F.nullif(code, F.lit("")).cast("int"))
        .otherwise(unknown)
    )


COLLECTION = "type string, crs struct<properties: struct<name: string>>, features array<struct<id: string, properties: map<string, string>, geometry: string>>"


def collection_features(texts: DataFrame) -> DataFrame:
    """Features of GeoJSON ``texts`` (source, text); any other document is an error."""
    read = texts.withColumn("doc", F.from_json("text", COLLECTION))
    wrong = F.raise_error(F.concat(F.lit("not a FeatureCollection: "), F.col("source"))).cast("array<struct<id: string, properties: map<string, string>, geometry: string>>")
    features = F.when(F.col("doc.type") == "FeatureCollection", F.coalesce("doc.features", F.array())).otherwise(wrong)
    placed = read.select("source", epsg(F.col("doc.crs.properties.name")).alias("srid"), F.posexplode(features).alias("place", "feature"))
    own = F.coalesce("feature.properties", F.create_map().cast("map<string, string>"))
    return placed.select(
        "source",
        F.coalesce(number_text(F.col("feature.id")), F.col("place").cast("string")).alias("fid"),
        F.transform_values(own, lambda _, v: number_text(F.nullif(v, F.lit("")))).alias("properties"),
        F.col("feature.geometry").alias("geometry"),
        "srid",
    )


def list_features(texts: DataFrame) -> DataFrame:
    """Rows of JSON lists ``texts`` (source, text), from 1 on; a value that is no object is one property."""
    rows = texts.select("source", F.posexplode(F.from_json("text", "array<string>")).alias("place", "row"))
    fields = F.when(F.col("row").startswith("{"), F.from_json("row", "map<string, string>")).otherwise(F.create_map(F.lit("value"), F.col("row")))
    named = rows.withColumn("properties", F.transform_values(fields, lambda _, v: number_text(F.nullif(v, F.lit("")))))
    return named.select("source", (F.col("place") + 1).cast("string").alias("fid"), "properties", point_of(F.col("properties")).alias("geometry"), F.lit(4326).alias("srid"))


# Tables


def split_cells(line: Column, separator: str) -> Column:
    """The cells of one record; quoted ones may hold separators and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(rf'{separator}("(?:[^"]++|"")*+"|[^{separator}]*+)'), F.lit(1))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda c: cell_text(bare(c)))


def csv_cells(lines: DataFrame) -> DataFrame:
    """(source, block, at, cells) of ``lines`` (source, block, at, line), line in the bytes of the file.

    A file that is not UTF-8 is Windows-1251. Its separator is the one that stands most often
    outside quotes. The lines of a file in which a quoted cell goes on are joined first.
    """
    unquoted = F.regexp_replace("line", r'"[^"]*"', "")
    times = [F.sum(F.length(unquoted) - F.length(F.replace(unquoted, F.lit(s), F.lit("")))).alias(f"_{k}") for k, s in enumerate(SEPARATORS)]
    odd = (F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))) % 2 == 1
    files = lines.groupBy("source").agg(F.bool_and(F.is_valid_utf8("line")).alias("utf8"), F.bool_or(odd).alias("joined"), *times)
    best = F.array_max(F.array(*[F.struct(F.col(f"_{k}").alias("n"), F.lit(-k).alias("first"), F.lit(s).alias("sign")) for k, s in enumerate(SEPARATORS)]))
    known = lines.join(files.select("source", "utf8", "joined", best["sign"].alias("sign")), "source")
    text = F.when(F.col("utf8"), F.col("line")).otherwise(cyrillic(F.col("line").cast("binary")))
    decoded = known.withColumn("line", F.regexp_replace(text, "^\ufeff", ""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n")
    records = F.regexp_extract_all(F.col("whole"), F.lit(r'(?:[^"\n]++|"[^"]*+")++'), F.lit(0))
    rejoined = (
        decoded.where("joined").groupBy("source", "sign").agg(whole.alias("whole"))
        .select("source", "sign", F.lit(0).cast("long").alias("block"), F.posexplode(records).alias("at", "line"))
    )
    every = decoded.where("not joined").select("source", "sign", "block", "at", "line").unionByName(rejoined.withColumn("at", F.col("at").cast("long")))
    cells = reduce(lambda c, s: F.when(F.col("sign") == s, split_cells(F.col("line"), s)).otherwise(c), SEPARATORS[1:], split_cells(F.col("line"), SEPARATORS[0]))
    return every.select("source", "block", "at", cells.alias("cells"))


def header_plan(cells: DataFrame) -> DataFrame:
    """One row a source: where its header is, its names, and which of them it does not give itself.

    The header is the first row with two cells that are filled. A blank name is col_<n>, a name that
    has been used gets its number.
    """
    filled = F.size(F.filter("cells", lambda c: c.isNotNull()))
    heads = cells.where(filled >= 2).groupBy("source").agg(F.min_by("cells", F.struct("block", "at")).alias("head"), F.min(F.struct("block", "at")).alias("header"))
    given = F.transform("head", lambda c, i: F.coalesce(c, F.concat(F.lit("col_"), (i + 1).cast("string"))))
    uses = lambda c, i: F.size(F.filter(F.slice("given", F.lit(1), i + 1), lambda x: x == c))
    name = lambda c, i: F.when(uses(c, i) > 1, F.concat_ws("_", c, uses(c, i).cast("string"))).otherwise(c)
    return heads.withColumn("given", given).select("source", "header", F.transform("given", name).alias("names"), F.transform("head", lambda c: c.isNull()).alias("unnamed"))


def table_features(cells: DataFrame) -> DataFrame:
    """Rows of tables (source, block, at, cells) below their header, numbered from 1.

    Empty rows are left out. Cells beyond the header get the names col_<n>. Cells without a name of
    their own are kept only where they are filled, others are null.
    """
    filled = F.size(F.filter("cells", lambda c: c.isNotNull())) > 0
    rows = cells.where(filled).join(header_plan(cells), "source").where(F.struct("block", "at") > F.col("header"))
    # Numbers within blocks, and what the blocks before hold: no window has all rows of a file.
    held = rows.groupBy("source", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "block").orderBy("at"))).join(starts, ["source", "block"])
    width = F.greatest(F.size("cells"), F.size("names"))
    entry = lambda i: F.struct(
        F.coalesce(F.get("names", i), F.concat(F.lit("col_"), (i + 1).cast("string"))).alias("key"),
        F.get("cells", i).alias("value"),
        F.coalesce(F.get("unnamed", i), F.lit(True)).alias("unnamed"),
    )
    entries = F.filter(F.transform(F.sequence(F.lit(0), width - 1), entry), lambda e: e["value"].isNotNull() | ~e["unnamed"])
    last = lambda e, i: ~F.exists(F.slice("entries", i + 2, F.size("entries")), lambda x: x["key"] == e["key"])
    pairs = F.transform(F.filter("entries", last), lambda e: F.struct(e["key"], e["value"]))
    named = numbered.withColumn("entries", entries).withColumn("properties", F.map_from_entries(pairs))
    return named.select(
        "source", (F.col("nth") + F.col("before")).cast("string").alias("fid"), "properties", point_of(F.col("properties")).alias("geometry"), F.lit(4326).alias("srid")
    )


# Archives and workbooks

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_TARGETS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that show dates or times (fixed values).
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def archive_members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(name!/member, bytes) of an archive, one at a time; archives within go on in the same way."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir():
                member = f"{name}!/{entry.filename}"
                if member.lower().endswith(".zip"):
                    yield from archive_members(member, archive.read(entry))
                else:
                    yield member, archive.read(entry)


def _dated(number: float) -> str:
    """An Excel day number as ISO text: with a time if it has one, a time alone below 1."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))
    if number < 1:
        return at.time().isoformat()
    return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat()


def workbook_rows(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook's sheets; whole numbers without a point, dates as ISO text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        xml = lambda part: ElementTree.fromstring(book.read(part))
        text = lambda item: "".join(t.text or "" for t in item.iter(f"{_SHEET}t"))
        strings = [text(item) for item in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{_SHEET}numFmt")}
            shows = {*_DATE_FORMATS, *(n for n, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE))}
            dates = [int(x.get("numFmtId", 0)) in shows for group in styles.iter(f"{_SHEET}cellXfs") for x in group]
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target").lstrip("/").removeprefix("xl/"))) for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iter(f"{_SHEET}sheet"):
            with book.open(targets[sheet.get(_TARGETS)]) as part:
                at = 0
                for _, row in ElementTree.iterparse(part):
                    if row.tag != f"{_SHEET}row":
                        continue
                    cells: list[str | None] = []
                    for c in row:
                        place = reduce(lambda n, letter: n * 26 + ord(letter) - 64, re.match("[A-Z]*", c.get("r", ""))[0], 0) or len(cells) + 1
                        cells += [None] * (place - 1 - len(cells))
                        value, kind = c.findtext(f"{_SHEET}v"), c.get("t", "n")
                        if kind == "s" and value is not None:
                            value = strings[int(value)]
                        elif kind == "inlineStr":
                            value = text(c)
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                        elif kind == "n" and value is not None:
                            number, style = float(value), int(c.get("s", 0))
                            value = _dated(number) if style < len(dates) and dates[style] else str(int(number)) if number.is_integer() else repr(number)
                        cells.append((value or "").strip() or None)
                    yield sheet.get("name"), at, cells
                    at += 1
                    row.clear()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                for member, content in archive_members(name, raw) if name.lower().endswith(".zip") else [(name, raw)]:
                    yield pa.RecordBatch.from_arrays([pa.array([member]), pa.array([content], pa.binary())], ["source", "content"])
            except (zipfile.BadZipFile, OSError) as e:
                raise ValueError(f"cannot read {name}: {e}") from e


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, sheet, block, at, cells), some rows at a time."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "sheet", "block", "at", "cells"])

    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            try:
                for sheet, at, cells in workbook_rows(raw):
                    rows.append((name, sheet, 0, at, cells))
                    if len(rows) == ROWS_AT_ONCE:
                        yield out(rows)
                        rows = []
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                raise ValueError(f"cannot read {name}: {e}") from e
            if rows:
                yield out(rows)


def sheet_cells(members: DataFrame) -> DataFrame:
    """Cells of workbooks (source, content); a sheet is source!/sheet where several have rows."""
    rows = members.mapInArrow(_sheets, "source string, sheet string, block long, at long, cells array<string>")
    filled = rows.where(F.size(F.filter("cells", lambda c: c.isNotNull())) > 0)
    sheets = filled.groupBy("source").agg(F.countDistinct("sheet").alias("sheets"))
    name = F.when(F.col("sheets") > 1, F.concat_ws("!/", "source", "sheet")).otherwise(F.col("source"))
    return filled.join(sheets, "source").select(name.alias("source"), "block", "at", "cells")


# All kinds


def _ends(*kinds: str) -> Column:
    return F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1)).isin(*kinds)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All features of the files under ``path``: GeoJSON, JSON lists, CSV, XLSX, and those in ZIP archives.

    Unreadable kinds have no rows. A broken file fails with its name.
    """
    files = lambda glob: {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    stored = spark.read.format("binaryFile").options(**files("*.{zip,ZIP,geojson,json,xlsx,GEOJSON,JSON,XLSX}")).load(path).select("path", "content")
    members = stored.mapInArrow(_unpacked, "source string, content binary")
    lines = spark.read.options(**files("*.{csv,CSV}")).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    texts = members.where(_ends("geojson", "json", "csv")).select("source", text_of(F.col("content")).alias("text"))
    packed = texts.where(_ends("csv")).select("source", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    is_list = F.ltrim("text").startswith("[")
    parts = [
        collection_features(texts.where(_ends("geojson", "json") & ~is_list)),
        list_features(texts.where(_ends("geojson", "json") & is_list)),
        table_features(csv_cells(lines.unionByName(packed.withColumn("at", F.col("at").cast("long"))))),
        table_features(sheet_cells(members.where(_ends("xlsx")))),
    ]
    return reduce(DataFrame.unionByName, parts).select(*FEATURE_COLUMNS)


def layer_statistics(features: DataFrame) -> DataFrame:
    """(source, features, with_geometry, geometry_type, fields, types): what a layer holds.

    ``types`` has the kinds of values that each field was seen with.
    """
    kind = F.get_json_object("geometry", "$.type")
    kinds = features.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))
    main = kinds.where("kind is not null").groupBy("source").agg(F.max_by("kind", F.struct("n", "kind")).alias("geometry_type"))
    counts = features.groupBy("source").agg(F.count("*").alias("features"), F.count("geometry").alias("with_geometry"))
    value = F.col("value")
    seen = (
        F.when(value.isNull(), "null").when(value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(value.isin("true", "false"), "boolean")
        .when(value.startswith("{"), "object").when(value.startswith("["), "array").otherwise("string")
    )
    by_field = features.select("source", F.explode("properties").alias("field", "value")).groupBy("source", "field").agg(F.array_sort(F.collect_set(seen)).alias("seen"))
    fields = by_field.groupBy("source").agg(
        F.array_sort(F.collect_list("field")).alias("fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.array_join("seen", "|"))))).alias("types"),
    )
    return counts.join(main, "source", "left").join(fields, "source", "left")


#: Kinds of files by ending, in the order in which one stands for a resource (fixed values).
KINDS = {
    "vector": ("geojson", "gpkg", "shp", "kml", "gml"),
    "table": ("csv", "xlsx", "xls", "json"),
    "raster": ("tif", "tiff", "asc", "jpg", "png"),
    "archive": ("zip", "rar", "7z", "gz"),
    "document": ("pdf", "doc", "docx", "txt"),
}


def file_kind(name: Column) -> Column:
    """The kind of a file by its ending; other if unknown."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda c, kind: F.when(ending.isin(*KINDS[kind]), kind).otherwise(c), reversed(KINDS), F.lit("other"))


def read_timetable(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, DataFrame]:
    """The text tables of an unpacked timetable: all columns text, empty as null, short rows fail."""
    return {
        name: spark.read.csv(f"{folder}/{name}.txt", header=True, nullValue="", mode="FAILFAST", enforceSchema=False, encoding="UTF-8")
        for name in tables
    }


def read_timetable_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a zipped timetable by name: those of members <name>.txt, in any folder of it.

    All columns are text, empty ones null; a row of another width than its header is an error.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_unpacked, "source string, content binary")
    name = F.regexp_extract("source", r"(?:^|/)([a-z_]+)\.txt$", 1)
    lines = raw.select(name.alias("table"), "source", F.posexplode(F.split(text_of(F.col("content")), r"\r\n|\n|\r")).alias("at", "line")).where("table != '' and trim(line) != ''")
    cells = lines.select("table", "at", split_cells(F.col("line"), ",").alias("cells"))
    heads = {r["table"]: r["cells"] for r in cells.groupBy("table").agg(F.min_by("cells", "at").alias("cells")).collect()}  # one row a table
    out = {}
    for table, names in heads.items():
        whole = F.when(F.size("cells") == len(names), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit(f"{table}: wrong number of cells in row "), F.col("at").cast("string"))))
        rows = cells.where((F.col("table") == table) & (F.col("at") > 0)).withColumn("cells", whole.cast("array<string>"))
        out[table] = rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out


def checked_corrections(corrections: DataFrame, known: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``corrections`` (key, field, value, source); rows of unknown keys or fields, or without a source, are an error.

    Nothing of a list with one bad row is taken.
    """
    unknown = corrections.join(known.select(key), key, "left_anti").select(key, F.lit("unknown key").alias("problem"))
    odd = corrections.where(~F.col("field").isin(*fields) | F.col("field").isNull()).select(key, F.lit("unknown field").alias("problem"))
    unsourced = corrections.where(cell_text(F.col("source")).isNull()).select(key, F.lit("no source").alias("problem"))
    bad = reduce(DataFrame.unionByName, [unknown, odd, unsourced]).limit(5).collect()
    if bad:
        raise ValueError("corrections: " + "; ".join(f"{r[key]}: {r['problem']}" for r in bad))
    return corrections


def corrected(rows: DataFrame, corrections: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` with the values that ``corrections`` give for a field; the last by value wins of several."""
    wide = corrections.groupBy(F.col(key).alias("_key")).pivot("field", list(fields)).agg(F.max("value"))
    joined = rows.join(wide.select("_key", *[F.col(f).alias(f"_{f}") for f in fields]), F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
