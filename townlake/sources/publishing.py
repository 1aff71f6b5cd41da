"""Sets of tables that readers see whole: all of a load, or all of what was there before.

Every load writes its tables beside the old ones, and then one small manifest with the next number, which
must not exist yet. Readers take the highest manifest. So a load that stops half way changes
nothing, of two loads at once one fails, and a reader keeps what it began with. No file is ever
renamed or overwritten, which object stores can't do in one step.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Busy(Exception):
    """Another run holds the lock, or has published meanwhile."""


def _files(spark: SparkSession, folder: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet."""
    files, to = _files(spark, path)
    try:
        out = files.create(to(path), False)
    except Exception as error:
        if files.exists(to(path)):
            raise Busy(path) from error
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    files, to = _files(spark, folder)
    at = to(f"{folder}/manifests")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """Number, time and the path of each table of a version, the newest by default; without any, number 0 and no tables."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return {"number": 0, "tables": {}}
    return json.loads(_read(spark, f"{folder}/manifests/{number or numbers[-1]:012d}.json"))


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], checks: Callable[[dict[str, DataFrame]], None] | None = None) -> int:
    """Write ``tables`` and make them the newest version, beside the former tables of other names; returns its number.

    ``checks`` gets the written tables and raises to refuse them. Whatever fails, readers see the version before.
    """
    before = manifest(spark, folder)
    number, load = before["number"] + 1, uuid.uuid4().hex
    paths = {name: f"{folder}/tables/{name}/{number:012d}-{load}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    if checks:
        checks({name: spark.read.parquet(path) for name, path in paths.items()})
    _write_new(spark, f"{folder}/manifests/{number:012d}.json", json.dumps({"number": number, "at": time.time(), "tables": before["tables"] | paths}))
    return number


def published(spark: SparkSession, folder: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the newest version, or of another one."""
    return spark.read.parquet(manifest(spark, folder, number)["tables"][name])


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the versions before the newest ``keep`` ones and what no kept one has; how many tables' files went.

    Files of loads under way are later than the newest version, and stay.
    """
    files, to = _files(spark, folder)
    numbers = _numbers(spark, folder)
    kept = {"/".join(path.split("/")[-2:]) for n in numbers[-keep:] for path in manifest(spark, folder, n)["tables"].values()}
    gone = 0
    for n in numbers[:-keep]:
        files.delete(to(f"{folder}/manifests/{n:012d}.json"), False)
    tables = to(f"{folder}/tables")
    for of_name in files.listStatus(tables) if files.exists(tables) else []:
        for version in files.listStatus(of_name.getPath()):
            name = version.getPath().getName()
            if f"{of_name.getPath().getName()}/{name}" not in kept and int(name.split("-")[0]) <= (numbers or [0])[-1]:
                files.delete(version.getPath(), True)
                gone += 1
    return gone


@contextmanager
def single_flight(spark: SparkSession, folder: str, name: str, lease_seconds: float = 600.0) -> Iterator[None]:
    """Hold a lock for a run; a second run gets ``Busy`` until the first ends or its lease is over.

    Each lock is a file with a number of its own, so that of two runs that find an old lease one goes on.
    """
    files, to = _files(spark, folder)
    at = to(f"{folder}/locks/{name}")
    held = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
    held = [n for n in held if not n.startswith(".")]
    number = 1
    if held:
        last = json.loads(_read(spark, f"{folder}/locks/{name}/{held[-1]}"))
        if last["until"] > time.time():
            raise Busy(name)
        number = last["number"] + 1
    path = f"{folder}/locks/{name}/{number:012d}"
    _write_new(spark, path, json.dumps({"number": number, "until": time.time() + lease_seconds}))
    try:
        yield
    finally:
        files.delete(to(path), False)
        for n in held:
            files.delete(to(f"{folder}/locks/{name}/{n}"), False)
