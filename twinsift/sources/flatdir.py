"""A Python data source that lists folders flat: regular files only, no links, all names, exact times and inodes.

    spark.dataSource.register(FlatDir)
    spark.read.format("flatdir").option("path", folder).load().filter("ext in ('.txt', '.md') and size > 0")

`path` is a folder or a JSON list of folders, which must be visible where the tasks run. A folder is one task for each
`entries` names (10,000), `tasks` (256) at most; each lists the names, which costs no look at a file, and examines those
whose hash is its own, so one folder of many files keeps all cores busy. Filters on path, ext, size and error are taken
over (spark.sql.python.filterPushdown.enabled): a file whose name a filter refuses is not examined. A file that can't be
examined gives a row with `error` and no figures; a folder that can't be listed gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from twinsift.scratch import written

COLUMNS = "size long, mtime double, dev long, ino long, path string, ext string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TESTS = {
    ds.EqualTo: lambda v, x: v == x, ds.In: lambda v, x: v in x, ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda v, x: x in v,
}


@dataclass
class Share(ds.InputPartition):
    """The names of a folder whose hash leaves `part` when divided by `parts`."""

    folder: str
    part: int
    parts: int


def column_of(f: ds.Filter) -> str | None:
    """The column that a filter of a kind we know is about."""
    if isinstance(f, ds.Not):
        return column_of(f.child)
    known = type(f) in _TESTS or isinstance(f, (ds.IsNull, ds.IsNotNull))
    return f.attribute[0] if known and len(f.attribute) == 1 else None


def holds(f: ds.Filter, value) -> bool | None:
    """A filter's truth; null is not true, nor is what is said of it."""
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.Not):
        inner = holds(f.child, value)
        return None if inner is None else not inner
    return None if value is None else _TESTS[type(f)](value, getattr(f, "value", None))


def ext_of(name: str) -> str:
    """The last suffix, lower-cased, of a name with something on both sides of the dot; else empty."""
    stem, dot, last = name.rpartition(".")
    return f".{last.lower()}" if stem and dot and last else ""


class FlatReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        raw = options["path"]
        self.folders = json.loads(raw) if raw.startswith("[") else [raw]
        self.entries, self.tasks = int(options.get("entries", 10_000)), int(options.get("tasks", 256))
        self.filters: dict[str, list[ds.Filter]] = {"path": [], "ext": [], "size": [], "error": []}

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802 - Spark's name
        for f in filters:
            try:
                self.filters[column_of(f)].append(f)
            except KeyError:
                yield f

    def partitions(self) -> list[Share]:
        out = []
        for folder in map(os.path.realpath, self.folders):
            try:
                with os.scandir(folder) as listing:  # counted, not kept
                    n = sum(1 for _ in islice(listing, self.entries * self.tasks))
            except OSError:
                n = 0
            parts = max(1, min(self.tasks, -(-n // self.entries)))
            out += [Share(folder, k, parts) for k in range(parts)]
        return out

    def passes(self, **values) -> bool:
        return all(holds(f, v) is True for name, v in values.items() for f in self.filters[name])

    def read(self, share: Share):
        try:
            listing = os.scandir(share.folder)
        except OSError:
            return
        with listing:
            for entry in listing:
                raw = os.fsencode(entry.name)
                if zlib.crc32(raw) % share.parts != share.part:
                    continue
                path = entry.path.encode("utf-8", "replace").decode()
                ext = ext_of(path.rpartition("/")[2])
                try:
                    if not self.passes(path=path, ext=ext) or not entry.is_file(follow_symlinks=False):
                        continue
                except OSError:
                    continue
                error, figures = None, (None,) * 4
                if path != entry.path:
                    error = "the name is not UTF-8"
                else:
                    try:
                        s = entry.stat(follow_symlinks=False)
                        figures = (s.st_size, s.st_mtime, s.st_dev, s.st_ino)
                    except OSError as e:
                        error = str(e)
                if self.passes(size=figures[0], error=error):
                    yield *figures, path, ext, error


class FlatDir(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatdir"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> FlatReader:
        return FlatReader(dict(self.options))


def listed(spark: SparkSession, folders: list[str], ext: list[str] | None = None, skip: list[str] | None = None, **options) -> DataFrame:
    """The rows of the folders, errors too; extensions and paths to skip are filters that the source takes over, as are those that follow."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FlatDir)
    rows = spark.read.format("flatdir").options(**options).option("path", json.dumps([str(f) for f in folders])).load()
    if ext:
        rows = rows.filter(F.col("ext").isin(*ext))
    return rows.filter(~F.col("path").isin(*map(str, skip))) if skip else rows


def scan_folders(spark: SparkSession, folders: list[str], ext: list[str] | None = None, skip: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The files of the folders, and the rows that could not be examined."""
    rows = listed(spark, folders, ext, skip, **options)
    return rows.filter("error is null").drop("error", "ext"), rows.filter("error is not null").select("path", "error")


@dataclass
class Scan:
    """A scan that has been written: files, errors, and what the write counted."""

    files: DataFrame
    errors: DataFrame
    scanned: int
    failed: int
    nbytes: int


def scan_once(spark: SparkSession, folders: list[str], ext: list[str] | None = None, skip: list[str] | None = None, **options) -> Scan:
    """Lists the folders into a table; the counts come from that write, not from jobs of their own."""
    seen = Observation("scan")
    counts = [F.count_if(F.col("error").isNull()).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("size"), F.lit(0)).alias("nbytes")]
    rows = written(listed(spark, folders, ext, skip, **options).observe(seen, *counts), "scan")
    return Scan(rows.filter("error is null").drop("error", "ext"), rows.filter("error is not null").select("path", "error"), seen.get["scanned"], seen.get["failed"], seen.get["nbytes"])
