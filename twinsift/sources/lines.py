"""A sink for ordered lines as one artefact: text files and a manifest that names them in order, visible all at once.

    spark.dataSource.register(Lines)
    rows.repartitionByRange("place").sortWithinPartitions("place").select("place", "line").write.format("lines").mode("overwrite").save(folder)

Rows are `place` (an array of longs that orders tasks) and `line`. A task writes its lines to a hidden file of its own, so a task that fails or runs twice leaves
nothing visible; when all are done, the files get their names and the manifest is written last. A reader takes the files
that the manifest names. A line end or other control character inside a line is written as a JSON escape, so no path can
forge a line.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds

MANIFEST = "manifest.json"
_CONTROL = re.compile("[\x00-\x1f\x7f\x85\u2028\u2029]")


def one_line(text: str) -> str:
    return _CONTROL.sub(lambda c: f"\\u{ord(c[0]):04x}", text)


@dataclass
class Part(ds.WriterCommitMessage):
    name: str
    first: list[int] | None
    lines: int


class LinesWriter(ds.DataSourceWriter):
    """Files must be where the driver and the tasks see them."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = Path(folder.removeprefix("file://")), overwrite, uuid.uuid4().hex
        self.staging = self.folder / f".{self.run}"

    def write(self, rows) -> Part:
        self.staging.mkdir(parents=True, exist_ok=True)
        name, first, n = uuid.uuid4().hex, None, 0
        with open(self.staging / name, "w", encoding="utf-8", newline="\n") as f:
            for place, line in rows:
                first = list(place) if first is None else first
                f.write(one_line(line) + "\n")
                n += 1
        return Part(name, first, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m and m.lines), key=lambda m: m.first)
        before = read_manifest(self.folder)
        if before and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(str(self.folder))
        self.folder.mkdir(parents=True, exist_ok=True)
        names = [f"{self.run}-{k:06d}.txt" for k in range(len(parts))]
        for m, name in zip(parts, names, strict=True):
            os.replace(self.staging / m.name, self.folder / name)
        tmp = self.folder / f".{self.run}.json"
        tmp.write_text(json.dumps([{"file": n, "lines": m.lines} for n, m in zip(names, parts, strict=True)]))
        os.replace(tmp, self.folder / MANIFEST)  # from here on the new lines are the folder's
        for old in before:
            (self.folder / old["file"]).unlink(missing_ok=True)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.staging.is_dir():
            for f in self.staging.iterdir():
                f.unlink(missing_ok=True)
            self.staging.rmdir()


class Lines(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "place array<long>, line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options)["path"], overwrite)


def read_manifest(folder: str | Path) -> list[dict]:
    """The files of a folder of lines in order, with their numbers of lines; none where nothing has been written."""
    path = Path(folder) / MANIFEST
    return json.loads(path.read_text()) if path.is_file() else []


def read_lines(folder: str | Path):
    """The lines, one after the other."""
    for part in read_manifest(folder):
        with open(Path(folder) / part["file"], encoding="utf-8", newline="\n") as f:
            yield from (line.removesuffix("\n") for line in f)


def write_lines(rows: DataFrame, folder: str, *place: str) -> None:
    """Writes the column `line` of rows in the order of the integer columns `place`; ranges of the order are written by tasks of their own."""
    from pyspark.sql import functions as F

    rows.sparkSession.dataSource.register(Lines)
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.select(F.array(*[F.col(c).cast("long") for c in place]).alias("place"), "line").write.format("lines").mode("overwrite").save(folder)
