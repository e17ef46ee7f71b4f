"""Disposal as a plan to review. Queries never remove anything; what carries a plan out only lists unless it is told otherwise."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.filters import is_under
from twinsift.plans.matches import extras, side_lists
from twinsift.scratch import written


class UnsafePlan(ValueError):
    """The plan would leave no copy of some content, or the folders overlap."""


def check_sides(a: str, b: str) -> None:
    """Refuses a folder inside the other: every copy could be on the list."""
    if a != b and (f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/")):
        raise UnsafePlan(f"{a} and {b} overlap")


def plan_extras(files: DataFrame) -> DataFrame:
    """path, action and reason for all but the kept file of each group."""
    return extras(files).select("path", F.lit("trash").alias("action"), F.concat(F.lit("copy of "), "keep").alias("reason"))


def plan_side(files: DataFrame, side: str) -> DataFrame:
    """path, action and reason for one side of all matches; the other side keeps its copies."""
    return side_lists(files).filter(F.col("side") == side).select("path", F.lit("trash").alias("action"), F.concat(F.lit("also on the other side of "), "side").alias("reason"))


def under(plan: DataFrame, folder: str) -> DataFrame:
    return plan.filter(is_under(F.col("path"), folder))


def into_folder(folder: str) -> Callable[[str], None]:
    """A way to dispose: the file moves to `folder`, under a name of its own that keeps the old one's end. Nothing is deleted."""

    def dispose(path: str) -> None:
        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{os.path.basename(path)}")
        if os.path.lexists(target):
            raise FileExistsError(target)
        shutil.move(path, target)

    return dispose


def _once(path: str, dispose: Callable[[str], None], journal: Path) -> tuple[str, str | None]:
    """The outcome of one path. Its entry in the journal is made before anything is done and filled in after, so a task that runs again, or twice at once, acts once."""
    entry = journal / hashlib.sha256(path.encode()).hexdigest()
    try:
        os.close(os.open(entry, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        said = entry.read_text().split("\n", 1)
        if said[0]:
            return said[0], said[1] or None
        if not os.path.lexists(path):  # the task that began it went between the act and the entry
            return "done", None
        return "unsettled", "another task began with this file and has not said how it ended"
    try:
        if not os.path.isfile(path) or os.path.islink(path):
            raise FileNotFoundError(path)
        dispose(path)
        outcome = ("done", None)
    except OSError as e:
        outcome = ("failed", str(e))
    tmp = entry.with_suffix(".new")
    tmp.write_text(f"{outcome[0]}\n{outcome[1] or ''}")
    os.replace(tmp, entry)
    return outcome


def carry_out(plan: DataFrame, dispose: Callable[[str], None], journal: str, dry_run: bool = True) -> DataFrame:
    """path, outcome and error of every file of the plan, each handled by the task that has its row.

    outcome is `listed` in a dry run, else `done`, `failed` (one failure doesn't end the others) or `unsettled` (a task
    was lost while it handled this file, which is still there: look at it). `journal` is a folder that all tasks see and
    that belongs to this plan; with the same journal, a plan that is carried out again acts on nothing twice. The
    outcomes are written before they are returned, so looking at them again doesn't act again.
    """
    if dry_run:
        return plan.select("path", F.lit("listed").alias("outcome"), F.lit(None).cast("string").alias("error"))
    folder = Path(journal.removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            told = [_once(p, dispose, folder) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, [o for o, _ in told], [e for _, e in told])], names=["path", "outcome", "error"])

    parts = max(1, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(plan.select("path").distinct().repartition(parts, "path").mapInArrow(run, "path string, outcome string, error string"), "outcomes")


def apply(plan: DataFrame, dispose: Callable[[str], None], dry_run: bool = True) -> tuple[int, int]:
    """Hands the paths to `dispose` one by one on the driver, for plans as short as a screen; (done, failed). One failure does not end the others. A dry run hands over none."""
    done = failed = 0
    for row in plan.select("path").toLocalIterator():
        try:
            if not os.path.isfile(row["path"]):
                raise FileNotFoundError(row["path"])
            if not dry_run:
                dispose(row["path"])
            done += 1
        except OSError:
            failed += 1
    return done, failed
