"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: set[str] = set()


def root(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; where it is unset, one of our own in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="twinsift-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """The place of a folder that nothing else has; sweep() takes it away."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of its own: worked out once, and safe from lost executors."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def written_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, one at least, as one table. A part is made and written before the next, so the driver holds what one needs."""
    path = None
    for rows in parts:
        path = path or new_folder(rows.sparkSession, name)
        rows.write.mode("append").parquet(path)
        spark, schema = rows.sparkSession, rows.schema
    return spark.read.schema(schema).parquet(path)


def sweep() -> None:
    """Deletes what written() left, once no result reads it any more; runs by itself when Python ends."""
    while _left:
        path = _left.pop()
        fs, at = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        if fs.get_file_info(at).type is not pafs.FileType.NotFound:
            fs.delete_dir(at)


@atexit.register
def _at_exit() -> None:
    try:
        sweep()
    except (OSError, pa.ArrowException):  # the store went first
        pass
