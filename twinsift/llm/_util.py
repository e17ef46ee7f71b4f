"""Shared plumbing: scratch space, materialised tables, Arrow batch sizes and summed partial tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 16_384  # rows of a table that are looked up at once, so that what they give stays in the cache
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        root = root.rstrip("/")
        return root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="twinsift-")
    return _own["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system layer, so it works for every store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put_file(folder: str, name: str, raw: bytes) -> str:
    """Writes a file under a temporary name, then renames it, so that a task that runs again leaves the same file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(tmp := f"{path}/_{uuid.uuid4().hex}") as f:
        f.write(raw)
    fs.move(tmp, f"{path}/{name}")
    return f"{folder}/{name}"


def get_file(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


_left: set[str] = set()  # scratch tables that a result may still read


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back: lineage ends at a durable table."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _left.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._twinsift_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    drop_scratch(df.sparkSession, df._twinsift_path)
    _left.discard(df._twinsift_path)


def sweep() -> None:
    """Deletes the scratch tables that are left: call it when no result is read any more; it also runs when Python ends."""
    while _left:
        fs, path = pafs.FileSystem.from_uri(_left.pop())
        if fs.get_file_info(path).type is not pafs.FileType.NotFound:
            fs.delete_dir(path)


@atexit.register
def _sweep_at_exit() -> None:
    try:
        sweep()
    except (OSError, pa.ArrowException):  # the store is gone before we are
        pass


_caches: list = []


def sole(cache) -> None:
    """Says that this task uses `cache` (anything with clear()); a worker that serves several operators in turn empties the others."""
    if not any(c is cache for c in _caches):
        _caches.append(cache)
    if _caches[-1] is not cache:
        for c in _caches:
            if c is not cache:
                c.clear()
        _caches[:] = [*(c for c in _caches if c is not cache), cache]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def give_back() -> None:
    """Returns what this process has freed to the system: an idle Python worker otherwise keeps the most that it ever held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have been written out: it does so, as now and then by itself, when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def small_batches(operator: Callable) -> Callable:
    """For operators whose first argument is a table: the jobs that they run themselves send Arrow batches of at most 2,000 rows and 4 MB, then the session has its settings again."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options):
        conf = docs.sparkSession.conf
        before = [conf.get(k, None) for k in _BATCH]
        for k, v in zip(_BATCH, (2000, 4 << 20), strict=True):
            conf.set(k, v)
        try:
            return operator(docs, *args, **options)
        finally:
            for k, v in zip(_BATCH, before, strict=True):
                conf.unset(k) if v is None else conf.set(k, v)

    return run


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = 500, size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and `size` bytes of their column `text` (one row at least), whatever the session's batch size is."""
    for b in batches:
        column = b.column(text)
        ends = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right"))
            hi = min(max(hi, lo + 1), lo + rows, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi
    give_back()


def in_slices(texts: pd.Series, rows: int = 500) -> Iterator[slice]:
    """Slices of a column of texts as sliced() cuts a batch."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo >= rows or size >= 1 << 20):
            yield slice(lo, k)
            lo, size = k, 0
        size += len(t or "")
    yield slice(lo, len(texts))
    give_back()


def pieces_of(text, blank: re.Pattern, size: int = 1 << 20) -> Iterator:
    """A text, or bytes, in pieces of about `size`, cut where `blank` matches, so that words stay whole and a long text isn't all words at once."""
    lo = 0
    while len(text) - lo > size and (cut := blank.search(text, lo + size)):
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]


def rows_of(batch_schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, batch_schema, strict=True)], schema=batch_schema)


def partial_blocks(table: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """One task's partial sums, cut into blocks of `rows` rows, ready for sum_blocks()."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
    parts = [(i // rows, table[i : i + rows]) for i in range(0, len(table), rows)]
    parts = [(k, p) for k, p in parts if p.any()]
    yield rows_of(schema, [k for k, _ in parts], [p.astype("<i8").tobytes() for _, p in parts])


PARTIAL = "block int, sums binary"


def sum_blocks(partials: DataFrame, shape: tuple[int, ...], rows: int) -> np.ndarray:
    """Adds partial integer tables of a fixed shape (a parameter, not the data, bounds it) and returns the total.

    Each block's partials stream through one task, which holds running sums only. Integers make the total exact and
    independent of task order.
    """
    n_blocks = -(-shape[0] // rows)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i8")
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.copy()
        if total:
            yield rows_of(pa.schema([("block", pa.int32()), ("sums", pa.binary())]), list(total), [x.tobytes() for x in total.values()])

    out = np.zeros(shape, np.int64)
    for r in partials.repartition(n_blocks, "block").mapInArrow(add, PARTIAL).collect():
        part = np.frombuffer(r["sums"], "<i8").reshape(-1, *shape[1:])
        out[r["block"] * rows : r["block"] * rows + len(part)] += part
    return out


def summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the table's rows that each row names, a block at a time."""
    out = np.empty((len(rows), table.shape[1]), table.dtype)
    step = max(1, BLOCK // rows.shape[1])
    for lo in range(0, len(rows), step):
        out[lo : lo + step] = table.take(rows[lo : lo + step], axis=0, mode="clip").sum(1)
    return out


def summed_by_key(table: np.ndarray, rows: np.ndarray, keys: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which ascend, and the sum of each key's rows of the table, whose last row is zero.

    Rows are summed `width` at a time, then the sums likewise, until each key has one; a key that has one is done.
    """
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    distinct, out = keys[first], np.empty((len(first), table.shape[1]), table.dtype)
    left, count = np.arange(len(first)), np.diff(first, append=len(keys))
    while len(left):
        parts = -(-count // width)
        slot = np.arange(len(rows)) + np.repeat((np.cumsum(parts) - parts) * width - (np.cumsum(count) - count), count)
        full = np.full(int(parts.sum()) * width, len(table) - 1, np.int64)
        full[slot] = rows
        sums = summed(table, full.reshape(-1, width))
        done = parts == 1
        out[left[done]] = sums[(np.cumsum(parts) - parts)[done]]
        left, count = left[~done], parts[~done]
        table = np.vstack([sums[np.repeat(~done, parts)], np.zeros((1, sums.shape[1]), sums.dtype)])
        rows = np.arange(len(table) - 1)
    return distinct, out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


Queries = dict[str, Callable[[SparkSession, str], DataFrame]]
