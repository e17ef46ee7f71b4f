"""A file relation over a table whose rows hold content."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.content import full_digest, sample_digest, size_of
from twinsift.scratch import new_folder, written


def _columns() -> list[Column]:
    return [
        F.col("doc_id"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("."), "lang").alias("path"), F.col("source").alias("folder"),
        F.concat(F.lit("."), "lang").alias("ext"), size_of(F.col("text")).alias("size"), (F.col("doc_id") % 7).cast("double").alias("mtime"), F.lit(0).cast("long").alias("dev"),
        F.when(F.substring("source", 4, 9).cast("int") < 10, "A").otherwise("B").alias("side"),
    ]


def documents_as_paths(documents: DataFrame) -> DataFrame:
    """documents as files without content: doc_id, path, folder, ext, size, mtime, dev and side. Nothing is worked out now, and a query that needs no size reads no text."""
    return documents.select(*_columns())


def documents_as_files(documents: DataFrame, sample: bool = False) -> DataFrame:
    """documents_as_paths() with ino, digest and, if asked for, sample.

    Equal texts of one parity are hard links of each other, except that every fifth document has an unknown inode.
    Content stays in the scan: only digests are passed on, by a table that is written when this is called, so texts are
    read and hashed once. Queries that need no digest and no inode take documents_as_paths().
    """
    text, unknown = F.col("text"), (F.col("doc_id") % 5 == 0).alias("unknown")
    digests = [full_digest(text).alias("digest"), *([sample_digest(text).alias("sample")] if sample else [])]
    rows = written(documents.select(*_columns(), *digests, (F.col("doc_id") % 2).alias("parity"), unknown), "digests")
    # the smallest id of each set of links: aggregated before it is joined, so a common text is no hot group
    links = rows.filter(~F.col("unknown")).groupBy("digest", "parity").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "parity", "first")
    joined = rows.join(links, ["digest", "parity"], "left")
    return joined.withColumn("ino", F.when(F.col("unknown"), F.lit(0)).otherwise(F.coalesce("first", "doc_id")).cast("long")).drop("parity", "unknown", "first")


def as_folder(documents: DataFrame, name: Column, entries: int = 5000) -> str:
    """Writes each text as a file of the column `name` in one new flat folder of the shared place and returns the folder. A null text gives no file; names must differ.

    Rows are dealt by name over a task for each `entries` of them, because a table may come in one piece.
    """
    return _as_files(documents, name, entries)[0]


def as_folders(documents: DataFrame, name: Column, entries: int = 5000, held: int = 1000) -> list[str]:
    """as_folder() over as many folders as have about `held` files each, dealt by a hash of the name, as a store has prefixes; returns them all."""
    return _as_files(documents, name, entries, held)


def _as_files(documents: DataFrame, name: Column, entries: int, held: int = 0) -> list[str]:
    folder = new_folder(documents.sparkSession, "folder").removeprefix("file://")

    def write(batches):
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                # under a hidden name first, so that a task that runs again leaves the same file
                tmp = os.path.join(os.path.dirname(os.path.join(folder, n)), f".{uuid.uuid4().hex}")
                with open(tmp, "wb") as f:
                    f.write(raw.as_buffer())
                os.replace(tmp, os.path.join(folder, n))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    n = documents.count()
    folders = [os.path.join(folder, f"p{k:06d}") for k in range(max(1, -(-n // held)))] if held else [folder]
    for f in folders:
        os.makedirs(f, exist_ok=True)
    rows = documents.select(name.alias("name"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    if held:
        rows = rows.withColumn("name", F.concat(F.format_string("p%06d/", F.pmod(F.xxhash64("name"), F.lit(len(folders)))), "name"))
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // entries))
    rows.repartition(parts, "name").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folders
