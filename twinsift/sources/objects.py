"""Files of an object store, or of any path that Spark reads, by the binaryFile source: listing without content, content only where sizes collide.

It differs from flatdir in what the source can't say: empty files and names that start with . or _ are left out, symbolic
links are followed, there are no inodes (so links are never collapsed) and times are whole milliseconds, a name pattern
is sensitive to case, and paths are URIs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.content import content_digest
from twinsift.operators.filters import with_extensions
from twinsift.operators.groups import colliding, in_collisions
from twinsift.scratch import written, written_in_turn


_OPEN = "spark.sql.files.openCostInBytes"


@contextmanager
def many_to_a_task(spark: SparkSession, cost: int = 64 << 10) -> Iterator[None]:
    """Small objects count as 64 KB, not 4 MB, when jobs started inside are cut into tasks: about 2,000 to a task, not 32."""
    before = spark.conf.get(_OPEN, None)
    spark.conf.set(_OPEN, str(cost))
    try:
        yield
    finally:
        spark.conf.unset(_OPEN) if before is None else spark.conf.set(_OPEN, before)


def list_objects(spark: SparkSession, folder: str | list[str], ext: list[str] | None = None) -> DataFrame:
    """size, mtime, dev, ino and path of the objects of a folder or several, each flat; content isn't read. dev and ino are 0, which is unknown."""
    rows = spark.read.format("binaryFile").load(folder)
    zero = F.lit(0).cast("long")
    files = rows.select(F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), zero.alias("dev"), zero.alias("ino"), "path")
    return with_extensions(files, ext)


def size_ranges(files: DataFrame) -> list[tuple[int, int]]:
    """The least and greatest colliding size of each power of two that has any: 63 ranges at most, for a filter that the scan takes over."""
    power = F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("power")
    found = colliding(files.filter("size > 0"), ["size"]).groupBy(power).agg(F.min("size").alias("low"), F.max("size").alias("high"))
    return sorted((r["low"], r["high"]) for r in found.collect())


def object_digests(spark: SparkSession, folder: str | list[str], ranges: list[tuple[int, int]], algorithm: str = "sha256") -> DataFrame:
    """path, size and digest of the objects whose size lies in one of the ranges; the scan skips the content of others."""
    rows = spark.read.format("binaryFile").load(folder)
    inside = reduce(or_, [(F.col("length") >= low) & (F.col("length") <= high) for low, high in ranges], F.lit(False))
    return rows.filter(inside).select("path", F.col("length").alias("size"), content_digest(F.col("content"), algorithm).alias("digest"))


def equal_objects(spark: SparkSession, folder: str | list[str], ext: list[str] | None = None, algorithm: str = "sha256", at_once: int = 50) -> DataFrame:
    """The objects that have a byte-identical companion, with their digest.

    Sizes are listed first; only objects whose size another one has, or that lie between such sizes within a power of
    two, are read, and each is hashed where it is read. Of several folders, all of which are compared with each other,
    `at_once` are listed and read in turn: Spark holds the names of all objects that one scan reads in the driver, so
    what the driver holds grows with a folder's objects, not with the number of folders.
    """
    folders = [folder] if isinstance(folder, str) else list(folder)
    turns = [folders[k : k + at_once] for k in range(0, len(folders), at_once)]
    with many_to_a_task(spark):
        files = written_in_turn((list_objects(spark, f, ext) for f in turns), "objects")
        alike, ranges = in_collisions(files, ["size"]), size_ranges(files)
        digests = (object_digests(spark, f, ranges, algorithm).select("path", "digest") for f in turns)
        digests = next(digests) if len(turns) == 1 else written_in_turn(digests, "hashed")
        found = written(alike.join(digests, "path"), "digests")
    return in_collisions(found, ["size", "digest"])
