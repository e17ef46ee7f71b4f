"""Grouping operators: equal sizes, hard links, equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.schema import SMALL_BYTES


def colliding(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of every key that two files or more share; a null key is none."""
    present = files
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2")


def in_collisions(files: DataFrame, keys: list[str]) -> DataFrame:
    """The files that share their key with another: a semi-join with aggregated keys, not a window over each group."""
    return files.join(colliding(files, keys).select(*keys), keys, "left_semi")


def collapse_links(files: DataFrame) -> DataFrame:
    """One file, that with the smallest path, for each inode; inode 0 is unknown and stays apart."""
    rest = [c for c in files.columns if c not in ("size", "dev", "ino")]
    own = F.when(F.col("ino") == 0, F.col("path"))
    best = files.groupBy("size", "dev", "ino", own.alias("__own")).agg(F.min_by(F.struct(*rest), "path").alias("__b"))
    return best.select(*[F.col(c) if c in ("size", "dev", "ino") else F.col(f"__b.{c}").alias(c) for c in files.columns])


def strategy(size, n):
    """How a bucket of n files of one size is compared."""
    return F.when(size == 0, "zero").when(size > SMALL_BYTES, "sample").when(n == 2, "pair").otherwise("hash")


def strategy_tiers(files: DataFrame) -> DataFrame:
    """tier, buckets and files over all sizes that files share once links are collapsed."""
    sizes = colliding(collapse_links(files), ["size"])
    return sizes.groupBy(strategy(F.col("size"), F.col("n")).alias("tier")).agg(F.count("*").alias("buckets"), F.sum("n").alias("files"))


def compare_pairs(files: DataFrame) -> DataFrame:
    """size, left_path, right_path and equal for every size that exactly two files have."""
    pairs = files.groupBy("size").agg(F.count("*").alias("n"), F.min("path").alias("left_path"), F.max("path").alias("right_path"), (F.min("digest") == F.max("digest")).alias("equal"))
    return pairs.filter("n = 2").drop("n")


def same_bytes(files: DataFrame, content: str = "content") -> DataFrame:
    """compare_pairs() by the bytes themselves, for tables that hold them: size, left_path, right_path and equal.

    Only files whose size exactly two have take part; each size's two contents meet in one join, and no digest decides.
    """
    pairs = files.groupBy("size").agg(F.count("*").alias("n"), F.min("path").alias("left_path"), F.max("path").alias("right_path")).filter("n = 2").drop("n")
    side = lambda name: files.select(F.col("size"), F.col("path").alias(f"{name}_path"), F.col(content).alias(name))
    both = pairs.join(side("left"), ["size", "left_path"]).join(side("right"), ["size", "right_path"])
    return both.select("size", "left_path", "right_path", (F.col("left").cast("binary") == F.col("right").cast("binary")).alias("equal"))


def first_two(files: DataFrame, keys: list[str], order: str = "path") -> DataFrame:
    """keys, first and second: the two lowest of each group of two or more, by a partial aggregation of the lowest of what is left."""
    low = files.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n >= 2").drop("n")
    rest = files.join(low, keys).filter(F.col(order) > F.col("first"))
    return rest.groupBy(*keys, "first").agg(F.min(order).alias("second"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """The files, links collapsed, whose content another file has; a null digest (unreadable) is no content."""
    return in_collisions(collapse_links(files), ["size", "digest"])
