"""Matches of two sides, and keep-newest within one. Inputs are as in the report module; sides are tagged at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.scratch import written

FULL_LIST_MAX = 50
PREVIEW_LIMIT = 20


def cross_groups(files: DataFrame) -> DataFrame:
    """size, digest, n_a and n_b of every content found on both sides; one row a group, never one a pair."""
    groups = files.filter("digest is not null").groupBy("size", "digest").agg(F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"))
    return groups.filter("n_a > 0 and n_b > 0")


def cross_matches(files: DataFrame) -> DataFrame:
    """size, a and b (sorted paths) of every match, for display and export; the lists are as long as the groups, and side_lists() has the rows."""
    both = files.join(cross_groups(files).select("size", "digest"), ["size", "digest"], "left_semi")
    paths = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("path")))).alias(s.lower()) for s in "AB"]
    return both.groupBy("size", "digest").agg(*paths).select("size", "a", "b")


def side_lists(files: DataFrame) -> DataFrame:
    """side, path and size of every file that takes part in a match."""
    return files.join(cross_groups(files).select("size", "digest"), ["size", "digest"], "left_semi").select("side", "path", "size")


def write_side_lists(files: DataFrame, folder: str) -> None:
    """Side lists as text files below `folder`, one JSON string a line: side=A/ and side=B/."""
    line = F.regexp_extract(F.to_json(F.struct(F.col("path").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    side_lists(files).select("side", line.alias("value")).write.mode("overwrite").partitionBy("side").text(folder)


def side_totals(files: DataFrame) -> DataFrame:
    return side_lists(files).groupBy("side").agg(F.count("*").alias("files"), F.sum("size").alias("nbytes"))


def cross_summary(files: DataFrame) -> DataFrame:
    """matches and match_bytes; a match counts its size once."""
    return cross_groups(files).agg(F.count("*").alias("matches"), F.coalesce(F.sum("size"), F.lit(0)).alias("match_bytes"))


def kept(files: DataFrame) -> DataFrame:
    """size, digest, keep and copies of every group: the newest file stays, of equally new ones that with the smallest path."""
    groups = files.filter("digest is not null").groupBy("size", "digest").agg(F.min(F.struct((-F.col("mtime")).alias("age"), F.col("path").alias("path"))).alias("k"), F.count("*").alias("copies"))
    return groups.filter("copies >= 2").select("size", "digest", F.col("k.path").alias("keep"), "copies")


def extras(files: DataFrame) -> DataFrame:
    """keep, path and size of every file that its group does not keep."""
    return files.join(kept(files), ["size", "digest"]).filter("path <> keep").select("keep", "path", "size")


def same_matches(files: DataFrame) -> DataFrame:
    """size, keep and extras (sorted paths) of every group, for display and export; the lists are as long as the groups, and extras() has the rows."""
    return extras(files).groupBy("size", "keep").agg(F.array_sort(F.collect_list("path")).alias("extras"))


def same_summary(files: DataFrame) -> DataFrame:
    groups = kept(files)
    extra = F.col("copies") - 1
    zero = F.lit(0)
    return groups.agg(F.count("*").alias("matches"), F.coalesce(F.sum("size"), zero).alias("match_bytes"), F.coalesce(F.sum(extra), zero).alias("extras"), F.coalesce(F.sum(extra * F.col("size")), zero).alias("extra_bytes"))


def preview(groups: DataFrame, order: list[str]) -> DataFrame:
    """All groups up to 50, else the first 20, with their place; and `more`, how many are not shown."""
    groups = written(groups, "groups")
    total = groups.count()
    shown = total if total <= FULL_LIST_MAX else PREVIEW_LIMIT
    first = groups.orderBy(*order).limit(shown)
    return first.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).withColumn("more", F.lit(total - shown).cast("long"))  # 50 rows at most


def some_paths(files: DataFrame, shown: DataFrame, most: int = 20) -> DataFrame:
    """place, side or keep columns of a preview with its paths, `most` of each group at most: what a user acts on."""
    rows = files.join(F.broadcast(shown.select("place", "size", "digest")), ["size", "digest"])  # a preview has 50 rows at most
    by = W.partitionBy("place").orderBy("path")
    return rows.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= most).select("place", *[c for c in ("side",) if c in files.columns], "path", "size")
