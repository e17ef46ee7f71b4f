"""Row filters and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.text import base_name, suffix


def with_extensions(files: DataFrame, ext: list[str] | None, name: Column | None = None) -> DataFrame:
    """Files whose last suffix is one of ext; all files where ext is empty or None."""
    if not ext:
        return files
    return files.filter(suffix(base_name(F.col("path")) if name is None else name).isin(*ext))


def without_paths(files: DataFrame, skip: DataFrame, on: str = "path") -> DataFrame:
    """Files that the skip list does not name."""
    return files.join(skip.select(on).distinct(), on, "left_anti")


def is_under(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder, by components."""
    return path.startswith(folder.rstrip("/") + "/")


def in_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files with `folder` and the other columns of folders(folder, ...): the deepest folder that each path lies in, by components; null where there is none.

    Each path's ancestors, of which there are as many as it has components, are joined with the folders, and a partial
    aggregation keeps the deepest: so folders may be many, and lie in each other, and a file belongs to one.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("__depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))
    inside = files.filter(F.size(parts) > 1).select("path", F.inline(ancestors))
    named = folders.withColumn("folder", F.regexp_replace("folder", "/+$", "")).dropDuplicates(["folder"])
    deepest = inside.join(named, "folder").groupBy("path").agg(F.max_by(F.struct(*named.columns), "__depth").alias("__f"))
    return files.join(deepest, "path", "left").select(*files.columns, *[F.col(f"__f.{c}").alias(c) for c in named.columns])


def concatenated(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
