"""Duplicate-group reports. Their input is a file relation whose links are collapsed and whose digests are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.plans.numbering import number_rows
from twinsift.scratch import written
from twinsift.sources.lines import write_lines


def duplicate_groups(files: DataFrame) -> DataFrame:
    """size, digest, copies and wasted of every content that two files or more have."""
    groups = files.filter("digest is not null").groupBy("size", "digest").agg(F.count("*").alias("copies")).filter("copies >= 2")
    return groups.withColumn("wasted", F.col("size") * (F.col("copies") - 1))


def report_groups(files: DataFrame) -> DataFrame:
    """The groups, numbered by size and digest."""
    return number_rows(duplicate_groups(files), ["size", "digest"], "group_no")


def report_members(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """group_no and path of every member; groups are those of report_groups(), where they are there already."""
    groups = report_groups(files) if groups is None else groups
    return files.join(groups.select("group_no", "size", "digest"), ["size", "digest"]).select("group_no", "path")


def report_summary(files: DataFrame, scanned: int | None = None, errors: int = 0) -> DataFrame:
    """One row: scanned, errors, groups, extra_copies, wasted; zeros where nothing is repeated."""
    contents = files.groupBy("size", "digest").agg(F.count("*").alias("copies"))
    extra = F.when(F.col("digest").isNotNull() & (F.col("copies") >= 2), F.col("copies") - 1).otherwise(0)
    seen = F.coalesce(F.sum("copies"), F.lit(0)) if scanned is None else F.lit(scanned)
    return contents.agg(
        seen.cast("long").alias("scanned"), F.lit(errors).cast("long").alias("errors"), F.count_if(extra > 0).alias("groups"),
        F.coalesce(F.sum(extra), F.lit(0)).cast("long").alias("extra_copies"), F.coalesce(F.sum(F.col("size") * extra), F.lit(0)).cast("long").alias("wasted"),
    )


def _summary_of(groups: DataFrame, scanned: int, errors: int) -> DataFrame:
    """The summary from numbered groups, without another look at the files."""
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.lit(scanned).cast("long").alias("scanned"), F.lit(errors).cast("long").alias("errors"), F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("copies") - 1), zero).alias("extra_copies"), F.coalesce(F.sum("wasted"), zero).alias("wasted"),
    )


def report_lines(files: DataFrame, scanned: int | None = None, errors: int = 0) -> DataFrame:
    """The text report as rows in order: group_no, part, key and line.

    The groups are numbered and written when this is called; from there each group gives its head and gap, one join
    gives the members, and the last line is their sum.
    """
    groups = written(report_groups(files), "numbered")
    head = F.format_string("## group %d  size=%d  copies=%d  wasted=%d", "group_no", "size", "copies", "wasted")
    frame = groups.select("group_no", F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit("").alias("key"), line.alias("line")) for part, line in ((0, head), (2, F.lit("")))])))
    body = report_members(files, groups).select("group_no", F.lit(1).alias("part"), F.col("path").alias("key"), F.col("path").alias("line"))
    last = report_summary(files, None, errors) if scanned is None else _summary_of(groups, scanned, errors)
    last = last.select(F.lit(2**62).cast("long").alias("group_no"), F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("# scanned=%d errors=%d groups=%d extra_copies=%d wasted=%d", "scanned", "errors", "groups", "extra_copies", "wasted").alias("line"))
    return frame.unionByName(body).unionByName(last)


def write_report(files: DataFrame, folder: str, scanned: int | None = None, errors: int = 0) -> None:
    """The report as one artefact, visible once it is whole: text files and a manifest that names them in report order.

    sources.lines.read_lines() gives the lines; a control character in a path is written as an escape.
    """
    lines = number_rows(report_lines(files, scanned, errors), ["group_no", "part", "key"], "place")
    write_lines(lines, folder, "place")
