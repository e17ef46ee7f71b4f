"""Scalar functions over sizes, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n: Column) -> Column:
    """Bytes in the largest of five units that leaves at least 1, one decimal rounded half to even; whole bytes below 1024."""
    out = F.concat(F.bround(n / F.lit(float(1024**4)), 1).cast("decimal(20,1)").cast("string"), F.lit(" TB"))
    for power in (3, 2, 1):
        step = float(1024**power)
        out = F.when(n < step * 1024, F.concat(F.bround(n / F.lit(step), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {_UNITS[power]}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix, lower-cased, of a name with something on both sides of the dot; else empty."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+([.][^.]+)$", 1))


def parsed_extension(token: Column) -> Column:
    """`mp4`, `.MP4` and `*.mp4` as `.mp4`; null for what is no extension of 1 to 10 letters or digits."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(token)), r"^[*][.]", "."), r"^[.]", "")
    return F.when(body.rlike(r"\A[a-z0-9]{1,10}\z"), F.concat(F.lit("."), body))


def windows_path(path: Column) -> Column:
    """/mnt/c/dir/file as C:\\dir\\file; null elsewhere."""
    rest = F.translate(F.regexp_extract(path, r"(?s)^/mnt/[A-Za-z](/.*)?$", 1), "/", "\\")
    return F.when(path.rlike(r"(?s)\A/mnt/[A-Za-z](/.*)?\z"), F.concat(F.upper(F.substring(path, 6, 1)), F.lit(":"), F.when(rest == "", F.lit("\\")).otherwise(rest)))
