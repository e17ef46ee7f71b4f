"""Index files: JSON lines of [size,mtime,dev,ino,path,sample,digest], and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.schema import FILES


def encode_row() -> Column:
    """One line for each row; times keep their full precision and a missing digest is an empty string."""
    numbers = [F.col("size"), F.col("mtime"), F.col("dev"), F.col("ino")]
    strings = [F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for c in ("path", "sample", "digest")]
    return F.concat(F.lit("["), F.concat_ws(",", *[x.cast("string") for x in numbers], *strings), F.lit("]"))


def decode_row(line: Column) -> list[Column]:
    """The columns of a line; empty digests are null."""
    parts = F.from_json(line, "array<string>")
    kinds = {f.name: f.dataType for f in FILES}
    out = []
    for i, name in enumerate(FILES.names):
        c = F.get(parts, i).cast(kinds[name])
        out.append((F.nullif(c, F.lit("")) if name in ("sample", "digest") else c).alias(name))
    return out


def _filled(files: DataFrame, columns: T.StructType = FILES) -> DataFrame:
    return files.select(*[F.col(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])


def write_index(files: DataFrame, path: str) -> None:
    _filled(files).select(encode_row().alias("value")).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines don't count."""
    return spark.read.text(path).filter(F.trim("value") != "").select(*decode_row(F.col("value")))


#: What an index keeps for the next run: the file relation and the digests of first ranges.
KEPT = T.StructType([*FILES, T.StructField("ranges", T.ArrayType(T.StringType()))])


def write_parquet_index(files: DataFrame, path: str) -> None:
    _filled(files, KEPT).write.mode("overwrite").parquet(path)


def read_parquet_index(spark: SparkSession, path: str) -> DataFrame:
    """What write_parquet_index() wrote, with the file relation's types."""
    return spark.read.schema(FILES).parquet(path)


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """What write_parquet_index() wrote, with all that the next run can use."""
    return spark.read.schema(KEPT).parquet(path)


def carried_over(files: DataFrame, index: DataFrame) -> DataFrame:
    """files with the sample, digest and ranges that an earlier run's index has of them: of files whose size, time, device and inode are still the same.

    A file that the index doesn't have, or has otherwise, has nulls and will be read. A path counts once in an index.
    """
    known = [c for c in ("sample", "digest", "ranges") if c in index.columns]
    same = ["path", "size", "mtime", "dev", "ino"]
    once = index.groupBy(*same).agg(*[F.max(c).alias(c) for c in known])
    own = [c for c in files.columns if c not in ("sample", "digest", "ranges")]
    return files.select(*own).join(once, same, "left").select(*own, *known)


def changes(files: DataFrame, index: DataFrame) -> DataFrame:
    """path and what became of it since the index was written: new, changed, gone or same."""
    figures = ["size", "mtime", "dev", "ino"]
    now = files.select("path", F.struct(*figures).alias("now"))
    then = index.groupBy("path").agg(F.max(F.struct(*figures)).alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return now.join(then, "path", "full").select("path", state.alias("state"))
