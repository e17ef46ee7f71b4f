"""Staged comparison of files on disk: each stage reads only files that still collide, and none reads more than it needs.

Sizes come first, then sampled windows of files over 12,288 bytes. Two files that are left alone with each other are
compared block by block up to their first difference. Of three or more, ranges that grow fourfold are read (up to 64 KiB,
1 MiB, ... 64 MiB), and only files whose ranges are equal so far have their next one read; those equal in all are read
whole once. Every read says what went wrong and how many bytes it took, and every stage is written, so no file is read
twice and a lost executor costs a stage. Every stage is a filter below the read, never a CASE around it, because a UDF
inside CASE is called for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.content import PAIR, compare_two, file_digest, file_range, file_sample
from twinsift.operators.groups import collapse_links, colliding, in_collisions
from twinsift.schema import CUTS, SMALL_BYTES
from twinsift.scratch import written

#: What an earlier run may know of a file: its sample, its digest, and the digests of its first ranges.
KNOWN = {"sample": "string", "digest": "string", "ranges": "array<string>"}
_READS = ["path", "error", "bytes"]


@dataclass
class Comparison:
    """members: the files that have a byte-identical companion. errors: path and error of files that could not be read.
    reads: path and bytes of every read. index: every file, links too, with all that is known of it now."""

    members: DataFrame
    errors: DataFrame
    reads: DataFrame
    index: DataFrame


def compare_pairs_of_files(pairs: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """left, right and the columns of content.PAIR for pairs(left, right, left_ranges, right_ranges) of files of one size; equal is null where one can't be read."""
    names = [c.split()[0] for c in PAIR.split(", ")]

    def run(batches):
        for b in batches:
            for left, right, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = compare_two(left, right, (a or [], z or []), algorithm)
                yield pa.RecordBatch.from_pylist([{"left": left, "right": right, **dict(zip(names, row, strict=True))}], schema=_PAIR_ROWS)

    return pairs.select("left", "right", "left_ranges", "right_ranges").mapInArrow(run, f"left string, right string, {PAIR}")


_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_PAIR_ROWS = pa.schema([("left", pa.string()), ("right", pa.string()), *((n, _ARROW[k]) for n, k in (c.split() for c in PAIR.split(", ")))])


def compare_files(files: DataFrame, algorithm: str = "sha256") -> Comparison:
    """Finds the byte-identical files; what the columns `sample`, `digest` and `ranges` already say is not read again.

    Links are collapsed first. A file that can't be read drops out and is an error; of a pair, both drop out. Empty
    files are equal and never read; their digest is "". Other columns of `files` are kept.
    """
    own = [c for c in files.columns if c not in KNOWN]
    files = files.select(*own, *[F.col(c) if c in files.columns else F.lit(None).cast(kind).alias(c) for c, kind in KNOWN.items()])
    base = written(collapse_links(files), "files")
    kept = [*own, *KNOWN]
    reads: list[DataFrame] = []
    learned: list[DataFrame] = []
    null = {c: F.lit(None).cast(kind).alias(c) for c, kind in KNOWN.items()}

    def learn(rows: DataFrame, *names: str) -> None:
        learned.append(rows.select("path", *[c if c in names else null[c] for c in KNOWN]))

    def read(rows: DataFrame, column: str, how) -> DataFrame:
        """rows with their digest in `column`; files whose digest is known are not read."""
        new = written(rows.filter(F.col(column).isNull()).withColumn("__r", how), column)
        new = new.withColumn(column, F.col("__r.digest")).withColumn("error", F.col("__r.error")).withColumn("bytes", F.col("__r.bytes")).drop("__r")
        reads.append(new.select(*_READS))
        return rows.filter(F.col(column).isNotNull()).unionByName(new.filter("error is null").drop("error", "bytes"))

    sized = base.join(colliding(base, ["size"]).withColumnRenamed("n", "__n"), "size")
    empty = sized.filter("size = 0").withColumn("digest", F.lit("")).select(*kept)
    large = read(in_collisions(base, ["size"]).filter(f"size > {SMALL_BYTES}"), "sample", file_sample(algorithm=algorithm))
    learn(large, "sample")
    large = large.join(colliding(large, ["size", "sample"]).withColumnRenamed("n", "__n"), ["size", "sample"])
    alike = written(sized.filter(f"size between 1 and {SMALL_BYTES}").select(*kept, "__n").unionByName(large.select(*kept, "__n")), "alike")

    # two alone, of which neither has a digest: block by block
    key = F.when(F.col("size") > SMALL_BYTES, F.col("sample")).otherwise("").alias("__key")
    row = F.struct("path", "ranges")
    pairs = alike.filter("__n = 2").groupBy("size", key).agg(F.min(row).alias("l"), F.max(row).alias("r"), F.count("digest").alias("known")).filter("known = 0")
    pairs = pairs.select(F.col("l.path").alias("left"), F.col("r.path").alias("right"), F.col("l.ranges").alias("left_ranges"), F.col("r.ranges").alias("right_ranges"))
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = written(compare_pairs_of_files(pairs.repartition(parts), algorithm), "pairs")
    sides = [told.select(F.col(s).alias("path"), F.when(F.col("equal"), F.col("digest")).alias("digest"), F.col(f"{s}_ranges").alias("ranges"), F.col(f"{s}_error").alias("error"), F.col("bytes") / F.lit(2)) for s in ("left", "right")]
    one_by_one = sides[0].toDF("path", "digest", "ranges", "error", "bytes").unionByName(sides[1].toDF("path", "digest", "ranges", "error", "bytes"))
    reads.append(one_by_one.select("path", "error", F.col("bytes").cast("long").alias("bytes")))
    learn(one_by_one, "digest", "ranges")
    equal = alike.drop("__n", "digest", "ranges").join(one_by_one.filter("digest is not null").select("path", "digest", "ranges"), "path").select(*kept)

    # more than two, or one of two has a digest: range by range, then whole; ranges that are known are compared without a read
    left = alike.join(one_by_one.select("path"), "path", "left_anti").select(*kept).withColumn("__chain", F.coalesce("sample", F.lit("")))
    whole = []
    longest = left.agg(F.max("size")).first()[0] or 0
    for turn, cut in enumerate(CUTS):
        if longest <= cut:
            break
        whole.append(left.filter(F.col("size") <= cut))
        longer = left.filter(F.col("size") > cut)
        ranged = read(longer.withColumn("__range", F.get("ranges", F.lit(turn))), "__range", file_range(turn, algorithm=algorithm))
        ranged = ranged.withColumn("ranges", F.concat(F.slice(F.coalesce("ranges", F.array().cast("array<string>")), 1, turn), F.array("__range"))).withColumn("__chain", F.sha2(F.concat("__chain", "__range"), 256)).drop("__range")
        ranged = written(ranged, "ranged")
        learn(ranged, "ranges")
        left = in_collisions(ranged, ["size", "__chain"]).select(*left.columns)
    whole.append(left)
    rest = whole[0]
    for w in whole[1:]:
        rest = rest.unionByName(w)
    digests = read(rest.drop("__chain"), "digest", file_digest(algorithm=algorithm))
    learn(digests, "digest")
    members = empty.unionByName(equal).unionByName(in_collisions(digests, ["size", "digest"]).select(*kept))

    all_reads = _union(reads)
    news = _union(learned).groupBy("path").agg(F.max("sample").alias("__s"), F.max("digest").alias("__d"), F.max(F.struct(F.size("ranges").alias("k"), "ranges")).alias("__r"))
    index = files.join(news, "path", "left").select(*own, F.coalesce("sample", "__s").alias("sample"), F.coalesce("digest", "__d").alias("digest"), F.when(F.size("__r.ranges") > F.coalesce(F.size("ranges"), F.lit(0)), F.col("__r.ranges")).otherwise(F.col("ranges")).alias("ranges"))
    index = index.withColumn("digest", F.coalesce("digest", F.when(F.col("size") <= CUTS[0], F.get("ranges", F.lit(0)))))  # the first range is all of it
    return Comparison(members, all_reads.filter("error is not null").select("path", "error").distinct(), all_reads.select("path", "bytes"), index)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confirm_duplicates(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """The files that have a byte-identical companion, with their digest."""
    return compare_files(files, algorithm).members.drop("ranges")


def unreadable(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """path and error of the files that can't be read whole."""
    read = written(files.filter("size > 0").select("path", "size").withColumn("r", file_digest(algorithm=algorithm)), "reads")
    return read.filter("r.error is not null").select("path", F.col("r.error").alias("error"))
