"""Shards of near equal bytes by histogram sort.

Rows are put in the order of a key: the hash of the text, then the id, then the row's number, so copies are neighbours
and still any row can be a boundary. Boundaries are found by counting alone: each round puts probes between the bounds
of every boundary, each task counts the exact rows and bytes between probes, and their sums narrow the bounds, until a
boundary is within the tolerance or only one row lies between its bounds. Then rows are exchanged once, straight to
their range; a shard is some ranges in a row, so no task sorts a shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.llm._util import materialise, unused

_SIGN = 1 << 63
_DIGITS = 15  # hexadecimal digits of a text's hash, so that it is a positive long
_KEY = "S24"  # three numbers, each as 8 bytes that sort as the number does


class Keys:
    """Keys as numbers, without the gaps that the table's least and greatest ids and row numbers show to be empty."""

    def __init__(self, ids: tuple[int, int], rows: tuple[int, int]):
        self.ids, self.rows = ids, rows
        self.spans = (ids[1] - ids[0] + 1, rows[1] - rows[0] + 1)
        self.end = (self.spans[0] * self.spans[1]) << 4 * _DIGITS  # after all keys

    def packed(self, keys: list[int]) -> np.ndarray:
        out = np.empty((len(keys), 3), ">u8")
        for k, key in enumerate(keys):
            rest, row = divmod(key, self.spans[1])
            digest, doc = divmod(rest, self.spans[0])
            out[k] = digest + _SIGN, doc + self.ids[0] + _SIGN, row + self.rows[0] + _SIGN
        return out.view(_KEY).ravel()


def _packed(*columns: pa.Array) -> np.ndarray:
    """The rows' keys, as Keys.packed() writes them."""
    signless = [c.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(_SIGN) for c in columns]
    return np.ascontiguousarray(np.stack(signless, 1).astype(">u8")).view(_KEY).ravel()


def _cuts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _KEY) if raw else np.zeros(0, _KEY)


def histogram(table: DataFrame, probes: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact rows and bytes below each of the ascending probes, of a table of digest, id, row and size.

    Each task counts what lies between the probes, and sends a row for each gap that it has rows in.
    """
    told, n = table.sparkSession.sparkContext.broadcast(probes.tobytes()), len(probes)

    def count(batches):
        cuts, rows, sizes = _cuts(told.value), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for b in batches:
            at = np.searchsorted(cuts, _packed(b.column(0), b.column(1), b.column(2)), "right")
            rows += np.bincount(at, minlength=n + 1)
            np.add.at(sizes, at, b.column(3).to_numpy())
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, rows[k], sizes[k])], names=["gap", "rows", "bytes"])

    parts = table.select("digest", "id", "row", "size").mapInArrow(count, "gap long, rows long, bytes long")
    sums = parts.groupBy("gap").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).toArrow()  # a row for each gap
    out = np.zeros((2, n + 1), np.int64)
    out[:, sums["gap"].to_numpy()] = sums["rows"].to_numpy(), sums["bytes"].to_numpy()
    rows, sizes = np.cumsum(out, 1)[:, :-1].tolist()
    return rows, sizes


class Boundary:
    """The end of `part` of `parts` equal shares of all bytes, between two keys below which the rows and bytes are known."""

    def __init__(self, part: int, parts: int, slack: float, rows: int, total: int, end: int):
        self.aim, self.parts, self.slack = part * total, parts, slack * parts
        self.low, self.high = (0, 0, 0), (end, rows, total)  # key, rows and bytes below it

    def off(self, at: tuple[int, int, int]) -> int:
        return abs(self.aim - self.parts * at[2])

    def nearest(self) -> tuple[int, int, int]:
        return self.low if self.off(self.low) <= self.off(self.high) else self.high

    def settled(self) -> bool:
        return self.high[1] - self.low[1] <= 1 or self.high[0] - self.low[0] <= 1 or self.off(self.nearest()) <= self.slack

    def narrow(self, probes: list[int], rows: list[int], sizes: list[int]) -> None:
        k = bisect_right(sizes, self.aim // self.parts)
        if k and probes[k - 1] > self.low[0]:
            self.low = (probes[k - 1], rows[k - 1], sizes[k - 1])
        if k < len(probes) and probes[k] < self.high[0]:
            self.high = (probes[k], rows[k], sizes[k])


def settle(bounds: list[Boundary], table: DataFrame, keys: Keys, most_probes: int = 8192, max_rounds: int = 300) -> int:
    """Narrows all bounds until they are settled, and returns the rounds that took. Boundaries between the same bounds share their probes."""
    for turn in range(max_rounds):
        unsettled = Counter((b.low[0], b.high[0]) for b in bounds if not b.settled())
        if not unsettled:
            return turn
        each = min(64, max(1, most_probes // unsettled.total()))
        probes = sorted({lo + (hi - lo) * k // (each * n + 1) for (lo, hi), n in unsettled.items() for k in range(1, each * n + 1)} - {0})
        rows, sizes = histogram(table, keys.packed(probes))
        for b in bounds:
            b.narrow(probes, rows, sizes)
    raise RuntimeError(f"boundaries did not settle in {max_rounds} rounds")


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of every row; with `carry`, all columns of docs instead of doc_id, and these.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. A shard is a run of rows in key order; its ends are the
    rows' ends nearest to equal shares of the bytes, or, with a tolerance (in shards), any that is as near. So a shard is
    at most a row larger or smaller than its share. Slots count a shard's rows from 0 in key order. Repeated rows take a
    slot each, null ids come first among copies; fewer rows than shards leave some empty; an empty table gives no rows.
    Other columns are not read unless they are carried; names that clash get underscores.
    """
    spark, names = docs.sparkSession, docs.columns if carry else []
    digest, doc, row, at, rank, crc, size, law, number, slot, grown, place, first = unused(names, "digest", "id", "row", "range", "rank", "text_crc32", "size", "law", "shard", "slot", "grown_shard", "place", "first")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("long").alias(digest), F.coalesce(F.col(id_col).cast("long"), F.lit(-_SIGN)).alias(doc), F.monotonically_increasing_id().alias(row)]
    columns += [F.crc32(text.cast("binary")).alias(crc), (F.octet_length(text).cast("long") + 8).alias(size)]
    table = materialise(docs.select("*" if carry else F.col(id_col).cast("long").alias("doc_id"), *columns), "keys")  # now the row numbers are fixed
    narrow = table.select(F.col(digest).alias("digest"), F.col(doc).alias("id"), F.col(row).alias("row"), F.col(size).alias("size"))
    rows, total, *ends = narrow.agg(F.count("*"), F.sum("size"), F.min("id"), F.max("id"), F.min("row"), F.max("row")).first()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)  # of each shard
    parts = shards * ranges
    found = [(0, 0, 0)] * (parts - 1)
    if rows:
        keys = Keys((ends[0], ends[1]), (ends[2], ends[3]))
        bounds = [Boundary(k, parts, total / parts / 10 if k % ranges else tolerance * total / shards, rows, total, keys.end) for k in range(1, parts)]
        settle(bounds, narrow, keys)
        found = sorted(b.nearest() for b in bounds)
    cuts = spark.sparkContext.broadcast(keys.packed([k for k, _, _ in found]).tobytes() if rows else b"")

    @F.arrow_udf("int")
    def range_of(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(_cuts(cuts.value), _packed(a, b, c), "right").astype(np.int32))

    placed = table.withColumn(at, range_of(digest, doc, row)).repartitionById(parts, F.col(at)).withColumn(rank, F.row_number().over(W.partitionBy(at).orderBy(digest, doc, row)))
    before = [0, *(n for _, n, _ in found)]
    places = spark.createDataFrame([(k, k // ranges, n - before[k // ranges * ranges]) for k, n in enumerate(before)], f"`{place}` int, `{number}` int, `{first}` long")
    placed = placed.join(F.broadcast(places), F.col(at) == F.col(place))  # a row for each range, whose number is a parameter
    out = [size, crc, F.lit("bytes").alias(law), number, (F.col(first) + F.col(rank) - 1).alias(slot), F.lit(None).cast("int").alias(grown)]
    return placed.select(*(names or ["doc_id"]), *out)


def write_shards(docs: DataFrame, folder: str, shards: int = 24, **options) -> None:
    """Writes whole rows as Parquet below `folder`, a folder for each shard; each task writes the ranges it has in key order."""
    (name,) = unused(docs.columns, "shard")
    shard(docs, shards, carry=True, **options).write.partitionBy(name).parquet(folder)


def oracle(shards: int = 24) -> str:
    """DuckDB SQL for shard() over documents: running sums in key order, and the rows' ends nearest to equal shares."""
    return f"""
    WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
    keyed AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST('0x' || substring(md5(coalesce(text, '')), 1, {_DIGITS}) AS BIGINT) AS h FROM documents),
    bytes AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM (SELECT DISTINCT text FROM keyed)),
    crcs AS (SELECT text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, crc),
    ordered AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM keyed), whole AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM keyed),
    ends AS (
      SELECT j, j * total AS aim, coalesce(max(upto) FILTER (WHERE {shards} * upto <= j * total), 0) AS below, min(upto) FILTER (WHERE {shards} * upto > j * total) AS above
      FROM ordered, whole, (SELECT unnest(range(1, {shards})) AS j) GROUP BY j, total
    ), cuts AS (SELECT CASE WHEN aim - {shards} * below <= {shards} * above - aim THEN below ELSE above END AS cut FROM ends
    ), placed AS (SELECT doc_id, size, text, h, (SELECT CAST(count(*) AS INT) FROM cuts WHERE cut <= upto - size) AS shard FROM ordered)
    SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM placed JOIN crcs USING (text)
    """
