"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash of the last 16 bytes is rolled over each text; a chunk ends where it is as high as anywhere within 15 places. So cuts depend on nearby bytes alone, chunks line up again after an insertion, and few are much longer than
the mean of 31 bytes. Blanks of any kind and number count as one space. A chunk whose
digest occurs in several documents is repeated. Chunks are seeds only: a window of min_words + 1 words is looked at if
all chunks that any copy of it must share are repeated, and it is repeated if several documents hold it (128-bit hashes
of its words). So chunk digests of 64 bits that collide only add windows to look at. Windows in a row make a passage, so passages end at the exact word and each window has its first holder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.llm._util import forget, in_slices, materialise, release, sliced, small_batches, unused

_GEAR = np.random.default_rng(1616).integers(0, 1 << 16, 256, dtype=np.uint16)
_REACH = 16
_CLOSE = 8  # of equal tops, as in text that repeats a few words over and over, those less than this apart are no cuts
_HEAD, _TAIL = 40, 16  # bytes of a shared text in which its surroundings can still move a cut
_NEVER = 1 << 30
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _highest(h: np.ndarray, width: int) -> np.ndarray:
    """The highest of each value and the width - 1 after it, by doubling; zeros stand beyond the end."""
    out, have = np.append(h, np.zeros(width, h.dtype)), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.maximum(out[:-step], out[step:])
        have += step
    return out


def cut_points(data: np.ndarray, around: int = 15) -> np.ndarray:
    """Where chunks of these bytes end (exclusive), the end of the data included."""
    if not len(data):
        return np.zeros(0, np.int64)
    g = _GEAR[data]
    h = g.copy()
    for k in range(1, min(_REACH, len(g))):
        h[k:] += g[:-k] << np.uint16(k)
    high = _highest(h, around)
    top = h >= high[1 : len(h) + 1]
    top[around:] &= h[around:] >= high[: max(0, len(h) - around)]
    top[:around] = False
    ends = np.flatnonzero(top) + 1
    ends = ends[(ends < len(data)) & (np.diff(ends, prepend=-_CLOSE) >= _CLOSE)]
    ends = ends[(data[ends] & 0xC0) != 0x80]  # not inside a code point
    return np.append(ends, len(data))


def _plain(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with every run of blanks, line ends too, as one space; where each of its bytes is in raw, and the end of raw; which bytes of raw begin a word."""
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    kept = np.append(True, ~(blank[1:] & blank[:-1]))
    return np.where(blank, np.uint8(32), data)[kept], np.append(np.flatnonzero(kept), len(data)), first


def _windows(plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a plain text begin and end (exclusive), if they fill a window of `size` words; else nothing."""
    space = np.concatenate([[True], plain == 32, [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    return (starts, ends) if len(starts) >= size else (starts[:0], ends[:0])


def _required(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks, from and up to, that every copy of these spans has; none if not from < up to."""
    bounds = np.append(0, cuts)
    return np.searchsorted(bounds, starts + _HEAD), np.searchsorted(bounds, ends - _TAIL, "right") - 1


_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def _power_table(odd: int, n: int) -> np.ndarray:
    """Powers of an odd number, and of its inverse, below n at least."""
    if odd not in _powers or _powers[odd].shape[1] < n:
        table = np.empty((2, n + n // 4), np.uint64)
        for k, x in enumerate((odd, pow(odd, -1, 1 << 64))):
            table[k, 0], table[k, 1:] = 1, x
        _powers[odd] = np.cumprod(table, axis=1, dtype=np.uint64)
    return _powers[odd]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def window_hashes(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the words of each window of `size` words, by polynomials of bytes, then of words."""
    p = _power_table(_ODD[0], len(plain) + 1)
    total = np.append(np.uint64(0), np.cumsum((plain.astype(np.uint64) + np.uint64(1)) * p[0, : len(plain)], dtype=np.uint64))
    word = _mixed((total[ends] - total[starts]) * p[1, starts])
    n = len(word) - size + 1
    out = []
    for odd in _ODD[1:]:
        p = _power_table(odd, len(word) + 1)
        total = np.append(np.uint64(0), np.cumsum(word * p[0, : len(word)], dtype=np.uint64))
        out.append(_mixed((total[size:] - total[:n]) * p[1, :n]).view(np.int64))
    return out


def chunk_rows(ids: list, texts: list[bytes], around: int = 15, min_words: int | None = None) -> tuple[list[np.ndarray], list]:
    """(digest, start, end, words) columns of all chunks, and each chunk's document. Offsets are bytes.

    With min_words, the columns are (digest, number of the chunk in its text, reach): if so many chunks from this one on
    are repeated, some window may be. A row numbered -2 is added for a text with a window that need not share any chunk.
    """
    digests: list[int] = []
    docs: list = []
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3 if min_words is None else 2)]
    for key, raw in zip(ids, texts, strict=True):
        if not raw:
            continue
        plain, at, first = _plain(raw)
        e = cut_points(plain, around)
        s = np.append(0, e[:-1])
        text = plain.tobytes()
        digests += [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        if min_words is None:
            new = (at[s], at[e], np.add.reduceat(first, at[s], dtype=np.int64))
        else:
            number, reach = np.arange(len(e)), np.full(len(e), _NEVER)
            starts, ends = _windows(plain, min_words + 1)
            lo, hi = _required(starts[: max(0, len(starts) - min_words)], ends[min_words:], e)
            some = np.flatnonzero(lo < hi)
            some = some[np.diff(lo[some], prepend=-1) > 0]  # both ascend, so the first window from a chunk on needs the fewest
            reach[lo[some]] = hi[some] - lo[some]
            if (lo >= hi).any():
                number, reach = np.append(number, -2), np.append(reach, 0)
                digests.append(0)
            new = (number, reach)
        for column, x in zip(columns, new, strict=True):
            column.append(x)
        docs += [key] * len(new[0])
    return [np.array(digests, np.uint64).view(np.int64), *map(np.concatenate, columns)], docs


def window_rows(ids: list, texts: list[bytes], runs: list, around: int = 15, min_words: int = 50) -> tuple[list[np.ndarray], list]:
    """(hash, check, number) columns of the windows that may be repeated, and each one's document. runs: each text's (first, last) repeated chunks."""
    docs: list = []
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for key, raw, spans in zip(ids, texts, runs, strict=True):
        if not raw:
            continue
        plain, _, _ = _plain(raw)
        starts, ends = _windows(plain, min_words + 1)
        if not len(starts):
            continue
        cuts = cut_points(plain, around)
        lo, hi = _required(starts[: len(starts) - min_words], ends[min_words:], cuts)
        other = np.ones(len(cuts), np.int64)
        for r in spans:
            other[max(0, r["first"]) : r["last"] + 1] = 0
        before = np.append(0, np.cumsum(other))
        may = np.flatnonzero((lo >= hi) | (before[np.maximum(lo, hi)] == before[lo]))
        for column, x in zip(columns, (*window_hashes(plain, starts, ends, min_words + 1), np.arange(len(lo))), strict=True):
            column.append(x[may])
        docs += [key] * len(may)
    return list(map(np.concatenate, columns)), docs


def passage_rows(ids: list, texts: list[bytes], runs: list, min_words: int = 50) -> list[list]:
    """doc_id, start, end, words, first_doc_id of runs of windows, given by the numbers of the first and the last one."""
    out: list[list] = [[], [], [], [], []]
    for key, raw, spans in zip(ids, texts, runs, strict=True):
        space = np.concatenate([[True], _BLANK[np.frombuffer(raw, np.uint8)], [True]])
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        for r in spans:
            last = r["last"] + min_words
            if last < len(ends):  # else it is of another text with this id
                for column, x in zip(out, (key, int(starts[r["first"]]), int(ends[last]), last - r["first"] + 1, r["low"]), strict=True):
                    column.append(x)
    return out


def _held_by_several(table: DataFrame, *key: str) -> DataFrame:
    """key and low, the smallest doc_id that has it, of the keys that several documents have; written, so that Spark can split one that a third of the rows have."""
    found = table.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return materialise(found.select(*key, "low"), "repeated")


@small_batches
def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, around: int = 15, shares: int = 3) -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), words, first_doc_id and is_first for every repeated passage of over min_words.

    Occurrences in one document alone don't count. Every window of min_words + 1 words of a passage is held by several
    documents, and first_doc_id is the smallest id that holds each of them; where it changes from window to window a
    passage ends and the next begins, so they can overlap. is_first says that it is this document. Each window is in a
    passage with is_first in one document. A null or empty text has no passages; rows with a null id are left out; an id
    stands for one text, and of its repeated rows one counts; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession

    def cut(batches):
        for b in sliced(batches):
            (digest, number, reach), owner = chunk_rows(b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()], around, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(owner, pa.int64()), pa.array(number.astype(np.int32)), pa.array(reach.astype(np.int32))], names=["digest", "doc_id", "number", "reach"])

    def look(batches):
        for b in sliced(batches):
            (h, check, number), owner = window_rows(b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()], b.column(2).to_pylist(), around, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), pa.array(owner, pa.int64()), pa.array(number.astype(np.int32))], names=["hash", "check", "doc_id", "number"])

    def place(batches):
        for b in sliced(batches):
            rows = passage_rows(b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()], b.column(2).to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "end", "words", "first_doc_id"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("doc_id is not null")
    by = W.partitionBy("doc_id").orderBy("number")

    def with_text(runs: DataFrame) -> DataFrame:
        return base.join(runs.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "runs")  # texts are not sorted

    apart = F.coalesce(F.col("number") - F.lag("number").over(by) > 1, F.lit(True))

    table = materialise(base.mapInArrow(cut, "digest long, doc_id long, number int, reach int"), "chunks")
    chunks = table.filter("number >= 0")
    repeated = _held_by_several(chunks, "digest")
    release(spark)
    hit = chunks.join(repeated, "digest").select("doc_id", "number", "reach").unionByName(table.filter("number < 0").select("doc_id", "number", "reach"))
    runs = hit.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.min(F.col("number") + F.col("reach")).alias("least")).filter("least <= last + 1")
    runs = materialise(runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    forget(table), forget(repeated), release(spark)

    windows = materialise(with_text(runs).mapInArrow(look, "hash long, check long, doc_id long, number int"), "windows")
    forget(runs), release(spark)
    # windows are matched a share of the hashes at a time, so that not all of them are in the shuffle at once
    parts = []
    for k in range(shares):
        some = windows.filter(F.pmod("hash", F.lit(shares)) == k)
        held = _held_by_several(some, "hash", "check")
        release(spark)
        parts.append(materialise(some.join(held, ["hash", "check"]).select("doc_id", "number", "low"), "hit"))
        forget(held), release(spark)
    forget(windows)
    hit = reduce(DataFrame.unionByName, parts)
    new = apart | (F.col("low") != F.lag("low").over(by))
    same = hit.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    same = same.groupBy("doc_id", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.min("low").alias("low"))
    same = materialise(same.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "low")).alias("runs")), "same")
    for part in parts:
        forget(part)
    release(spark)
    found = with_text(same).mapInArrow(place, "doc_id long, start long, end long, words long, first_doc_id long").distinct()
    return found.withColumn("is_first", F.col("doc_id") == F.col("first_doc_id"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns and rows, with repeated passages cut out of the texts of all but the first document; each word cut stays in an earlier one.

    Null and empty texts and rows with a null id stay as they are; repeated rows are cut alike; an empty table gives no rows.
    """
    key, spans = unused(docs.columns, "id", "cut")
    gone = repeated_passages(docs, id_col, text_col, **options).filter("not is_first").groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))

    def cleaned(t, cut):
        if t is None or cut is None:
            return t
        raw, parts, at = t.encode(), [], 0
        for s in cut:
            parts.append(raw[at : s["start"]])
            at = max(at, s["end"])
        return b"".join([*parts, raw[at:]]).decode()

    @F.pandas_udf("string")
    def clean(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([cleaned(t, c) for k in in_slices(texts) for t, c in zip(texts[k], cuts[k], strict=True)], dtype=object)

    joined = docs.join(gone, docs[id_col] == F.col(key), "left")
    return joined.withColumn(text_col, clean(F.col(text_col).cast("string"), F.col(spans))).select(*docs.columns)
