"""Target-distribution importance resampling: documents drawn by how much likelier the target text makes their features.

Features are the runs of 1 to n consecutive words. Each task keeps a trie of the words it meets: a node is a run, and
holds its count and the CRC-32 state of its bytes, so a longer run costs one step from the run before it. When a trie is
full, or the task ends, its counts are added to the totals of their buckets, whose number is a parameter, and the tries'
totals are added up. Gains follow from the totals of corpus and target; documents are then scored by walking tries whose
nodes have their bucket's gain. The draw adds Gumbel noise made from the id, and ranks by ranges.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import PARTIAL, materialise, partial_blocks, sliced, small_batches, sum_blocks
from twinsift.plans.numbering import number_rows

_PART = 1 << 20  # bytes of a text that are cut into words at once
_TABLE = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BLANK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_BLOCK = 1 << 16


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a part of it at a time; no word is cut. A null text has none."""
    text, lo = text or b"", 0
    while lo < len(text):
        end = _BLANK.search(text, lo + _PART)
        hi = end.start() if end else len(text)
        yield text[lo:hi].translate(_TABLE).split()
        lo = hi


class _Words(dict):
    """word -> its node."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        self[word] = node = self.trie.grow(zlib.crc32(word), b" " + word)
        return node


class _Runs(dict):
    """The node of a run and that of one more word, as one number -> the node of the longer run."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, step: int) -> int:
        t = self.trie
        self[step] = node = t.grow(zlib.crc32(t.tails[step & 0xFFFFFFFF], t.states[step >> 32]), b"")
        return node


class Trie:
    """Runs of words, to a depth of n."""

    def __init__(self, n: int, buckets: int, gains: np.ndarray | None = None, most_nodes: int = 300_000, most_bytes: int = 16 << 20):
        self.n, self.buckets, self.gains, self.most = n, buckets, gains, (most_nodes, most_bytes)
        self.clear()

    def clear(self) -> None:
        self.words, self.runs = _Words(self), _Runs(self)
        self.states: list[int] = []  # by node: the CRC of its run
        self.tails: list[bytes] = []  # by node of one word: what it adds to a longer run
        self.values: list[int] = []  # by node: its bucket's gain
        self.counts = np.zeros(0, np.int64)
        self.size = 0

    def grow(self, state: int, tail: bytes) -> int:
        self.states.append(state)
        self.tails.append(tail)
        self.size += len(tail)
        if self.gains is not None:
            self.values.append(self.gains[state % self.buckets])
        return len(self.states) - 1

    def full(self) -> bool:
        return len(self.states) > self.most[0] or self.size > self.most[1]

    def walk(self, words: list[bytes], before: list[bytes] = ()) -> list[list[int]]:
        """The nodes of the runs that end in `words`, by their length; `before` are the n - 1 words that come first."""
        single = list(map(self.words.__getitem__, [*before, *words]))
        out, runs = [single[len(before) :]], single
        for k in range(1, self.n):
            runs = list(map(self.runs.__getitem__, [a << 32 | b for a, b in zip(runs, single[k:])]))  # noqa: B905 - the last run has no word after it
            out.append(runs[max(0, len(before) - k) :])
        return out

    def tell(self, nodes: list[list[int]]) -> None:
        met = np.bincount(np.concatenate([np.array(x, np.int64) for x in nodes]), minlength=len(self.states))
        met[: len(self.counts)] += self.counts
        self.counts = met

    def pour(self, totals: np.ndarray) -> None:
        """Adds the counts to the totals of their buckets."""
        np.add.at(totals, np.array(self.states[: len(self.counts)], np.int64) % self.buckets, self.counts)


def _runs_of(text: bytes | None, trie: Trie, settle) -> Iterator[list[list[int]]]:
    """The nodes of a text's runs, part by part; `settle` is called before a full trie is emptied."""
    before: list[bytes] = []
    for words in words_of(text):
        if trie.full():
            settle()
            trie.clear()
        if words:
            yield trie.walk(words, before)
            before = [*before, *words][-(trie.n - 1) :] if trie.n > 1 else []


def bucket_totals(texts: DataFrame, n: int, buckets: int, most_nodes: int = 300_000) -> np.ndarray:
    """How many features of all texts (a table of one binary column) fall into each bucket."""

    def count(batches):
        totals, trie = np.zeros(buckets, np.int64), Trie(n, buckets, most_nodes=most_nodes)
        for b in sliced(batches, 0):
            for text in b.column(0).to_pylist():
                for nodes in _runs_of(text, trie, lambda: trie.pour(totals)):
                    trie.tell(nodes)
        trie.pour(totals)
        yield from partial_blocks(totals[:, None], _BLOCK)

    return sum_blocks(texts.mapInArrow(count, PARTIAL), (buckets, 1), _BLOCK)[:, 0]


def gains_of(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Each bucket's gain: a thousand times the log of its smoothed share in the target over that in the corpus, rounded down."""
    k, total, aim = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (total + k) / ((s + 1.0) * (aim + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise_of(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


@small_batches
def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank for every row of docs.

    weight is the mean gain of a row's features, rounded down (none: 0); score adds the noise of its id. Of the N rows
    with at least `least_words` words, the floor(percent * N / 100) highest scores are drawn, ties to the smaller id,
    and rank counts them from 1; it is null elsewhere. Null and empty texts have no features. Repeated rows are ranked
    each; a null id goes before others of its score. An empty table gives no rows, an empty target makes gains of the
    corpus alone. Other columns are not read.
    """
    corpus = bucket_totals(docs.select(F.col(text_col).cast("string").cast("binary")), n, buckets)
    aim = bucket_totals(target.select(F.col(target_col).cast("string").cast("binary")), n, buckets)
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(corpus, aim))

    def score(batches):
        trie = Trie(n, buckets, gains.value)
        for b in sliced(batches):
            features, words, sums = [], [], []
            for text in b.column(1).to_pylist():
                k = w = s = 0
                for nodes in _runs_of(text, trie, lambda: None):
                    w += len(nodes[0])
                    for runs in nodes:
                        k += len(runs)
                        s += sum(map(trie.values.__getitem__, runs))
                features.append(k)
                words.append(w)
                sums.append(s // k if k else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (features, words, sums))], names=["doc_id", "n_features", "n_words", "weight"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = base.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long").withColumn("score", F.col("weight") + noise_of(F.col("doc_id"), seed))
    # short rows come last; the row's number, written, parts rows of one id and score
    short = F.col("n_words") < least_words
    rows = materialise(rows.select("*", short.alias("short"), (-F.col("score")).alias("low"), F.monotonically_increasing_id().alias("row")), "scores")
    draw = rows.filter("not short").count() * percent // 100
    placed = number_rows(rows, ["short", "low", "doc_id", "row"], "place")
    return placed.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("place") <= draw, F.col("place")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, whose id is drawn by resample(); repeated rows of a drawn id all stay, a null id goes."""
    ids = resample(docs, target, id_col=id_col, **options).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("long") == F.col("__drawn"), "left_semi")


def oracle(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """DuckDB SQL for resample() of single words over documents, with benchmark as the target. CRC-32 is worked out byte by byte from a table made from its rule."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda table: f"list_filter(string_split_regex(translate(coalesce({table}.text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
    words AS (SELECT doc_id, unnest({words('documents')}) AS w FROM documents), aims AS (SELECT unnest({words('benchmark')}) AS w FROM benchmark),
    met AS (SELECT DISTINCT w FROM (SELECT w FROM words UNION ALL SELECT w FROM aims)),
    bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substring(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM met),
    placed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), CAST(4294967295 AS BIGINT)) % {buckets} AS k FROM bytes, crc),
    corpus AS (SELECT k, count(*) AS s FROM words JOIN placed USING (w) GROUP BY k), target AS (SELECT k, count(*) AS t FROM aims JOIN placed USING (w) GROUP BY k),
    sums AS (SELECT (SELECT count(*) FROM words) AS ss, (SELECT count(*) FROM aims) AS tt),
    gains AS (
      SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + {buckets}::DOUBLE) / ((s + 1.0::DOUBLE) * (tt + {buckets}::DOUBLE)))) AS BIGINT) AS gain FROM corpus LEFT JOIN target USING (k), sums
    ), weights AS (
      SELECT doc_id, CAST(count(gain) AS BIGINT) AS n_features, CAST(coalesce(floor(sum(gain) / count(gain)), 0) AS BIGINT) AS weight
      FROM documents LEFT JOIN (SELECT doc_id, gain FROM words JOIN placed USING (w) JOIN gains USING (k)) USING (doc_id) GROUP BY doc_id
    ), scored AS (
      SELECT *, n_features AS n_words, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights
    ), numbered AS (SELECT *, row_number() OVER (ORDER BY n_words < {least_words}, score DESC, doc_id) AS place FROM scored)
    SELECT doc_id, n_features, n_words, weight, score, CASE WHEN place <= (SELECT count(*) * {percent} // 100 FROM scored WHERE n_words >= {least_words}) THEN CAST(place AS BIGINT) END AS rank FROM numbered
    """
