"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word and punctuation run hashes to one of `buckets` rows; each row has a fixed sparse ternary index vector. A
row's context vector is the sum of the index vectors that occur within two tokens of it, over the whole corpus: integer
partial tables of a fixed shape are added, so the sums are exact and independent of task order. A document is the mean
and spread of its tokens' context vectors, its length, the norm of its mean index vector (which repetition raises) and
the share of tokens whose vector is that of the token before.
A two-layer numpy network scores it; one temperature, fitted on labelled rows the network did not see, calibrates the
probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import PARTIAL, id_and_text, in_slices, partial_blocks, pieces_of, sliced, small_batches, sole, sum_blocks, summed_by_key, texts_of

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BLANK = re.compile(r"\s")  # in no token
_PART = 1 << 17  # tokens of a text that are worked on at once
_BLOCK = 256


class _Buckets(dict):
    """token -> bucket; a cache, emptied when full."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        self[token] = b = xxhash.xxh32_intdigest(token) % self.n
        return b


_caches: dict[int, _Buckets] = {}


def bucket_ids(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' token buckets in a row, and the number of tokens of each text."""
    memo = _caches.setdefault(buckets, _Buckets(buckets))
    sole(memo)
    words: list[str] = []
    parts, lens = [], []

    def settle():
        if len(memo) > 400_000:
            memo.clear()
        parts.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        words.clear()

    for t in texts:
        n = 0
        for piece in pieces_of(t, _BLANK):
            found = _TOKEN.findall(piece)
            n += len(found)
            words += found
            if len(words) > 500_000:
                settle()
        lens.append(n)
    settle()
    return parts[0] if len(parts) == 1 else np.concatenate(parts), np.array(lens, np.int64)


@lru_cache(2)
def index_vectors(buckets: int, dims: int, nonzero: int = 4, seed: int = 20) -> np.ndarray:
    """Sparse ternary vectors from a seed; one more row of zeros stands between documents."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets + 1, dims), np.int16)
    at = np.argsort(rng.random((buckets, dims)), 1)[:, :nonzero]
    np.put_along_axis(out[:-1], at, rng.choice(np.array([-1, 1], np.int16), (buckets, nonzero)), 1)
    return out


def context_sums(ids: np.ndarray, lens: np.ndarray, index: np.ndarray, reach: int = 2) -> np.ndarray:
    """For each bucket, the sum of the index vectors within `reach` tokens, inside documents. A long document is summed part by part, each with `reach` tokens of its neighbours."""
    out, ends = np.zeros((len(index) - 1, index.shape[1]), np.int64), np.cumsum(lens)
    long = lens > _PART
    if long.any():
        for a, e in zip((ends - lens)[long].tolist(), ends[long].tolist(), strict=True):
            for lo in range(a, e, _PART):
                first, last = max(a, lo - reach), min(e, lo + _PART + reach)
                _add_contexts(out, ids[first:last], np.array([last - first]), index, reach, (lo - first, last - min(e, lo + _PART)))
        ids, lens = ids[np.repeat(~long, lens)], lens[~long]
    _add_contexts(out, ids, lens, index, reach, (0, 0))
    return out


def _add_contexts(out: np.ndarray, ids: np.ndarray, lens: np.ndarray, index: np.ndarray, reach: int, margin: tuple[int, int]) -> None:
    """Adds the context sums of tokens; the first and last ones that `margin` counts are neighbours only."""
    gap = len(index) - 1
    row = np.full(len(ids) + reach * (len(lens) + 1), gap, np.int64)
    row[np.arange(len(ids)) + reach * (1 + np.repeat(np.arange(len(lens)), lens))] = ids
    v = index[row].astype(np.float32)
    near = np.zeros((len(row) + 1, v.shape[1]), np.float32)  # small whole numbers, so float sums are exact
    for k in range(1, reach + 1):
        near[k:-1] += v[:-k]
        near[: -k - 1] += v[k:]
    row[: reach + margin[0]] = row[len(row) - reach - margin[1] :] = gap
    order = np.argsort(row.astype(np.uint16) if gap < 1 << 16 else row, kind="stable")
    keys, sums = summed_by_key(near, order, row[order])
    out[keys[keys < gap]] += sums[keys < gap].astype(np.int64)


@dataclass
class QualityModel:
    buckets: int = 16_384
    dims: int = 32
    hidden: int = 32
    epochs: int = 40
    max_labelled: int = 20_000  # the network is fitted on at most so many labelled rows
    seed: int = 7
    vectors: np.ndarray = field(default=None, repr=False)
    weights: list = field(default=None, repr=False)
    temperature: float = 1.0

    def features(self, texts: list[str]) -> np.ndarray:
        """One row for each text; a text without tokens is a row of zeros."""
        ids, lens = bucket_ids(texts, self.buckets)
        out = np.zeros((len(texts), 2 * self.dims + 3), np.float32)
        some = np.flatnonzero(lens)
        if not len(some):
            return out
        n = lens[some, None].astype(np.float32)
        starts = (np.cumsum(lens) - lens)[some]
        index = index_vectors(self.buckets, self.dims).astype(np.float32)
        mean, square, common = (np.empty((len(some), self.dims), np.float32) for _ in range(3))
        for k, (a, e) in enumerate(zip(starts.tolist(), (starts + lens[some]).tolist(), strict=True)):
            mean[k] = square[k] = common[k] = 0
            for lo in range(a, e, _PART):
                part = ids[lo : min(e, lo + _PART)]
                v = self.vectors[part]
                mean[k] += v.sum(0)
                square[k] += np.einsum("ij,ij->j", v, v)
                common[k] += index[part].sum(0)
        mean, common = mean / n, common / n
        spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
        again = np.append(ids[1:] == ids[:-1], False)
        again[starts[1:] - 1] = False
        again = np.add.reduceat(again, starts, dtype=np.int64)[:, None] / n
        out[some] = np.hstack([mean, spread, np.log1p(n), np.linalg.norm(common, axis=1, keepdims=True), again])
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -40, 40)))

    def fit_network(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on four fifths of the rows; the rest sets the temperature. Without rows all logits are 0."""
        if not len(x):
            self.weights = [np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32), np.zeros((x.shape[1], self.hidden)), np.zeros(self.hidden), np.zeros(self.hidden), 0.0]
            self.temperature = 1.0
            return
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        cut = len(x) - len(x) // 5
        train, held = order[:cut], order[cut:]
        mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), 0.0]
        m, v, t = [0.0] * 4, [0.0] * 4, 0
        z = (x - mean) / scale
        for _ in range(self.epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), 256):
                k = train[lo : lo + 256]
                h = np.tanh(z[k] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[k]) / len(k)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[k].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum()]
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights = [mean.astype(np.float32), scale.astype(np.float32), *p]
        if len(held):
            s = self.logits(x[held])
            grid = np.exp(np.linspace(-2, 3, 101))
            a = np.abs(s)
            right = (s > 0) == (y[held] > 0)
            loss = [np.mean(np.log1p(np.exp(-a / g)) + np.where(right, 0, a / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


@small_batches
def fit(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all documents; the network from at most model.max_labelled of the labelled rows given.

    labels has `id_col` and `quality` (0 or 1); rows with a null in either are left out and an id counts once. The rows
    kept are those with the smallest hash of their id. Without labelled rows every score is one half.
    """
    model = model or QualityModel()
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col)
    buckets, dims = model.buckets, model.dims

    def contexts(batches):
        total, index = np.zeros((buckets, dims), np.int64), index_vectors(buckets, dims)
        for b in sliced(batches, 0, size=1 << 20):  # a token takes 250 bytes and more on the way
            total += context_sums(*bucket_ids(texts_of(b, 0), buckets), index)
        yield from partial_blocks(total, _BLOCK)

    sums = sum_blocks(base.select("text").mapInArrow(contexts, PARTIAL), (buckets, dims), _BLOCK).astype(np.float64)
    v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    used = sums.any(1)
    v[used] -= v[used].mean(0) if used.any() else 0
    model.vectors = v.astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).na.drop()
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(model.max_labelled)
    )

    def featurise(batches):
        for b in sliced(batches):
            x = shared.value.features(texts_of(b, 1))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    rows = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(featurise, "quality int, x binary").toArrow()
    x = np.array([np.frombuffer(r, np.float32) for r in rows["x"].to_pylist()], np.float32).reshape(-1, 2 * dims + 3)
    y = np.array(rows["quality"].to_pylist(), np.float64)
    order = np.lexsort(np.vstack([x.T, y]))  # the order of rows does not depend on tasks
    model.fit_network(x[order], y[order])
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row, repeated rows each; a null text is an empty one; a null id stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(texts_of(b)).astype(np.float64))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: QualityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the labelled rows that are not held out and gives doc_id, held_out, score and predicted for every row."""
    learn = labels.filter(~is_held_out(id_col))
    scored = score(docs, fit(docs, learn, model, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: QualityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold.

    A null text is an empty one, and its row stays or goes by that score; repeated rows stay or go together; rows with a
    null id are scored like others; an empty table gives no rows. Without labelled rows all score one half.
    """
    model = fit(docs, labels.filter(~is_held_out(id_col)), model, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value.scores([t or "" for t in texts[k]]) for k in in_slices(texts)]))

    return docs.filter(quality_of(F.col(text_col).cast("string")) >= threshold)
