"""Benchmark decontamination: latent semantic retrieval, then longest-common-subsequence and answer checks.

Documents are cut into passages of 32 words. Words hash into `features` columns; passages weigh them by TF-IDF over the
whole corpus. A randomised SVD in one pass (each task adds its passages' share of A'A Omega as fixed-point integers, so
the sum is exact and does not depend on task order) gives `rank` latent dimensions. Every window of 16 or 32 words is
compared by cosine with the windows of the benchmark items, a stated query set; windows near an item whose weighted
words cover enough of it are checked by the longest common subsequence of words, of the whole item and of its answer
(its last part), so reworded passages are found and chance ones dropped. The cosine and the cover are low enough that
nearly all that the checks would accept is proposed; what they miss is measured in the tests and the README.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import BLOCK, PARTIAL, drop_scratch, forget, get_file, id_and_text, materialise, partial_blocks, put_file, scratch, sliced, small_batches, sum_blocks, summed, summed_by_key, unused

_SCALE = 1 << 16
_SEG, _SMALL, _LARGE = 8, 16, 32
_TABLE = 4096
_ENOUGH = 1000  # the cover that a window needs, in the whole numbers that bound it from above
_GROUP = 8  # items whose cover is bounded together first
_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?\"'()[]{}")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_ids(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and each text's number of words.

    texts: strings, or an Arrow array whose nulls are empty. Words end at blanks; marks at their ends don't count. The
    hash is a polynomial in the word's bytes, worked out for all words of a block at once.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
    word = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)  # before these bytes a word can't go on
    fresh[offsets] = True
    fresh[1:] |= ~word
    starts = np.flatnonzero(word & fresh[:-1])
    after = fresh[1:].copy()
    after[:-1] = ~word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    lens = np.diff(np.searchsorted(starts, offsets))
    while (m := (ends > starts) & _STRIP[data[ends - 1]]).any():
        ends = ends - m
    while (m := (ends > starts) & _STRIP[data[np.minimum(starts, len(data) - 1)]]).any():
        starts = starts + m
    out = np.zeros(len(starts), np.uint32)
    for lo in range(0, len(starts), BLOCK):
        s, e = starts[lo : lo + BLOCK], ends[lo : lo + BLOCK]
        part = data[s[0] : e[-1]]
        room = np.diff(s - s[0], append=len(part))
        at = np.arange(len(part)) - np.repeat(s - s[0], room)
        power = np.cumprod(np.append(np.uint64(1), np.full(max(room.max(), 1), 0x9E3779B97F4A7C15, np.uint64)))
        value = (part.astype(np.uint64) + np.uint64(1)) * power[at]
        value[at >= np.repeat(e - s, room)] = 0
        h = np.zeros(len(s), np.uint64)
        some = np.flatnonzero(room > 0)
        h[some] = np.add.reduceat(value, (s - s[0])[some])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[lo : lo + BLOCK] = (h >> np.uint64(32)).astype(np.uint32)
    return out, lens


def cuts(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of `size` words begin, restarting in every document, and each piece's document."""
    n = -(-lens // size)
    doc = np.repeat(np.arange(len(lens)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(lens) - lens, n) + within * size, doc


def in_pieces(col: np.ndarray, lens: np.ndarray, size: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of a batch's words as rows of `size` words, documents filled up with `none`; each row's start and document."""
    starts, doc = cuts(lens, size)
    at = starts[:, None] + np.arange(size)
    inside = at < np.cumsum(lens)[doc, None]
    return np.where(inside, col[np.where(inside, at, 0)], none).astype(np.int32), starts, doc


def gram_share(z: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    """Adds these passages' share of A'A Omega to z; the last row of table and of z stands for no word."""
    for lo in range(0, len(rows), 8192):
        part = rows[lo : lo + 8192]
        y = np.vstack([summed(table, part), np.zeros((1, table.shape[1]), table.dtype)])
        col = part.ravel().astype(np.uint16)
        order = np.argsort(col, kind="stable")
        keys, sums = summed_by_key(y, order // rows.shape[1], col[order].astype(np.int64))
        z[keys] += sums


def places(a: list[int]) -> dict[int, int]:
    """Where each word of a stands, as bits."""
    at: dict[int, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    return at


def lcs(a: list[int], b: list[int], least: float = 0, at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 if it is under `least`.

    at: places(a), where many b are compared with one a. If fewer than `least` words of a are in b in any order, nothing
    is worked out; words of b that a has not change nothing.
    """
    at = places(a) if at is None else at
    if least > 0 and sum(at[t].bit_count() for t in at.keys() & b) < least:
        return 0
    s = full = (1 << len(a)) - 1
    for t in b:
        if t in at:
            u = s & at[t]
            s = (s + u | s - u) & full
    n = len(a) - s.bit_count()
    return n if n >= least else 0


def alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which `size` neighbours have many columns in common: halves along the direction in which rows differ most, again and again."""

    def halves(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= size:
            return [rows]
        y = x[rows] - x[rows].mean(0)
        v = y[np.argmax(np.einsum("ij,ij->i", y, y))]
        for _ in range(8):
            v = y.T @ (y @ v)
            v = v / max(np.linalg.norm(v), 1e-9)
        rows = rows[np.argsort(y @ v, kind="stable")]
        cut = -(-len(rows) // size) // 2 * size
        return halves(rows[:cut]) + halves(rows[cut:])

    return np.concatenate(halves(np.arange(len(x))))


def in_groups(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds (item, word) of items in groups of like ones: by word the greatest in each group, by word and group those of its items, and the items in that order."""
    if not len(bound):
        return np.zeros((bound.shape[1], 0), np.uint16), np.zeros((0, _GROUP), np.uint16), np.zeros(0, np.int64)
    has = bound[:, :-1] > 0
    order = alike(has[:, np.argsort(-has.sum(0), kind="stable")[:512]].astype(np.float32), _GROUP)
    rows = np.vstack([bound[order], np.zeros((-len(order) % _GROUP, bound.shape[1]), np.uint16)])
    each = np.ascontiguousarray(rows.T).reshape(bound.shape[1], -1, _GROUP)
    return np.ascontiguousarray(each.max(2)), each.reshape(-1, _GROUP), order


_held: dict = {}


class Benchmark:
    """The items as queries: their windows in latent space, their weighted words and their answers.

    A window covers an item if the weights of its words for the item come to `coverage` of the item's own, or as much of it as a window can hold.
    """

    def __init__(self, items: list[tuple[int, str]], project: np.ndarray, idf: np.ndarray, answers: dict | None = None, coverage: float = 0.25):
        f = len(idf)
        self.ids, self.words, self.answers = [], [], []
        small, large = ([], []), ([], [])
        for key, text in items:
            w, _ = word_ids([text or ""])
            if not len(w) or key is None:
                continue
            j = len(self.ids)
            self.ids.append(key)
            self.words.append(w.tolist())
            answer = word_ids([answers[key]])[0].tolist() if answers and answers.get(key) else w[-max(3, len(w) // 4) :].tolist()
            self.answers.append(answer)
            v = project[w % f]
            spans = [(0, len(w))] if len(w) <= _LARGE else [*((o, o + _LARGE) for o in range(0, len(w) - _LARGE + 1, _SEG)), (len(w) - _LARGE, len(w))]
            vectors, of = large if len(w) > 24 else small
            for lo, hi in spans:
                vectors.append(v[lo:hi].sum(0))
                of.append(j)
        rank = project.shape[1]
        self.small, self.large = ((np.array([x / max(np.linalg.norm(x), 1e-9) for x in v], np.float32).reshape(-1, rank), np.array(j, np.int64)) for v, j in (small, large))
        self.weights = np.zeros((len(self.ids), _TABLE + 1), np.float32)  # the last column stands for no word
        self.full = np.zeros(len(self.ids), np.float32)
        self.share = np.array([min(1.0, _LARGE / len(w)) for w in self.words], np.float32)
        for j, w in enumerate(self.words):
            w = np.array(w, np.uint32)
            self.weights[j, w % _TABLE] = idf[w % f]
            self.full[j] = idf[w % f].sum()
        self.places = [(places(w), places(a)) for w, a in zip(self.words, self.answers, strict=True)]
        self.need = coverage * self.full * self.share
        part = np.divide(self.weights, self.need[:, None], out=np.full_like(self.weights, 1), where=self.need[:, None] > 0)
        bound = np.ceil(np.minimum(part * 1.001, 1) * _ENOUGH).astype(np.uint16)  # 32 words come to 32,000 at most; rounding of floats stays below the thousandth
        bound[:, -1] = 0
        self.small, self.large = ((v, j, np.flatnonzero(np.diff(j, prepend=-1)), in_groups(bound[np.unique(j)])) for v, j in (self.small, self.large))

    def covered(self, words: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of these pairs of a window's words and an item are covered."""
        return self.weights.ravel().take(words + (items * (_TABLE + 1))[:, None]).sum(1) >= self.need[items]


def cover_bounds(bound: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """An upper bound of what each segment's words cover of each item or group of items, in whole numbers of which _ENOUGH are needed."""
    out = np.empty((len(segments), bound.shape[1]), np.uint16)
    for lo in range(0, len(segments), 512):
        part = segments[lo : lo + 512]
        total = bound.take(part[:, 0], axis=0, mode="clip")
        for k in range(1, part.shape[1]):
            total += bound.take(part[:, k], axis=0, mode="clip")
        out[lo : lo + 512] = total
    return out


def _joined(part: np.ndarray, d: np.ndarray, n: int, step: int) -> np.ndarray:
    """The first n rows, each with the row that comes `step` later added to it if that is of the same document."""
    out = part[:n].copy()
    reach = max(0, min(n, len(part) - step))
    out[:reach] += part[step : step + reach] * (d[step : step + reach] == d[:reach])[:, None]
    return out


def _near(ids, lens, project, bench, cosine):
    """(document, item, first word, last word, cosine) of the windows that are near an item and cover enough of it.

    The cover is bounded first, by segment for groups of like items, then by item for the groups that this leaves open. The
    latent search gives the cosines of all windows and items whose cover is still open, and words are looked up for near ones.
    """

    def words_of(first, last, size):
        words = column[first[:, None] + np.arange(size)]
        words[np.arange(size) >= (last - first)[:, None]] = _TABLE
        return words

    f = len(project) - 1
    rows, starts, doc = in_pieces((ids % f).astype(np.int32), lens, _SEG, f)
    segments = in_pieces((ids % _TABLE).astype(np.int32), lens, _SEG, _TABLE)[0]
    ends = np.cumsum(lens)
    column = np.append((ids % _TABLE).astype(np.int16), np.full(_LARGE, _TABLE, np.int16))
    found = []
    for lo in range(0, len(rows), 2048):
        d = doc[lo : lo + 2051]
        n = min(2048, len(rows) - lo)
        for (vectors, item, firsts, (coarse, each, order)), at, size in ((bench.small, np.arange(lo, lo + n), _SMALL), (bench.large, np.arange(lo, lo + n, 2), _LARGE)):
            if not len(item):
                continue
            most = _joined(cover_bounds(coarse, segments[lo : lo + 2051]), d, len(d), 1)
            most = most[:n] if size == _SMALL else _joined(most, d, n, 2)[::2]
            w, group = np.divmod(np.flatnonzero(most.ravel() >= _ENOUGH), coarse.shape[1])
            first = starts[at[w]]
            last = np.minimum(first + size, ends[doc[at[w]]])
            left = []
            for k in range(0, len(w), 1 << 13):
                gk = group[k : k + (1 << 13)]
                words = words_of(first[k : k + (1 << 13)], last[k : k + (1 << 13)], size)
                total = np.zeros((len(gk), _GROUP), np.uint16)
                for t in range(size):
                    total += each.take(words[:, t].astype(np.int64) * coarse.shape[1] + gk, axis=0)
                r, t = np.nonzero(total >= _ENOUGH)
                left.append((w[k + r], order[gk[r] * _GROUP + t]))
            if not left:
                continue
            w, m = (np.concatenate(x) for x in zip(*left, strict=True))
            count = np.diff(firsts, append=len(item))[m]
            q = np.arange(count.sum()) + np.repeat(firsts[m] - (np.cumsum(count) - count), count)
            w = np.repeat(w, count)
            s = np.zeros((len(d), project.shape[1]), project.dtype)
            some = np.unique(at[w][:, None] - lo + np.arange(size // _SEG))  # the segments of windows that are left
            some = some[some < len(d)]
            s[some] = summed(project, rows[lo + some])
            window = _joined(s, d, len(d), 1)
            window = window[:n] if size == _SMALL else _joined(window, d, n, 2)[::2]
            window = window / np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)[:, None]
            c = np.concatenate([np.einsum("ij,ij->i", window[w[k : k + BLOCK]], vectors[q[k : k + BLOCK]]) for k in range(0, max(len(w), 1), BLOCK)])
            near = np.flatnonzero(c >= cosine)
            w, q, c = w[near], q[near], c[near]
            j = item[q]
            new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (j[1:] != j[:-1])) if len(w) else [])
            best = np.maximum.reduceat(c, new) if len(new) else np.zeros(0)
            w, j = w[new], j[new].astype(np.int32)
            first = starts[at[w]]
            last = np.minimum(first + size, ends[doc[at[w]]])
            for k in range(0, len(w), 1 << 13):
                wk, jk, a, b = (x[k : k + (1 << 13)] for x in (at[w], j, first, last))
                ok = np.flatnonzero(bench.covered(words_of(a, b, size), jk))
                found += zip(doc[wk[ok]].tolist(), jk[ok].tolist(), a[ok].tolist(), b[ok].tolist(), best[k + ok].tolist(), strict=True)
    return found


@small_batches
def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    features: int = 16_384, rank: int = 64, cosine: float = 0.3, coverage: float = 0.25, share: float = 0.6, answer_share: float = 0.6, block: int = 2000,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs, lcs_share, answer_share for every document that holds an item.

    A document holds an item if around some window that the latent search proposes (of 16 words for items of up to 24, else 32, and as many words as the
    item has on either side) the common subsequence reaches `share` of the item's words and `answer_share` of its answer's (answer_col; by default
    the item's last quarter, three words at least). One row for each pair, the best window's. Null and empty texts hold
    nothing and are held by nothing; a null id stays null; rows of one id are looked at each and give one row an item;
    an empty table gives no rows; other columns are not read. Items of one text (and answer) are compared as one, and each
    gets its rows. Items are compared in blocks of `block` texts, which tasks read in turn, so that one pass over the
    documents serves any number of them.
    cosine and coverage choose the windows that are checked: lower ones cost more checks and miss less.
    """
    spark = docs.sparkSession

    def spool(batches):
        df, n = np.zeros(features, np.int64), 0
        for b in sliced(batches, rows=2000, size=8 << 20):
            ids, lens = word_ids(b.column(1))
            starts, _ = cuts(lens, _LARGE)
            if len(ids):
                passage = np.zeros(len(ids), np.int32)
                passage[starts[1:]] = 1
                col = (ids % features).astype(np.uint16)
                order = np.argsort(col, kind="stable")
                passage, col = np.cumsum(passage, dtype=np.int32)[order], col[order]
                once = np.append(True, (passage[1:] != passage[:-1]) | (col[1:] != col[:-1]))  # a word counts once a passage
                df += np.bincount(col[once], minlength=features)
                n += len(starts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]) * 4, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(lens), [None, offsets.buffers()[1], pa.py_buffer(ids)]), pa.array([True] * len(lens))], names=["doc_id", "ids", "is_doc"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary()), pa.array([False])], names=["doc_id", "ids", "is_doc"])

    table = materialise(id_and_text(docs, id_col, text_col).mapInArrow(spool, "doc_id long, ids binary, is_doc boolean"), "words")
    counts = table.filter("not is_doc").select("doc_id", "ids")

    def add_counts(batches):
        total = np.zeros(features + 1, np.int64)
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[0] += n
                total[1:] += np.frombuffer(raw, "<i8")
        yield from partial_blocks(total, features + 1)

    total = sum_blocks(counts.mapInArrow(add_counts, PARTIAL), (features + 1,), features + 1)
    idf = np.log((total[0] + 1) / (total[1:] + 1)).astype(np.float32)
    omega = np.random.default_rng(11).normal(size=(features, rank)).astype(np.float32)
    weighted = spark.sparkContext.broadcast(np.vstack([omega * idf[:, None], np.zeros((1, rank), np.float32)]))

    def documents(b):
        raw = b.column(0)
        at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] // 4
        data = raw.buffers()[2]
        ids = np.frombuffer(data, np.uint32, at[-1] - at[0], at[0] * 4) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint32)
        return ids, np.diff(at).astype(np.int64)

    def gram(batches):
        w, z = weighted.value, np.zeros((features + 1, rank), np.float32)
        for b in sliced(batches, 0, 2000, 8 << 20):
            ids, lens = documents(b)
            if len(ids):
                gram_share(z, w, in_pieces((ids % features).astype(np.int32), lens, _LARGE, features)[0])
        yield from partial_blocks(np.rint(z[:-1].astype(np.float64) * _SCALE).astype(np.int64), 256)

    words = table.filter("is_doc")
    z = sum_blocks(words.select("ids").mapInArrow(gram, PARTIAL), (features, rank), 256) / _SCALE * idf[:, None]
    g = omega.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values = np.maximum(values, max(values.max(), 1e-9) * 1e-9)
    u, sigma, _ = np.linalg.svd(z @ (vectors / np.sqrt(values)), full_matrices=False)
    project = (u / np.maximum(sigma, max(sigma.max(), 1e-9) * 1e-6) * sigma.max() * idf[:, None]).astype(np.float32)
    project = np.vstack([project, np.zeros((1, rank), np.float32)])

    columns = [F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")] + ([F.col(answer_col).cast("string").alias("answer")] if answer_col else [])
    folder, blocks, held = scratch(spark, "items"), 0, []
    contents = ["text", "answer"] if answer_col else ["text"]
    for key, *content in benchmark.select(*columns).filter("id is not null and text is not null").orderBy(*contents).toLocalIterator():
        if held and held[-1][1:] == tuple(content):
            held[-1][0].append(key)
            continue
        if len(held) == block:
            put_file(folder, f"{blocks:08d}", pickle.dumps(held))
            blocks, held = blocks + 1, []
        held.append(([key], *content))
    if held or not blocks:
        put_file(folder, f"{blocks:08d}", pickle.dumps(held))
        blocks += 1
    shared = spark.sparkContext.broadcast((project, idf))

    def leaks(keys, ids, lens, bench, project) -> list[tuple]:
        first = np.cumsum(lens) - lens
        best: dict = {}
        for d, j, lo, hi, c in _near(ids, lens, project, bench, cosine):
            item = bench.words[j]
            region = ids[max(lo - len(item), first[d]) : min(hi + len(item), first[d] + lens[d])].tolist()
            in_item, in_answer = bench.places[j]
            n = lcs(item, region, share * len(item), in_item)
            if n < share * len(item):
                continue
            a = lcs(bench.answers[j], region, at=in_answer) / len(bench.answers[j])
            if a >= answer_share:
                best[d, j] = max(best.get((d, j), (0, 0, 0.0)), (n, a, c))
        return [(keys[d], item, c, n, n / len(bench.words[j]), a) for (d, j), (n, a, c) in best.items() for item in bench.ids[j]]

    def search(batches):
        project, idf = shared.value
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())

        def compared(parts):
            for k in range(blocks):
                if _held.get("uri") != (uri := f"{folder}/{k:08d}"):  # a worker keeps the last block, which is the only one of most benchmarks
                    rows = [(tuple(ids), *content) for ids, *content in pickle.loads(get_file(uri))]
                    _held.update(uri=uri, bench=Benchmark([r[:2] for r in rows], project, idf, {r[0]: r[2] for r in rows} if answer_col else None, coverage))
                for keys, ids, lens in parts:
                    if rows := leaks(keys, ids, lens, _held["bench"], project):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "lcs_share", "answer_share"])

        parts, size = [], 0
        for b in sliced(batches, 0, 2000, 4 << 20):
            parts.append((b.column(1).to_pylist(), *documents(b)))
            size += parts[-1][1].nbytes
            if blocks == 1 or size >= 32 << 20:
                yield from compared(parts)
                parts, size = [], 0
        yield from compared(parts)

    out = words.select("ids", "doc_id").mapInArrow(search, "doc_id long, item_id long, cosine double, lcs long, lcs_share double, answer_share double")
    found = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer_share", "cosine", "lcs_share")).alias("b")).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.lcs_share", "b.answer_share")
    found = materialise(found, "leaks")
    forget(table)
    drop_scratch(spark, folder)
    return found


def without_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    Rows with a null id and with null or empty texts stay; of an id with several texts all go if one holds an item; an
    empty table gives no rows, and an empty benchmark drops none.
    """
    found = find_contamination(docs, benchmark, id_col, text_col, **options)
    (gone,) = unused(docs.columns, "gone")
    return docs.join(found.select(F.col("doc_id").alias(gone)).distinct(), docs[id_col] == F.col(gone), "left_anti")
