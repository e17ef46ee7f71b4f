"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document is its set of word n-grams, hashed to 64 bits. Equal sets are one row of the incidence matrix. Rows are cut
into blocks that no linked pair straddles, by two bounds that follow from the sizes a and b of two linked sets (overlap
o >= s (a + b) / (1 + s) at similarity s): b lies in a's size class or the next, and the sets differ in at most
D = (1 - s) / (1 + s) (a + b) n-grams; so of D + 1 + spare ranges of the hash space, in each of which a set leaves a
signature, at least spare + 1 agree. Blocks are the components of agreeing signatures. Each row is first multiplied with
one pivot, the row that it shares most signatures with; rows that this links, directly or by others, need no comparison
with each other. What is left of a block is multiplied in tiles of rows, and tiles of one linked group are not multiplied
with each other, so the work in a group of near copies grows with its size. A tile is a file that is written once, and
tasks read the two tiles of each pair, so disk grows with the rows, however many pairs a block has. Overlap counts add up over blocks of columns,
and pairs whose count can no longer reach their size-derived bound are discarded after each. A tile pair gives a spanning
forest of its links, not all pairs. Links are exact; only the 64-bit hashes stand for the n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.llm._util import drop_scratch, forget, get_file, materialise, pieces_of, put_file, release, scratch, sliced, small_batches, sole, unused
from twinsift.llm.components import connected_components

_U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPARE, _SHARE = 2, 0.08  # ranges beyond D + 1: so many, and this share of D besides
_SLOTS = 1 << 20  # signatures that a task remembers


class _WordHash(dict):
    """word -> 64-bit hash; a cache, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    sole(_words)
    parts = []
    for piece in pieces_of(text or b"", _BLANK):
        if len(_words) > 200_000:
            _words.clear()
        words = piece.lower().split()
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    h = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out *= _U(0x9E3779B97F4A7C15)
        out += h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


class Bounds:
    """What the sizes of two sets say about their overlap, at a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]  # of the size classes

    def need(self, a, b):
        """The least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def size_class(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def ranges(self, label: int) -> tuple[int, int]:
        """How many ranges the hash space is cut into for pairs whose larger set is in this class, and the spare ones."""
        while len(self.lows) <= label + 1:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        most = self.lows[label + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        spare = _SPARE + int(differ * _SHARE)
        return differ + 1 + spare, spare

    def signatures(self, s: np.ndarray, common: np.ndarray) -> np.ndarray:
        """One 64-bit signature for each range that holds a hash not in `common`, under the set's class and the next.

        Of linked sets' ranges at least spare + 1 agree. A set in which more than `spare` ranges are blank (empty, or of
        common hashes alone) gives signatures of those too: where only blank ranges agree, both sets have that many. So
        the list of common hashes, which keeps shared lines from joining blocks, changes no link, whatever it holds.
        """
        if not len(s) or self.need(len(s), len(s) + 1) > len(s):
            return np.zeros(0, np.int64)  # too small to be linked with another set
        c = self.size_class(len(s))
        mixed = _mix(s ^ _U(0x5851F42D4C957F2D))
        at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
        rare = common[at] != s if len(common) else np.ones(len(s), bool)
        out = []
        for label in (c, c + 1):
            k, spare = self.ranges(label)
            at = ((s >> _U(32)) * _U(k)) >> _U(32)
            first = np.flatnonzero(np.diff(at, prepend=_U(2**63)))
            seg, sums = at[first], np.add.reduceat(mixed, first)
            told = np.add.reduceat(rare, first, dtype=np.int64) > 0
            if k - np.count_nonzero(told) <= spare:
                seg, sums = seg[told], sums[told]
            elif len(seg) < k:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), seg)
                seg, sums = np.concatenate([seg, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            out.append(_mix(sums + _mix(seg + _U(label << 40))))
        return np.concatenate(out).view(np.int64)


class Holders:
    """The last holder of each of a fixed number of signatures, so that a task tells a signature that it meets again by a link.

    A signature that is not remembered is passed on and takes its slot; one that is remembered gives a link to its
    holder, which has passed it on. So no agreement is lost, whatever the slots forget, and a signature that a third of
    the rows share leaves a task as a few rows. The number of slots is a power of two, two at least.
    """

    def __init__(self, slots: int = _SLOTS):
        self.held = np.arange(slots) ^ 1  # no signature of a slot
        self.holder = np.zeros(slots, np.int64)

    def meet(self, doc: int, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures to pass on, and the documents to link with."""
        at = signatures & (len(self.held) - 1)
        known = self.held[at] == signatures
        near, at, fresh = np.unique(self.holder[at[known]]), at[~known], signatures[~known]
        self.held[at] = fresh
        self.holder[at] = doc
        return fresh, near[near != doc]


def agreements(signs: DataFrame) -> DataFrame:
    """doc_id, low and n of signs(doc_id, signature): rows that share n signatures; all rows of a signature are joined by these.

    Rows are dealt by ranges of signature and id, so that a hot signature takes as many tasks as it needs, and sorted: a
    row goes with the first of its signature in its range. Where a signature goes on in the next range, the two ranges'
    ends are joined; they are two rows a task.
    """

    def run(batches):
        first = last = None  # signature and row
        low = None  # the first row of the signature that the last batch ended with
        for b in batches:
            if not b.num_rows:
                continue
            sign, doc = (c.to_numpy() for c in b.columns)
            starts = np.flatnonzero(np.concatenate([[last is None or sign[0] != last[0]], sign[1:] != sign[:-1]]))
            heads = doc[starts]
            if not len(starts) or starts[0]:
                starts, heads = np.append(0, starts), np.append(low, heads)
            lows = np.repeat(heads, np.diff(starts, append=len(doc)))
            pairs, n = np.unique(np.stack([doc, lows])[:, doc != lows], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "low", "n", "signature", "range"])
            first = first or (sign[0], doc[0])
            last, low = (sign[-1], doc[-1]), heads[-1]
        if first:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([first[1], last[1]], pa.int64()), pa.nulls(2, pa.int64()), pa.array([0, 1], pa.int64()), pa.array([first[0], last[0]], pa.int64()), pa.array([at, at], pa.int64())], names=["doc_id", "low", "n", "signature", "range"])

    ranged = signs.select("signature", "doc_id").repartitionByRange("signature", "doc_id").sortWithinPartitions("signature", "doc_id")
    found = materialise(ranged.mapInArrow(run, "doc_id long, low long, n long, signature long, range long"), "agreed")
    ends = sorted((r["range"], r["n"], r["signature"], r["doc_id"]) for r in found.filter("range is not null").collect())
    over = [(b[3], a[3], 1) for a, b in zip(ends[1::2], ends[2::2], strict=False) if a[2] == b[2] and a[3] != b[3]]
    joined = found.filter("range is null").select("doc_id", "low", "n").unionByName(signs.sparkSession.createDataFrame(over, "doc_id long, low long, n long"))
    joined._twinsift_path = found._twinsift_path  # so that the caller can forget() it
    return joined


def common_shingles(base: DataFrame, n: int, most: int = 65_536, chunk: int = 1_000_000) -> np.ndarray:
    """The hashes of the commonest shingles, at most `most`, sorted: those that chunks of a million shingles repeat, by count."""

    def repeated(batches):
        held, size, local = [], 0, set()

        def close():
            h, k = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[k > 1].view(np.int64)), pa.array(k[k > 1], pa.int64())], names=["h", "k"])

        for b in sliced(batches):
            for text in b.column(1).to_pylist():
                s = shingle_set(text, n)
                d = xxhash.xxh3_64_intdigest(s)
                if d in local:
                    continue  # a copy
                local.add(d)
                held.append(s)
                size += len(s)
                if size >= chunk:
                    yield close()
                    held, size, local = [], 0, set()
        if held:
            yield close()

    counted = base.mapInArrow(repeated, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    top = counted.orderBy(F.desc("k"), "h").limit(most).select("h").toArrow()
    return np.sort(top["h"].to_numpy().view(np.uint64)) if len(top) else np.zeros(0, np.uint64)


def product_links(x: list[np.ndarray], y: list[np.ndarray] | None, bounds: Bounds, columns: int = 4096) -> np.ndarray:
    """Which sets of x and y are linked (y None: of x among themselves), as a boolean matrix."""
    y_ = x if y is None else y
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y_])
    need = bounds.need(nx[:, None], ny[None, :])
    alive = need <= np.minimum(nx[:, None], ny[None, :])
    if y is None:
        np.fill_diagonal(alive, False)
    hx, rx = np.concatenate(x), np.repeat(np.arange(len(x)), nx)
    hy, ry = (hx, rx) if y is None else (np.concatenate(y_), np.repeat(np.arange(len(y_)), ny))
    if y is None:
        values, counts = np.unique(hx, return_counts=True)
        values = values[counts > 1]
    else:
        values = np.intersect1d(hx, hy)

    def placed(h, r):
        """Entries in shared columns, by column."""
        at = np.searchsorted(values, h)
        at[at == len(values)] = 0
        ok = values[at] == h if len(values) else np.zeros(len(h), bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], r[ok][order]

    cx, rx = placed(hx, rx)
    cy, ry = (cx, rx) if y is None else placed(hy, ry)
    left_x, left_y = np.bincount(rx, minlength=len(nx)), np.bincount(ry, minlength=len(ny))
    overlap = np.zeros(need.shape, np.int64)
    alive &= np.minimum(left_x[:, None], left_y[None, :]) >= need
    for lo in range(0, len(values), columns):
        if not alive.any():
            break
        width = min(columns, len(values) - lo)
        i, j = np.searchsorted(cx, [lo, lo + width])
        p, q = np.searchsorted(cy, [lo, lo + width])
        a = np.zeros((len(nx), width), np.float32)
        a[rx[i:j], cx[i:j] - lo] = 1
        b = a
        if y is not None:
            b = np.zeros((len(ny), width), np.float32)
            b[ry[p:q], cy[p:q] - lo] = 1
        overlap += (a @ b.T).astype(np.int64)
        left_x = left_x - np.bincount(rx[i:j], minlength=len(nx))
        left_y = left_y - np.bincount(ry[p:q], minlength=len(ny))
        alive &= overlap + np.minimum(left_x[:, None], left_y[None, :]) >= need
    return alive


def forest(linked: np.ndarray, left: list, right: list | None) -> Iterator[tuple]:
    """Edges that join what the matrix links, as few as can be."""
    if right is None:
        seen = np.zeros(len(left), bool)
        for root in range(len(left)):
            if seen[root]:
                continue
            seen[root] = True
            stack = [root]
            while stack:
                at = stack.pop()
                for k in np.flatnonzero(linked[at] & ~seen).tolist():
                    seen[k] = True
                    stack.append(k)
                    yield left[at], left[k]
        return
    n = len(left)
    square = np.zeros((n + len(right),) * 2, bool)
    square[:n, n:] = linked
    square[n:, :n] = linked.T
    yield from forest(square, left + right, None)


def _links(percent: int):
    bounds = Bounds(percent)

    def run(batches):
        key, x, y = None, ([], []), ([], [])

        def close():
            if not x[0]:
                return
            if key[1] == key[2]:
                if len(x[0]) > 1:
                    yield from forest(product_links(x[1], None, bounds), x[0], None)
            elif y[0]:
                yield from forest(product_links(x[1], y[1], bounds), x[0], y[0])

        def batch(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        out: list = []
        for b in batches:
            for block, i, j, tile, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, i, j) != key:
                    out += close()
                    key, x, y = (block, i, j), ([], []), ([], [])
                side = x if tile == i else y
                if side[0] and side[0][-1] == doc and len(side[1][-1]) * 8 == len(raw) and side[1][-1].tobytes() == raw:
                    continue  # a repeated row
                side[0].append(doc)
                side[1].append(np.frombuffer(raw, np.uint64))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += close()
        if out:
            yield batch(out)

    return run


def _write_tiles(folder: str):
    """For rows (tile, doc_id, hashes) sorted by tile: each tile as one file of its name, and its number as a row."""

    def run(batches):
        at, docs, sets = None, [], []

        def close():
            held = pa.record_batch([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])
            with pa.ipc.new_stream(out := pa.BufferOutputStream(), held.schema) as writer:
                writer.write_batch(held)
            put_file(folder, str(at), out.getvalue())

        for b in batches:
            done = []
            for tile, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tile != at:
                    if docs:
                        close()
                        done.append(at)
                    at, docs, sets = tile, [], []
                if not (docs and docs[-1] == doc and sets[-1] == raw):  # else a repeated row
                    docs.append(doc)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["tile"])
        if docs:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["tile"])

    return run


def _tile_links(folder: str, percent: int):
    """For rows (i, j), sorted: edges that join what is linked between the tiles i and j, or within i if they are one."""
    bounds = Bounds(percent)

    def tile(k: int) -> tuple[list[int], list[np.ndarray]]:
        rows = pa.ipc.open_stream(get_file(f"{folder}/{k}")).read_all()
        return rows["doc_id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]

    def run(batches):
        at, x = None, ([], [])
        for b in batches:
            for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != at:
                    at, x = i, tile(i)
                if i != j:
                    y = tile(j)
                    edges = list(forest(product_links(x[1], y[1], bounds), x[0], y[0]))
                else:
                    edges = list(forest(product_links(x[1], None, bounds), x[0], None)) if len(x[0]) > 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


@small_batches
def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", tile_docs: int = 1024, tile_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) for every row of docs.

    Two documents link where 100 * intersection >= percent * union of their sets of n-word shingles. A text without
    words (null, empty, blanks) has no shingles and links with nothing. Rows of one id are one document, with the links
    of all its texts; each row is returned. A null id is linked with nothing and has a null component. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession

    def sketch(batches):
        bounds, local, holders = Bounds(percent), set(), Holders()  # local copies give no signatures again
        for b in sliced(batches):
            ids, sizes, digests, signatures, near = b.column(0).to_pylist(), [], [], [], []
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, n)
                d = xxhash.xxh3_128_digest(s)
                sizes.append(len(s))
                digests.append(d)
                first = doc is not None and len(s) and d not in local
                if first:
                    local.add(d)
                fresh, known = holders.meet(doc, bounds.signatures(s, shared.value)) if first else (None, None)
                signatures.append(fresh)
                near.append(known)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (signatures, near)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], names=["doc_id", "n_shingles", "digest", "signatures", "near"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(common_shingles(base, n))
    table = materialise(base.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, signatures array<long>, near array<long>"), "sets")
    own = table.filter("n_shingles > 0 and doc_id is not null")

    def rows_of_matrix(t):
        return t.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))

    firsts = rows_of_matrix(table)

    # rows of the matrix that share a signature, and the copies that gave signatures with the row they belong to
    signs = own.filter("signatures is not null").select("doc_id", F.explode("signatures").alias("signature"))
    found = agreements(signs)
    # tasks have told the agreements inside them by links
    shared_by = found.unionByName(own.select("doc_id", F.explode("near").alias("low"), F.lit(1).cast("long").alias("n")))
    copies = own.filter("signatures is not null").join(firsts, "digest").filter("doc_id <> rep").select("doc_id", F.col("rep").alias("low"), F.lit(0).cast("long").alias("n"))
    agreed = materialise(shared_by.groupBy("doc_id", "low").agg(F.sum("n").alias("n")).unionByName(copies), "pairs")
    forget(found)
    blocks = connected_components(agreed.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    signed, table = table, materialise(table.select("doc_id", "n_shingles", "digest"), "sizes")
    forget(signed)
    release(spark)
    firsts = rows_of_matrix(table)
    sizes = table.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    members = firsts.join(blocks, F.col("rep") == F.col("node")).select(F.col("rep").alias("doc_id"), F.col("component").alias("block")).distinct().join(sizes, "doc_id")

    def sets(batches):
        doc = text = None
        made, told = b"", set()
        for b in sliced(batches, 5):
            keep, hashes = [], []
            for k, (*place, d, t) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if d != doc:
                    told.clear()
                if d != doc or t != text:
                    made = shingle_set(t, n).tobytes()
                doc, text, key = d, t, (*place, xxhash.xxh3_128_digest(made))
                if key not in told:  # repeated rows of an id count once
                    told.add(key)
                    keep.append(k)
                    hashes.append(made)
            yield pa.RecordBatch.from_arrays([*b.select(["block", "i", "j", "tile", "doc_id"]).take(pa.array(keep, pa.int64())).columns, pa.array(hashes, pa.binary())], names=["block", "i", "j", "tile", "doc_id", "hashes"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def hashed(placed: DataFrame) -> DataFrame:
        """placed(block, i, j, tile, doc_id) with the sets; texts go to their places by one shuffle, at every size alike."""
        work = placed.join(base.hint("merge"), "doc_id").select("block", "i", "j", "tile", "doc_id", "text")
        return work.mapInArrow(sets, "block long, i long, j long, tile long, doc_id long, hashes binary")

    def products(placed: DataFrame) -> DataFrame:
        """The links of placed(block, i, j, tile, doc_id): of each block's tiles i and j; hashes leave for their tiles by one shuffle more."""
        return hashed(placed).repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "tile", "doc_id").mapInArrow(_links(percent), "a long, b long")

    # each row with its pivot; a pivot's rows are dealt into tiles by a hash, as many as they fill
    pivots = agreed.filter("n > 0").groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("low")).alias("low"))).alias("p")).select("doc_id", (-F.col("p.low")).alias("pivot"))
    other = sizes.select(F.col("doc_id").alias("pivot"), F.col("n").alias("m"))
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pivots = materialise(pivots.join(sizes, "doc_id").join(other, "pivot").filter(fits), "pivots")
    room = pivots.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / min(tile_docs, 128), F.sum("n") / tile_shingles)).alias("tiles"))
    dealt = materialise(pivots.join(materialise(room, "room"), "pivot").select(F.col("pivot").alias("block"), F.pmod(F.xxhash64("doc_id"), F.col("tiles")).alias("i"), "doc_id"), "dealt")
    to_place = dealt.select("block", "i", F.lit(-1).cast("long").alias("j"), F.col("i").alias("tile"), "doc_id")
    own_tile = dealt.select("block", "i").distinct().select("block", "i", F.lit(-1).cast("long").alias("j"), F.lit(-1).cast("long").alias("tile"), F.col("block").alias("doc_id"))
    near = connected_components(products(to_place.unionByName(own_tile)))
    forget(agreed), forget(pivots), forget(dealt), release(spark)

    # blocks that are not yet one group; a large group has tiles of its own
    members = materialise(members.join(near, F.col("doc_id") == F.col("node"), "left").select("doc_id", "block", "n", F.coalesce("component", "doc_id").alias("group")), "members")
    forget(blocks)
    groups = materialise(members.groupBy("block", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("sizes")), "groups")
    mixed = groups.groupBy("block").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("block")
    large = groups.filter((F.col("rows") * 4 >= tile_docs) | (F.col("sizes") * 4 >= tile_shingles)).select("block", "group", F.lit(True).alias("large"))
    rest = F.lit(-(2**63)).cast("long")  # the tiles of all small groups
    left = members.join(mixed, "block", "left_semi").join(large, ["block", "group"], "left").withColumn("own", F.when(F.col("large"), F.col("group")).otherwise(rest))

    # by size within each block: ranges are ranked apart, after what the ranges before hold, so no task has a block of its own
    rows = materialise(left.repartitionByRange("block", "own", "n", "doc_id").withColumn("range", F.spark_partition_id()), "rows")
    forget(members), forget(groups)
    counts = rows.groupBy("block", "own", "range").agg(F.count("*").alias("rows"), F.sum("n").alias("sizes"))
    earlier = W.partitionBy("block", "own").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    counts = counts.select("block", "own", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows"), F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("sizes"))
    counts = materialise(counts, "ranges")
    by_size = W.partitionBy("range", "block", "own").orderBy("n", "doc_id")
    tiled = rows.withColumn("rank", F.row_number().over(by_size) - 1).withColumn("before", F.sum("n").over(by_size.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).join(counts, ["block", "own", "range"])
    tile = F.floor((F.col("rank") + F.col("rows")) / tile_docs) + F.floor((F.col("before") + F.col("sizes")) / tile_shingles)
    tiled = materialise(tiled.select("doc_id", "block", "own", "n", tile.alias("tile")), "tiles")
    forget(rows), forget(counts)
    tiles = materialise(tiled.groupBy("block", "own", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("i", F.monotonically_increasing_id()), "numbers")
    other = tiles.select("block", F.col("own").alias("own_j"), F.col("i").alias("j"), F.col("least").alias("least_j"), F.col("most").alias("most_j"))
    fits = (F.col("most") * 100 >= F.col("least_j") * percent) & (F.col("most_j") * 100 >= F.col("least") * percent)
    pairs = tiles.join(other, "block").filter("i <= j").filter(fits & ((F.col("own") != F.col("own_j")) | (F.col("own") == rest))).select("block", "i", "j")
    pairs = materialise(pairs.select("i", "j"), "pairs")
    numbered = materialise(tiled.join(tiles.select("block", "own", "tile", "i"), ["block", "own", "tile"]).select("block", "i", F.lit(0).cast("long").alias("j"), F.col("i").alias("tile"), "doc_id"), "numbered")
    forget(tiled), forget(tiles), release(spark)
    folder = scratch(spark, "tile-files")
    hashed(numbered).select("tile", "doc_id", "hashes").repartition(parts, "tile").sortWithinPartitions("tile", "doc_id").mapInArrow(_write_tiles(folder), "tile long").agg(F.count("*")).collect()
    forget(numbered), release(spark)
    links = pairs.repartitionByRange(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(_tile_links(folder, percent), "a long, b long")
    groups = connected_components(links.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    drop_scratch(spark, folder), forget(pairs), forget(near), release(spark)

    # one row for each set; written, so that Spark can split a set that a third of the documents have
    found = materialise(firsts.join(groups, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "groups")
    forget(groups)
    own_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return table.join(found, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own_id).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its group.

    Rows with a null id, and texts without words, stay; repeated rows of an id that stays all stay; an empty table gives
    no rows.
    """
    classes = jaccard_components(docs, n, percent, id_col, text_col)
    (gone,) = unused(docs.columns, "gone")
    out = classes.filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs[id_col] == F.col(gone), "left_anti")


def oracle(n: int = 3, percent: int = 90) -> str:
    """DuckDB SQL for jaccard_components() over the table documents: every pair that shares an n-gram, then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) END AS s FROM words
    ), grams AS (SELECT doc_id, len(s) AS k, unnest(s) AS g FROM sets
    ), links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.k, b.k) >= {percent} * greatest(a.k, b.k)
      GROUP BY a.doc_id, b.doc_id, a.k, b.k HAVING 100 * count(*) >= {percent} * (a.k + b.k - count(*))
    ), reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.to_id
    ), low AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
    SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets LEFT JOIN low USING (doc_id)
    """
