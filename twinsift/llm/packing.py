"""Packing: sum-of-squares online packing of token sequences into fixed-length windows.

A level array counts the partially filled windows at each fill level. A document's tokens (cut at the window length)
are placed one piece at a time where the sum of the squared counts grows least: in an open window of some level, or in a
new one. Ties go to the fullest level. Each task packs its own partition with its own level array. Pieces that are still
in open windows when a task's rows end, or when it has `max_open` open windows, are packed once more by the same rule,
those of `merge` tasks together, so that short partitions make long streams too. Only what is open after that is laid
end to end and cut at the window length, which leaves at most one padded window each time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm import tokens
from twinsift.llm._util import id_and_text, materialise, sliced, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
_TASK = 40  # bits of a sequence id below the task's number
_AGAIN = 1 << 62  # marks sequences of the second round


class SumOfSquares:
    """Sum-of-squares packer of one stream. put() and flush() give (key, start, ids, doc_tokens, window, offset) pieces.

    With more than max_open open windows, overflow() clears them and gives the pieces that are placed by that: flush(),
    unless another is given.
    """

    def __init__(self, window: int = 2048, max_open: int = 4096, overflow: Callable[[], Iterator[tuple]] | None = None):
        self.window, self.max_open, self.overflow = window, max_open, overflow or self.flush
        self.levels = np.zeros(window + 1, np.int64)  # how many windows are filled to each level; full ones don't count
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.open: dict[int, list] = {}
        self.made = 0

    def best(self, size: int) -> int:
        """The level whose windows the piece goes to; 0 is a new window."""
        n, w = self.levels, self.window
        here = n[1 : w - size + 1]
        if not len(here):
            return 0
        grown = 2 * (n[1 + size : w + 1] - here) + 2
        grown[-1] -= 1  # a window that is full leaves the sum
        grown[here == 0] = np.iinfo(np.int64).max
        k = len(grown) - 1 - int(np.argmin(grown[::-1]))
        return k + 1 if grown[k] <= 2 * n[size] + 1 else 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, key, ids: np.ndarray, first: int = 0, total: int | None = None) -> Iterator[tuple]:
        """Places a document's ids, or those from `first` on of a document of `total` ids."""
        w, total = self.window, len(ids) if total is None else total
        for lo in range(0, len(ids), w):
            piece, start = ids[lo : lo + w], first + lo
            size = len(piece)
            if size == w:
                yield key, start, piece, total, self.new(), 0
                continue
            level = self.best(size)
            if level:
                k = self.at[level].pop()
                self.levels[level] -= 1
            else:
                k = self.new()
                self.open[k] = []
            self.open[k].append((key, start, piece, total, k, level))
            if level + size == w:
                yield from self.open.pop(k)
            else:
                self.levels[level + size] += 1
                self.at[level + size].append(k)
        if len(self.open) > self.max_open:
            yield from self.overflow()

    def drain(self) -> Iterator[tuple]:
        """The pieces in open windows, as they lie; there are no open windows after that."""
        for pieces in self.open.values():
            yield from pieces
        self.levels[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.open = {}

    def flush(self) -> Iterator[tuple]:
        """The pieces in open windows, laid end to end in new ones and cut at their length."""
        room = window = 0
        for key, start, ids, total, _, _ in self.drain():
            while len(ids):
                if not room:
                    room, window = self.window, self.new()
                part = ids[:room]
                yield key, start, part, total, window, self.window - room
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)


def _rows(pieces: list[tuple], base: int) -> list[tuple]:
    return [(key, start, len(ids), zlib.crc32(ids), total, base + k, offset) for key, start, ids, total, k, offset in pieces]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)


@small_batches
def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, spaced: bool = True, merge: int = 8, max_open: int = 4096) -> DataFrame:
    """Packs every document's ids, an end id after each, into windows of at most `window` tokens.

    One row for each piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset. `spaced` says whether the tokenizer marks the space before a word. A null or empty text is the end id alone;
    texts of any length are packed whole; equal rows are packed each; a null id stays null; an empty table gives no row;
    other columns are not read. sequence_id is unique, with the task's number above its low 40 bits and bit 62 set in
    windows of the second round.
    """
    held = pa.schema([*_ARROW, ("ids", pa.binary())])

    def first_round(batches):
        base, left = TaskContext.get().partitionId() << _TASK, []

        def aside():
            left.extend(packer.drain())
            return iter(())

        enc, packer = tokens.encoder(tokenizer_path, spaced), SumOfSquares(window, max_open, aside)

        def emit(pieces: list[tuple], with_ids: bool):
            for lo in range(0, len(pieces), 2000):
                part = pieces[lo : lo + 2000]
                ids = [p[2].tobytes() if with_ids else None for p in part]
                yield pa.RecordBatch.from_arrays([*_batch(_rows(part, base)).columns, pa.array(ids, pa.binary())], schema=held)

        out: list = []
        for b in sliced(batches, rows=2000, size=8 << 20):
            ids, ends = enc.encode(b.column(1))
            for key, lo, hi in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out += packer.put(key, ids[lo:hi])
                if len(out) > 20_000:
                    yield from emit(out, False)
                    out = []
                if left:
                    yield from emit(left, True)
                    left.clear()
        yield from emit(out, False)
        yield from emit(list(packer.drain()), True)

    def second_round(batches):
        packer, out = SumOfSquares(window, max_open), []
        base = _AGAIN | TaskContext.get().partitionId() << _TASK
        for b in batches:
            for key, start, total, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                out += packer.put(key, np.frombuffer(raw, np.uint32), start, total)
            if out:
                yield _batch(_rows(out, base))
                out = []
        out += packer.flush()
        if out:
            yield _batch(_rows(out, base))

    placed = materialise(id_and_text(docs, id_col, text_col).mapInArrow(first_round, SCHEMA + ", ids binary"), "packed")
    task = F.shiftright("sequence_id", _TASK)
    left = placed.filter("ids is not null")
    tasks = left.agg(F.count_distinct(task)).first()[0]
    parts = max(1, tasks // merge)
    again = left.withColumn("stream", F.pmod(task, F.lit(parts))).repartition(parts, "stream").sortWithinPartitions("stream", "sequence_id", "offset").select("doc_id", "start", "doc_tokens", "ids")
    return placed.filter("ids is null").drop("ids").unionByName(again.mapInArrow(second_round, SCHEMA))
