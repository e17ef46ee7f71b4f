"""Digests of content held in a column, and of files named by a path column. One algorithm gives both the same digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.schema import CUTS, READ_BYTES, SAMPLE_BYTES

DIGEST = "struct<digest: string, error: string, bytes: bigint>"


def size_of(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def full_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_digest(content: Column, algorithm: str = "sha256") -> Column:
    """The digest of a column of bytes or text: SHA-256 by Spark itself, any other algorithm of hashlib (blake2b, say) by Arrow batches. A null stays null."""
    if algorithm == "sha256":
        return full_digest(content)
    hashlib.new(algorithm)  # an unknown name fails here, not in a task

    @F.arrow_udf("string")
    def digest(raw: pa.Array) -> pa.Array:
        return pa.array([hashlib.new(algorithm, x.as_buffer()).hexdigest() if x.is_valid else None for x in raw], pa.string())

    return digest(content.cast("binary"))


def sample_digest(content: Column) -> Column:
    """Digest of the first bytes and, of content longer than one window, the middle and last ones too."""
    raw, n = content.cast("binary"), F.octet_length(content)
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - SAMPLE_BYTES // 2)
    windows = F.concat(F.substring(raw, F.lit(1), F.lit(SAMPLE_BYTES)), F.substring(raw, middle + 1, F.lit(SAMPLE_BYTES)), F.substring(raw, n - SAMPLE_BYTES + 1, F.lit(SAMPLE_BYTES)))
    return F.sha2(F.when(n > SAMPLE_BYTES, windows).otherwise(F.substring(raw, F.lit(1), F.lit(SAMPLE_BYTES))), 256)


def _blocks(f, start: int, stop: int | None) -> Iterator[bytes]:
    f.seek(start)
    while (left := READ_BYTES if stop is None else min(READ_BYTES, stop - f.tell())) > 0 and (block := f.read(left)):
        yield block


def _hash_file(path: str, windows: list[tuple[int, int | None]], algorithm: str) -> tuple[str | None, str | None, int]:
    """The digest of byte ranges (start, stop; None: the end), read in blocks; what went wrong; bytes read."""
    h, n = hashlib.new(algorithm), 0
    try:
        with open(path, "rb") as f:
            for start, stop in windows:
                for block in _blocks(f, start, stop):
                    h.update(block)
                    n += len(block)
    except OSError as e:
        return None, str(e), n
    return h.hexdigest(), None, n


def sample_windows(size: int) -> list[tuple[int, int]]:
    """The ranges that sample_digest() takes of content of this size."""
    if size <= SAMPLE_BYTES:
        return [(0, SAMPLE_BYTES)]
    middle = max(0, size // 2 - SAMPLE_BYTES // 2)
    return [(0, SAMPLE_BYTES), (middle, middle + SAMPLE_BYTES), (size - SAMPLE_BYTES, size)]


def _reader(windows: Callable[[int], list[tuple[int, int | None]]], algorithm: str) -> Callable[[str, str], Column]:
    """A column of digest, error and bytes read of the files of a path column. Marked nondeterministic, so that no optimizer rule repeats a read."""
    hashlib.new(algorithm)

    @F.pandas_udf(DIGEST)
    def read(path: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_hash_file(p, windows(n), algorithm) for p, n in zip(path, size, strict=True)], columns=["digest", "error", "bytes"]).astype({"bytes": "int64"})

    return read.asNondeterministic()


def file_digest(path: str = "path", size: str = "size", algorithm: str = "sha256") -> Column:
    """struct(digest, error, bytes) of whole files, each read once."""
    return _reader(lambda n: [(0, None)], algorithm)(path, size)


def file_sample(path: str = "path", size: str = "size", algorithm: str = "sha256") -> Column:
    """struct(digest, error, bytes) of the first bytes and, of files longer than one window, the middle and last ones too."""
    return _reader(sample_windows, algorithm)(path, size)


def file_range(turn: int, path: str = "path", size: str = "size", algorithm: str = "sha256") -> Column:
    """struct(digest, error, bytes) of the bytes between two neighbours of CUTS."""
    low, high = (0, *CUTS)[turn], CUTS[turn]
    return _reader(lambda n: [(low, high)], algorithm)(path, size)


PAIR = "equal boolean, digest string, left_error string, right_error string, bytes long, left_ranges array<string>, right_ranges array<string>"


def compare_two(left: str, right: str, known: tuple[list[str], list[str]], algorithm: str) -> tuple:
    """The columns of PAIR for two files of one size, read block by block until they differ.

    What each has between neighbours of CUTS is hashed on the way, up to the range where they differ, so that they need
    not be read again. Files whose known ranges differ are not read; equal ones get the digest of the whole.
    """
    if any(a != b for a, b in zip(*known, strict=False)):
        return False, None, None, None, 0, *known
    whole, ranges, n = hashlib.new(algorithm), ([], []), 0
    error, files, equal = [None, None], [], True
    try:
        for side, path in enumerate((left, right)):
            try:
                files.append(open(path, "rb"))  # noqa: SIM115 - closed below
            except OSError as e:
                error[side] = str(e)
        if any(error):
            return None, None, *error, 0, *known
        cuts, hashes, at, begun = list(CUTS), [hashlib.new(algorithm), hashlib.new(algorithm)], 0, 0
        while True:
            blocks = []
            for side, f in enumerate(files):
                try:
                    blocks.append(f.read(min(READ_BYTES, cuts[0] - at) if cuts else READ_BYTES))
                except OSError as e:
                    error[side] = str(e)
                    return None, None, *error, n, *ranges
            n += len(blocks[0]) + len(blocks[1])
            equal &= blocks[0] == blocks[1]
            at += len(blocks[0])
            if cuts:
                for h, b in zip(hashes, blocks, strict=True):
                    h.update(b)
            if equal:
                whole.update(blocks[0])
            ended = not blocks[0] and not blocks[1]
            if cuts and at >= cuts[0]:
                for r, h in zip(ranges, hashes, strict=True):
                    r.append(h.hexdigest())
                cuts, hashes, begun = cuts[1:], [hashlib.new(algorithm), hashlib.new(algorithm)], at
                if not equal:
                    break
            if ended or (not equal and not cuts) or len(blocks[0]) != len(blocks[1]):
                if cuts and at > begun:  # the last range ends with the file
                    for r, h in zip(ranges, hashes, strict=True):
                        r.append(h.hexdigest())
                break
        return equal, whole.hexdigest() if equal else None, None, None, n, *ranges
    finally:
        for f in files:
            f.close()
