"""Whole-text tokenisation with a public tokenizer file, piece by piece and memoised.

A public BPE file tokenises each pre-token on its own, so a text's ids are the ids of its pieces in a row, if it is cut
between pre-tokens. It is cut where white space follows something else and where punctuation of ASCII follows a Latin
letter: in the patterns of these files a token has white space at its start alone and no letter before punctuation. Where
that is in doubt (a character that may be white space to the library) it is not cut. Most pieces recur; each is given to
the tokenizers library once and then looked up. A text that may hold one of the file's added tokens, such as
<|endoftext|>, is given to the library whole. So the ids are the library's own for every text (tests compare them with an
unmodified tokenizer, on arbitrary Unicode and on added tokens). The memo is a cache: it is emptied when full and changes
no result.
"""

from __future__ import annotations

from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from twinsift.llm._util import sole

END = 1


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges, both ends included."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_BLANK = _bytes((9, 10), (13, 13), (32, 32))
_LETTER = _bytes((65, 90), (97, 122))
_GRAPHIC = _bytes((0x21, 0x7E))
_CUT = _BLANK | _GRAPHIC & ~_LETTER & ~_bytes((48, 57))
_DOUBTFUL = _bytes((0x80, 0x8A), (0x8E, 0x8E), (0x9F, 0x9F), (0xA8, 0xA9), (0xAF, 0xAF))  # last bytes of white space of three bytes
_CAPITAL = _bytes((0x80, 0x96), (0x98, 0x9E))  # after 0xC3
_LOWER = np.arange(256, dtype=np.uint8) + np.where(_bytes((65, 90)), 32, 0).astype(np.uint8)
_LOWER[10] = 32
_encoders: dict = {}


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


def _bounds(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]


class PieceEncoder:
    """ids of many texts at once, each followed by END.

    The memo is two Arrow columns, a piece's bytes and its ids (uint32); entry 0 is the end id.
    """

    def __init__(self, path: str, spaced: bool, max_pieces: int = 600_000, max_ids: int = 4_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        # an added token is looked for in the text as it is, where its first characters must then stand
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.spaced, self.max_pieces, self.max_ids = spaced, max_pieces, max_ids
        self.plain = self.tokenizer
        if not spaced:  # for pieces that the normaliser leaves as they are
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of a token is one byte of text
            self.bytes[i] = len(token.removesuffix("</w>"))
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([b""], pa.large_binary())
        self.codes = _binary(np.array([0, 4]), np.array([END], np.uint32))
        self.hits = np.zeros(1, np.int64)

    def _is_plain(self, k: str) -> bool:
        if self.spaced:
            return k[0] in " \t\n\r" and not k[-1].isspace()
        return k.isprintable() and k != "" and " " not in k and (k == k.lower() if k.isascii() else k.islower() and is_normalized("NFC", k))

    def learn(self, new: list[str]) -> pa.Array:
        """The ids of each of these pieces, as they are kept."""
        if not self.spaced:
            new = [k.lstrip(" ") for k in new]
        kind = np.fromiter(map(self._is_plain, new), bool, len(new))
        plain, odd = np.flatnonzero(kind).tolist(), np.flatnonzero(~kind).tolist()
        order, parts, sizes = [], [], []
        for lo in range(0, len(plain), 500):
            at = plain[lo : lo + 500]
            part = [new[i] for i in at]
            (whole,) = self.plain.encode_batch_fast([("" if self.spaced else " ").join(part)], add_special_tokens=False)
            ids = np.array(whole.ids, np.uint32)
            # nothing in these pieces is changed or dropped but the space, so ids are told apart by their bytes
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
            read = np.cumsum(self.bytes[ids])
            last = np.searchsorted(read, ends)
            if last[-1] == len(ids) - 1 and np.array_equal(read[last], ends):
                order += at
                parts.append(ids)
                sizes.append(np.diff(last, prepend=-1))
            else:
                odd += at
        if odd:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in odd], add_special_tokens=False)]
            order += odd
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes[-1].sum())))
        codes = _binary(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * 4, np.concatenate(parts))
        return codes.take(pa.array(np.argsort(order)))

    def entries(self, pieces: pa.Array) -> np.ndarray:
        """The memo's entry of each piece; what it does not have, it learns."""
        found = pc.index_in(pieces, value_set=self.keys)
        at = found.fill_null(-1).to_numpy()
        if found.null_count:
            coded = pieces.filter(found.is_null()).dictionary_encode()
            at = at.copy()
            at[at < 0] = coded.indices.to_numpy() + len(self.keys)
            self.codes = pa.concat_arrays([self.codes, self.learn(coded.dictionary.cast(pa.large_string()).to_pylist())])
            self.keys = pa.concat_arrays([self.keys, coded.dictionary])
            self.hits = np.concatenate([self.hits, np.zeros(len(self.keys) - len(self.hits), np.int64)])
        return at

    def cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and where each text's end among them."""
        at = _bounds(column)
        text = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not self.spaced:  # these tokenizers take line ends for spaces and lower-case; doing it first lets more pieces recur
            raw, text = text, _LOWER[text]
            wide = np.flatnonzero(raw == 0xC3) + 1
            text[wide[_CAPITAL[raw[wide]]]] += 32
            # a small letter and a mark may compose where the capital and the mark do not: texts with U+0300 to U+037F stay
            for i in np.unique(np.searchsorted(at, np.flatnonzero(raw >> 1 == 0xCC >> 1), "right")).tolist():
                text[at[i - 1] : at[i]] = raw[at[i - 1] : at[i]]
        here = np.flatnonzero(_CUT[text])
        before, blank = text[here - 1], _BLANK[text[here]]
        good = np.where(blank, _GRAPHIC[before], _LETTER[before])
        wide = np.flatnonzero(before >= 0x80)
        one, two, three = before[wide], text[here[wide] - 2], text[here[wide] - 3]
        maybe_blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & _DOUBTFUL[one]
        good[wide] = np.where(blank[wide], ~maybe_blank, (two == 0xC3) & (one != 0x97) & (one != 0xB7))
        begins = np.zeros(len(text), bool)
        begins[here[good]] = True
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        return _binary(np.append(starts, len(text)), text), np.searchsorted(starts, at[1:])

    def _with_added(self, column: pa.Array, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """encode() where these texts go to the library whole."""
        parts, lens, last = [], [], 0
        for i in [*whole, len(column)]:
            ids, ends = self.encode(column.slice(last, i - last))
            parts.append(ids)
            lens.append(np.diff(ends))
            if i < len(column):
                ids = self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids
                parts.append(np.array([*ids, END], np.uint32))
                lens.append([len(ids) + 1])
            last = i + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64)

    def forget(self) -> None:
        """Keeps the half of the memo that was looked up most."""
        keep = np.flatnonzero(self.hits >= max(2, np.partition(self.hits, len(self.hits) // 2)[len(self.hits) // 2] + 1))
        keep = pa.array(np.concatenate([[0], keep[keep > 0]]))
        self.keys, self.codes, self.hits = self.keys.take(keep), self.codes.take(keep), np.zeros(len(keep), np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and the bounds of each text's ids (len(texts) + 1). texts: strings, or an Arrow array whose nulls are empty texts."""
        if len(self.keys) > self.max_pieces or _bounds(self.codes)[-1] > 4 * self.max_ids:
            self.forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        added = np.zeros(len(column), bool)
        for mark in self.marks:
            added |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        if added.any():
            return self._with_added(column, np.flatnonzero(added).tolist())
        pieces, ends = self.cut(column)
        at = np.insert(self.entries(pieces), ends, 0)
        self.hits += np.bincount(at, minlength=len(self.hits))
        ids = self.codes.take(pa.array(at))
        bounds = _bounds(ids) // 4
        return np.frombuffer(ids.buffers()[2], np.uint32)[: bounds[-1]], np.concatenate([[0], bounds[ends + np.arange(1, len(ends) + 1)]])


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder for each Python worker and file, kept from task to task."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = PieceEncoder(path, spaced)
    sole(_encoders[path, spaced])
    return _encoders[path, spaced]
