"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as secret begin, inside or outside. A token's score is a sum of weights of its own shape, of the
classes of the three tokens before and the one after it, and of how much of the text assigns values; transitions do the
rest. It is trained here on labelled lines made from a seed by the rules below (values in many formats and contexts, and
look-alikes that are no secrets). Viterbi decoding is exact: a token whose margin for outside exceeds what all others
can win back is outside on the best path, so only the runs between such tokens are decoded.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import id_and_text, in_slices, sliced, sole, texts_of

# Fixed patterns of the base scan; a match stands if its last group is long enough
KINDS = ("assign", "access", "hex", "field")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal either way
_CUES = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    lower = text.lower()
    if any(c in lower for c in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# ---- tokens, shapes and classes

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]+")
OUT, BEGIN, IN = 0, 1, 2
_KEYS = frozenset("password passwd pwd passphrase secret token apikey api_key access_key secret_key private_key auth_token access_token client_secret credential credentials".split())
_BEARER = frozenset("bearer basic authorization".split())
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|pk[-_]|eyJ|AIza|glpat-|npm_")
_HEXISH = re.compile(r"[0-9a-fA-F]{16,}\Z")
_SIZES = (3, 8, 16, 24, 40)
_NONE, _WORD, _KEY, _SEP, _QUOTE, _BEAR, _NUMBER, _MARK, _CODE = range(9)
N_CLASS = 9
N_SHAPE = 26


def describe(token: str) -> tuple[tuple[int, ...], int]:
    """Active shape features, and the class that neighbours see."""
    n, low = len(token), token.lower()
    size = 1 + bisect_right(_SIZES, n)
    if n < 16 and token.isascii() and token.isalpha() and (low == token or token[1:] == low[1:]):  # most words; what follows gives the same
        return (0, size, 7 if low == token else 9 if n > 1 else 8), _KEY if low in _KEYS else _BEAR if low in _BEARER else _WORD
    digits = sum(c in string.digits for c in token)
    lowers, uppers = sum(c.islower() for c in token), sum(c.isupper() for c in token)
    letters = sum(c.isalpha() for c in token)
    f = [0, size]
    if letters == n:
        f.append(7 if lowers == n else 8 if uppers == n else 9 if token[0].isupper() and lowers == n - 1 else 10)
    elif digits == n:
        f.append(11)
    elif not letters and not digits:
        f.append(12)
    elif not digits:
        f.append(13)
    else:
        f.append(14 if lowers and not uppers else 15 if uppers and not lowers else 16 if uppers else 17)
    if _HEXISH.match(token) and digits:
        f.append(18)
    if _PREFIX.match(token) and n >= 16:
        f.append(19)
    if digits:
        f.append(20 if digits * 5 < n else 21 if digits * 2 < n else 22)
    turns = sum(a.isdigit() != b.isdigit() or a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
    if turns >= 3:
        f.append(23)
    if turns >= 6:
        f.append(24)
    if n > 1 and any(c in "/_.-" for c in token[1:-1]):
        f.append(25)
    if low.strip("\"'") in _KEYS or low.rsplit("_", 1)[-1] in ("password", "secret", "token", "key") and "_" in low:
        c = _KEY
    elif low in _BEARER:
        c = _BEAR
    elif token in (":", "=", ":=", "=>", "==", '":', "':", '="', "='", ':"', '":"'):
        c = _SEP
    elif token.strip("\"'`") == "":
        c = _QUOTE
    elif not letters and not digits:
        c = _MARK
    elif digits == n:
        c = _NUMBER
    elif digits and n >= 16:
        c = _CODE
    else:
        c = _WORD
    return tuple(f), c


class _Codes(dict):
    """token -> shape number * N_CLASS + class; a cache, emptied when full. Shapes are few: features come in ranges."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[tuple, int] = {}
        self.table = np.zeros((0, N_SHAPE), np.float32)

    def __missing__(self, token: str) -> int:
        shape, c = describe(token)
        if shape not in self.shapes:
            self.shapes[shape] = len(self.shapes)
            row = np.zeros((1, N_SHAPE), np.float32)
            row[0, list(shape)] = 1
            self.table = np.vstack([self.table, row])
        self[token] = k = self.shapes[shape] * N_CLASS + c
        return k


_codes = _Codes()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens in a row, and each text's number of tokens."""
    sole(_codes)
    if len(_codes) > 300_000:
        _codes.clear()
    words: list[str] = []
    ends = []
    for t in texts:
        words += TOKEN.findall(t)
        ends.append(len(words))
    return np.fromiter(map(_codes.__getitem__, words), np.int64, len(words)), np.diff(ends, prepend=0)


def file_feature(classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each text: no token, under a fiftieth, or more of its tokens assign or quote."""
    signs = np.concatenate([[0], np.cumsum((classes == _SEP) | (classes == _KEY))])
    ends = np.cumsum(lens)
    n = signs[ends] - signs[ends - lens]
    return np.where(n == 0, 0, np.where(n * 50 < lens, 1, 2))


# ---- the field


class Field:
    def __init__(self, shape, near, file, step):
        self.shape, self.near, self.file, self.step = shape, near, file, step  # (N_SHAPE,3) (4,N_CLASS,3) (3,3) (3,3)

    def emissions(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        c = codes % N_CLASS
        e = (_codes.table @ self.shape)[codes // N_CLASS]
        doc = np.repeat(np.arange(len(lens)), lens)
        for k, shift in enumerate((1, 2, 3, -1)):
            other = np.full(len(c), _NONE)
            if abs(shift) < len(c):
                if shift > 0:
                    other[shift:] = np.where(doc[shift:] == doc[:-shift], c[:-shift], _NONE)
                else:
                    other[:shift] = np.where(doc[:shift] == doc[-shift:], c[-shift:], _NONE)
            e += self.near[k][other]
        return e + self.file[np.repeat(file_feature(c, lens), lens)]

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best path; an inside never follows an outside or the start."""
        score = [e[0, OUT], e[0, BEGIN], -np.inf]
        back = []
        s = self.step
        for row in e[1:]:
            best, frm = [], []
            for k in range(3):
                options = [score[j] + s[j, k] if not (j == OUT and k == IN) else -np.inf for j in range(3)]
                j = int(np.argmax(options))
                best.append(options[j] + row[k])
                frm.append(j)
            score = best
            back.append(frm)
        path = [int(np.argmax(score))]
        for frm in reversed(back):
            path.append(frm[path[-1]])
        return path[::-1]

    def tag(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tags of all texts' tokens."""
        tags = np.zeros(len(codes), np.int8)
        if not len(codes):
            return tags
        e = self.emissions(codes, lens).astype(np.float64)
        allowed = [self.step[j, k] for j in range(3) for k in range(3) if (j, k) != (OUT, IN)]
        won = 3 * (max(allowed) - min(allowed)) + max(0.0, float((e[:, IN] - e[:, BEGIN]).max()))
        sure = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, IN]) > won
        ends = np.cumsum(lens)
        starts = ends - lens
        unsure = np.flatnonzero(~sure)
        if not len(unsure):
            return tags
        doc = np.searchsorted(ends, unsure, "right")
        new = np.flatnonzero(np.diff(unsure, prepend=-2) != 1)
        new = np.union1d(new, np.flatnonzero(np.diff(doc, prepend=-1) != 0))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(unsure)], strict=True):
            first, last = int(unsure[lo]), int(unsure[hi - 1])
            d = int(doc[lo])
            a, b = max(first - 1, int(starts[d])), min(last + 2, int(ends[d]))  # with the sure tokens on both sides
            part = e[a:b]
            if a < first:
                part = part.copy()
                part[0, 1:] = -1e9
            if b > last + 1:
                part = part.copy()
                part[-1, 1:] = -1e9
            path = self.viterbi(part)
            tags[first : last + 1] = path[first - a : last + 1 - a]
        return tags


# ---- training lines, from a seed


def _lines(seed: int, n: int) -> list[list[tuple[str, int]]]:
    """Lines of (piece, is secret); a piece may be several tokens."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda alphabet, lo, hi: "".join(pick(alphabet) for _ in range(int(rng.integers(lo, hi + 1))))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que mente é ä ü ung keit".split()

    def word():
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 6))))
        r = rng.random()
        return w.capitalize() if r < 0.15 else w.upper() if r < 0.22 else w

    def prose(k):
        out = []
        for _ in range(k):
            r = rng.random()
            out.append((word(), 0))
            if r < 0.12:
                out.append((pick([",", ".", "!!", "###", "%%%", "|", "$$$", "***", ":", ";", "?"]), 0))
        return out

    hexes, both = "0123456789abcdef", low + up + dig

    def grouped(alphabet, *sizes):
        return "-".join(chars(alphabet, n, n) for n in sizes)

    def plain():  # looks like something, is no secret
        kinds = [
            lambda: chars(dig, 16, 16), lambda: f"+1 ({chars(dig, 3, 3)}) {chars(dig, 3, 3)}-{chars(dig, 4, 4)}", lambda: ".".join(str(int(rng.integers(256))) for _ in range(4)),
            lambda: f"{chars(low, 3, 8)}.{chars(dig, 2, 2)}@{chars(low, 4, 6)}.example.com", lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}",
            lambda: f"v{rng.integers(10)}.{rng.integers(20)}.{rng.integers(9)}", lambda: f"https://{chars(low, 4, 9)}.example.com/{chars(low, 2, 6)}/{chars(dig, 1, 5)}", lambda: f"{word()} = {word()}", lambda: f"{word()}: {chars(dig, 1, 6)}",
            lambda: grouped(hexes, 8, 4, 4, 4, 12), lambda: f"{pick(['id', 'uuid', 'request_id', 'trace', 'session_id', 'order'])}{pick(['=', ': ', ' '])}{grouped(hexes, 8, 4, 4, 4, 12)}", lambda: f"{pick(['commit', 'at', 'see', 'rev', 'hash'])} {chars(hexes, 7, 12)}",
            lambda: f"data:{pick(['image/png', 'image/gif', 'font/woff'])};base64,{chars(both + '+/', 40, 120)}", lambda: f"{pick(['sha256', 'sha1', 'md5', 'integrity', 'etag', 'checksum'])}{pick([':', '-', '=', ': '])}{chars(both + '+/', 22, 44)}",
            lambda: f"https://{chars(low, 4, 9)}.example.com/{chars(low, 3, 6)}?{chars(low, 1, 2)}={chars(both, 8, 34)}", lambda: f"{chars(up, 2, 4)}{pick(['-', ''])}{chars(dig, 3, 12)}", lambda: f"{chars(up, 2, 2)}{chars(dig, 18, 20)}", lambda: grouped(up + dig, 4, 4, 4),
            lambda: f"{word()}-{rng.integers(1, 20)}.{rng.integers(0, 30)}.{rng.integers(0, 9)}-{chars(low, 2, 4)}{rng.integers(9)}_{pick(['amd64', 'x86_64', 'arm64'])}.{pick(['deb', 'rpm', 'whl'])}", lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}Z",
            lambda: "#" + chars(hexes, 6, 6), lambda: ":".join(chars("0123456789ABCDEF", 2, 2) for _ in range(6)), lambda: f"{pick(['user', 'User', 'build', 'rev', 'build_id', 'page_id', 'tenant_id', 'serial'])}{pick([':', ' ', '_', '='])}{chars(both, 3, 9)}{chars(dig, 2, 4)}", lambda: f"{chars(low, 3, 8)}/{chars(low, 3, 8)}/{chars(hexes, 8, 12)}.{pick(['json', 'js', 'py', 'html'])}",
            lambda: f"{pick(sorted(_KEYS))}{pick([' = ', '=', ': ', ' == '])}{pick(['None', 'null', '********', 'get_token(user)', 'os.environ', 'confirm_password', 'self.value', 'true', 'required', '<hidden>', '${VALUE}', 'config.get', 'raw'])}", lambda: f"hash_{pick(sorted(_KEYS))}({word()})", lambda: "1Z" + chars(up + dig, 16, 16),
        ]
        if rng.random() < 0.25:  # addresses, the commonest of all
            part = "/".join(chars(low + dig, 1, 9) for _ in range(int(rng.integers(0, 4))))
            return f"{pick(['https', 'http', 'ftp'])}://{pick(['', 'www.', 'm.'])}{chars(low, 1, 9)}.{pick(['example.com', 'example.org', 'net', 'co.uk'])}{pick(['', '/', ':8080/'])}{part}"
        return pick(kinds)()

    def value():
        kind = int(rng.integers(11))
        return [
            chars(hexes, 12, 48), chars(both, 16, 40), chars(both + "+/", 24, 44), "AKIA" + chars(up + dig, 16, 16), pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + chars(both, 20, 36),
            "eyJ" + chars(both, 10, 30) + "." + chars(both, 10, 40) + pick(["", "." + chars(both, 8, 30)]), chars(low, 3, 6) + chars(dig, 2, 5) + chars(up + low, 2, 6) + chars(dig, 1, 3), chars("0123456789ABCDEF", 24, 40),
            chars(low, 3, 7) + chars(dig, 1, 2) + chars(low, 3, 7) + chars(dig, 1, 2), chars(up, 1, 1) + chars(low, 2, 6) + chars(dig, 1, 4) + pick(["-", "_", "."]) + chars(both, 4, 10) + pick(["", "-" + chars(both, 4, 6)]), grouped(both, 4, 4, 4, 4),
        ][kind]

    def marked():  # values that tell themselves
        return pick([lambda: "AKIA" + chars(up + dig, 16, 16), lambda: pick(["ghp_", "sk_live_", "glpat-", "npm_"]) + chars(both, 20, 36), lambda: "xoxb-" + chars(dig, 10, 12) + "-" + chars(both, 20, 28), lambda: chars(hexes, 32, 64), lambda: "AIza" + chars(both + "-_", 35, 35), lambda: "eyJ" + chars(both, 12, 30) + "." + chars(both, 12, 30) + "." + chars(both, 8, 30)])()

    out = []
    for _ in range(n):
        line = prose(int(rng.integers(2, 10)))
        r = rng.random()
        if r < 0.5:
            key = pick(sorted(_KEYS))
            key = key.upper() if rng.random() < 0.2 else key
            v = (value(), 1)
            line += pick([
                [(key, 0), ("=", 0), v], [(key, 0), (' = "', 0), v, ('"', 0)], [(key, 0), (": ", 0), v], [(f'"{key}": "', 0), v, ('"', 0)], [("export ", 0), (key, 0), ("=", 0), v],
                [("Authorization: Bearer ", 0), v], [(key, 0), (" is ", 0), v], [(key, 0), (" ", 0), v], [(f"{word().upper()}_{key.upper()}=", 0), v], [(marked(), 1)], [(marked(), 1)], [(f"X-{word()}-Key: ", 0), v],
                [(f"{word()}://{word()}:", 0), v, (f"@{word()}.example.com", 0)],
            ])
        elif r < 0.85:
            line.append((plain(), 0))
        elif r < 0.93:
            line += [(pick(sorted(_KEYS)), 0), (pick([" of ", " and ", ", ", ". ", " for the "]), 0)]
        out.append(line + prose(int(rng.integers(2, 10))))
    return out


def _tagged(line: list[tuple[str, int]]) -> tuple[str, list[int]]:
    text, spans = "", []
    for piece, secret in line:
        if text and not text[-1].isspace() and not secret and piece[:1].isalnum():
            text += " "
        if secret and text and text[-1].isalnum():
            text += " "
        spans.append((len(text), len(text) + len(piece), secret))
        text += piece
    tags = []
    for m in TOKEN.finditer(text):
        inside = next(((a, b) for a, b, s in spans if s and a <= m.start() < b), None)
        tags.append(OUT if inside is None else BEGIN if m.start() == inside[0] else IN)
    return text, tags


@lru_cache(2)
def trained(seed: int = 5, lines: int = 2000, rounds: int = 100) -> Field:
    """The field of greatest regularised likelihood on the made lines, by Adam on exact gradients."""
    made = [_tagged(x) for x in _lines(seed, lines)]
    codes, lens = encode([t for t, _ in made])
    n, width = len(made), int(lens.max())
    at = np.full((n, width), -1)
    doc, pos = np.repeat(np.arange(n), lens), np.concatenate([np.arange(k) for k in lens])
    at[doc, pos] = np.arange(len(codes))
    real = at >= 0
    gold = np.zeros((n, width), np.int64)
    gold[doc, pos] = np.concatenate([g for _, g in made])
    table = _codes.table[codes // N_CLASS].astype(np.float64)
    c = codes % N_CLASS
    near = []
    for shift in (1, 2, 3, -1):
        x = np.full(len(c), _NONE)
        if shift > 0:
            x[shift:] = np.where(doc[shift:] == doc[:-shift], c[:-shift], _NONE)
        else:
            x[:shift] = np.where(doc[:shift] == doc[-shift:], c[-shift:], _NONE)
        near.append(x)
    file = np.repeat(file_feature(c, lens), lens)
    rng = np.random.default_rng(seed)
    file = np.where(rng.random(n)[doc] < 0.5, np.minimum(file, 1), file)  # secrets also sit in long prose
    p = [np.zeros((N_SHAPE, 3)), np.zeros((4, N_CLASS, 3)), np.zeros((3, 3)), np.zeros((3, 3))]
    m, v = [0.0] * 4, [0.0] * 4
    ban = np.zeros((3, 3))
    ban[OUT, IN] = -1e9
    onehot = np.eye(3)[gold]
    for t in range(1, rounds + 1):
        flat = table @ p[0] + sum(p[1][k][near[k]] for k in range(4)) + p[2][file]
        e = np.zeros((n, width, 3))
        e[doc, pos] = flat
        e[:, 0, IN] = -1e9
        step = p[3] + ban
        alpha = np.zeros((n, width, 3))
        alpha[:, 0] = e[:, 0]
        for k in range(1, width):
            z = alpha[:, k - 1, :, None] + step
            top = z.max(1)
            a = e[:, k] + top + np.log(np.exp(z - top[:, None]).sum(1))
            alpha[:, k] = np.where(real[:, k, None], a, alpha[:, k - 1])
        beta = np.zeros((n, width, 3))
        pair = np.zeros((3, 3))
        total = np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1)) + alpha[:, -1].max(1)
        for k in range(width - 2, -1, -1):
            z = step + (e[:, k + 1] + beta[:, k + 1])[:, None, :]
            top = z.max(2)
            b = top + np.log(np.exp(z - top[:, :, None]).sum(2))
            beta[:, k] = np.where(real[:, k + 1, None], b, 0.0)
            joint = np.exp(alpha[:, k, :, None] + z - total[:, None, None])
            pair += joint[real[:, k + 1]].sum(0)
        marginal = np.exp(alpha + beta - total[:, None, None])
        diff = (marginal - onehot)[doc, pos]
        seen = np.zeros((3, 3))
        both = real[:, 1:]
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grads = [table.T @ diff, np.stack([np.stack([np.bincount(near[k], diff[:, s], N_CLASS) for s in range(3)], 1) for k in range(4)]), np.stack([np.bincount(file, diff[:, s], 3) for s in range(3)], 1), pair - seen]
        for i, g in enumerate(grads):
            g = g / n + 1e-4 * p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(*(x.astype(np.float32) for x in p))


# ---- the scan


def find_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans of each text as (start, kind, end): the base ones, and the field's that overlap none of them."""
    out = [base_spans(t) for t in texts]
    codes, lens = encode(texts)
    tags = field.tag(codes, lens)
    ends = np.cumsum(lens)
    for d in np.unique(np.searchsorted(ends, np.flatnonzero(tags == BEGIN), "right")).tolist():
        own = tags[ends[d] - lens[d] : ends[d]].tolist()
        added, base = [], list(out[d])
        for tag, m in zip(own, TOKEN.finditer(texts[d]), strict=True):
            if tag == BEGIN:
                added.append([m.start(), 3, m.end()])
            elif tag == IN:
                added[-1][2] = m.end()
        out[d] = sorted(base + [tuple(s) for s in added if not any(a < s[2] and s[0] < b for a, _, b in base)])
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, spans array<struct<start:long,kind:string,end:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id and spans (start, kind, end in code points, end exclusive; by start, then kind) for every row.

    Kinds are assign, access, hex and field. A null or empty text has no spans; repeated rows give repeated rows; a null
    id stays null; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        for b in sliced(batches):
            found = find_spans(texts_of(b), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"start": a, "kind": KINDS[k], "end": e} for a, k, e in s] for s in found], kind)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def scan_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what scan() gives."""

    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return spans.select("doc_id", *count, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", field: Field | None = None) -> DataFrame:
    """docs, all columns and rows, with every span of its text replaced by `mark`.

    A null text stays null, an empty one stays empty; repeated rows get equal texts; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def cleaned(raw: list) -> list:
        values, out = [t or "" for t in raw], []
        for t, was, spans in zip(values, raw, find_spans(values, shared.value), strict=True):
            parts, at = [], 0
            for a, _, b in spans:
                if b > at:
                    parts += [t[at : max(a, at)]] + [mark] * (a >= at)
                    at = b
            out.append("".join([*parts, t[at:]]) if spans else was)
        return out

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([t for k in in_slices(texts) for t in cleaned(texts[k].tolist())], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
