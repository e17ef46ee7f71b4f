"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass validation are permuted under a key within their format: a card number becomes another that
passes the Luhn check, a date another date of the same notation, a phone number, social security number or internet
address another valid one; the name in a mail address keeps its length and the kind of each character. Each permutation
is a Feistel network over a product of two ranges, so equal values stay equal across documents, different values stay
different, and the key's holder can reverse it (`reverse=True`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import unused

ROUNDS = 8
KINDS = ("email", "date", "card", "ssn", "phone", "ip")

# Fixed patterns, as Java regular expressions. None repeats a group without bound: the engine would call itself for each
# turn, and a text of a few kilobytes would overflow its stack. A name and a domain are runs of one character class each.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "date": r"(?<![\w.-])(?:(?:1[789]|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:1[789]|20)\d\d|\d\d/\d\d/(?:1[789]|20)\d\d)(?![\w-]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-]|\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d\d-\d{4}(?![\w-]|\.\d)",
    "phone": r"(?<![\w.-])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])|\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-]|\.\d)",
    "ip": rf"(?<![\w.-])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w-]|\.\d)",
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digest(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")).cast("binary"), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """A keyed permutation of pairs below (a, b): struct(left, right). a and b are at most 10**10."""

    def turn(s, r):
        even = r % 2 == 0
        other = F.when(even, s["right"]).otherwise(s["left"])
        f = F.conv(F.substring(_digest(key, kind, r, other), 1, 15), 16, 10).cast("long")
        step = -f if reverse else f
        return F.struct(F.when(even, F.pmod(s["left"] + step % a, a)).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(F.pmod(s["right"] + step % b, b)).alias("right"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), turn)


def _padded(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one by one, by these."""

    def at(i):
        c = F.substring(m, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


# ---- cards


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last digit counts once."""

    def value(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))


def _card_ok(m: Column) -> Column:
    return _let(_digits(m), lambda d: (luhn_sum(d) % 10 == 0) & (F.regexp_replace(d, "0", "") != ""))


def _card(m: Column, key: str, reverse: bool) -> Column:
    def permuted(d):
        n = F.length(d) - 1
        h = F.floor(n / 2).cast("int")

        def joined(s):
            body = F.concat(_padded(s["left"], h), _padded(s["right"], n - h))
            return _let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

        return _let(feistel(F.substring(d, F.lit(1), h), F.substring(d, h + 1, n - h), _power(h), _power(n - h), key, "card", reverse), joined)

    return _refill(m, _let(_digits(m), permuted))


# ---- dates: days of the 400 years from 1700, which are 189 * 773

_FIRST = "1700-01-01"


def _date_of(m: Column) -> Column:
    iso = F.when(F.substring(m, 5, 1) == "-", m).when(F.substring(m, 3, 1) == ".", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    iso = iso.otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    return iso.try_cast("date")


def _date_ok(m: Column) -> Column:
    return _date_of(m).isNotNull()


def _date(m: Column, key: str, reverse: bool) -> Column:
    day = F.datediff(_date_of(m), F.lit(_FIRST).cast("date"))

    def written(s):
        day = F.date_add(F.lit(_FIRST).cast("date"), (s["left"] * 773 + s["right"]).cast("int"))
        return F.when(F.substring(m, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))

    return _let(_let(day, lambda d: feistel(F.floor(d / 773), d % 773, F.lit(189), F.lit(773), key, "date", reverse)), written)


# ---- phones (area and exchange 200 to 999; after +1, other areas go to other areas), social security numbers, addresses


def _phone(m: Column, key: str, reverse: bool) -> Column:
    def permuted(d):
        area = F.substring(d, -10, 3).cast("long")
        first, n = F.when(area < 200, 0).otherwise(200), F.when(area < 200, 200).otherwise(800)
        s = feistel((area - first) * 800 + F.substring(d, -7, 3).cast("long") - 200, F.substring(d, -4, 4), n * 800, F.lit(10_000), key, "phone", reverse)
        head = F.substring(d, F.lit(1), F.length(d) - 10)
        return _let(s, lambda s: F.concat(head, _padded(F.floor(s["left"] / 800) + first, 3), (s["left"] % 800 + 200).cast("string"), _padded(s["right"], 4)))

    return _refill(m, _let(_digits(m), permuted))


def _ssn_ok(m: Column) -> Column:
    area = F.substring(m, 1, 3)
    return (area != "000") & (area != "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(m, 5, 2).cast("long") - 1

    def written(s):
        a = F.floor(s["left"] / 99) + 1
        return F.concat_ws("-", _padded(F.when(a >= 666, a + 1).otherwise(a), 3), _padded(s["left"] % 99 + 1, 2), _padded(s["right"] + 1, 4))

    return _let(feistel(left, F.substring(m, 8, 4).cast("long") - 1, F.lit(898 * 99), F.lit(9_999), key, "ssn", reverse), written)


def _ip(m: Column, key: str, reverse: bool) -> Column:
    def permuted(o):
        n = [F.element_at(o, i).cast("long") for i in (1, 2, 3, 4)]
        s = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65_536), F.lit(65_536), key, "ip", reverse)
        return _let(s, lambda s: F.concat_ws(".", F.floor(s["left"] / 256).cast("string"), (s["left"] % 256).cast("string"), F.floor(s["right"] / 256).cast("string"), (s["right"] % 256).cast("string")))

    return _let(F.split(m, r"\."), permuted)


# ---- names in mail addresses


def _shift(text: Column, amounts: Column, reverse: bool) -> Column:
    """Each character moved within its kind by two hexadecimal digits of `amounts`, which are used again after 32 characters."""

    def at(i):
        c = F.substring(text, i, F.lit(1))
        k = F.conv(F.substring(amounts, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        k = -k if reverse else k

        def within(first, n):
            return F.chr((F.pmod(F.ascii(c) - first + k, F.lit(n)) + first).cast("long"))

        return F.when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).when(c.between("0", "9"), within(48, 10)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), at), ""))


def _email(m: Column, key: str, reverse: bool) -> Column:
    name, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    h = F.floor(F.length(name) / 2).cast("int")

    def turn(s, r):
        even = r % 2 == 0
        other, own = F.when(even, s["right"]).otherwise(s["left"]), F.when(even, s["left"]).otherwise(s["right"])
        moved = _let(_digest(key, "email", r, other), lambda d: _shift(own, d, reverse))
        return _let(moved, lambda x: F.struct(F.when(even, x).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(x).alias("right")))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.substring(name, F.lit(1), h).alias("left"), F.substring(name, h + 1, F.length(name)).alias("right"))
    return F.concat(_let(F.aggregate(order, start, turn), lambda s: F.concat(s["left"], s["right"])), rest)


_VALID = {"date": _date_ok, "card": _card_ok, "ssn": _ssn_ok}
_PERMUTE = {"email": _email, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip}


def _valid(kind: str, m: Column) -> Column:
    return _VALID[kind](m) if kind in _VALID else F.lit(True)


def _step(s: Column, kind: str, key: str, reverse: bool) -> Column:
    """The state (text and counts) after the values of one kind are replaced."""
    pattern = F.lit(PATTERNS[kind])

    def new(m):
        return F.when(_valid(kind, m), _PERMUTE[kind](m, key, reverse)).otherwise(m)

    def joined(found):
        parts = F.split(s["text"], pattern, -1)
        return _let(parts, lambda p: F.concat(F.element_at(p, 1), F.array_join(F.zip_with(found, F.slice(p, 2, F.size(found)), lambda m, after: F.concat(new(m), after)), "")))

    def after(found):
        n = F.size(F.filter(found, lambda m: _valid(kind, m)))
        counts = [n.cast("long").alias(f"n_{k}") if k == kind else s[f"n_{k}"].alias(f"n_{k}") for k in KINDS]
        return F.struct(F.when(n > 0, joined(found)).otherwise(s["text"]).alias("text"), *counts)

    return _let(F.regexp_extract_all(s["text"], pattern, F.lit(0)), after)


def pseudonyms(text: Column, key: str, reverse: bool = False) -> Column:
    """struct(text, n_email, ...) of a text that is not null."""
    state = F.struct(text.alias("text"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    for kind in KINDS if not reverse else KINDS[::-1]:
        state = _chain(state, kind, key, reverse)
    return state


def _chain(state: Column, kind: str, key: str, reverse: bool) -> Column:
    return _let(state, lambda s: _step(s, kind, key, reverse))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False, changed_only: bool = False) -> DataFrame:
    """docs, all columns, with pseudonyms in its text, and n_<kind>: how many values of each kind were replaced.

    Kinds are email, date, card, ssn, phone and ip, replaced in this order. Values that fail validation stay. All rows
    are given, or those with a replaced value (changed_only). A null text stays null with counts of 0, an empty one stays
    empty; repeated rows get equal texts; an empty table gives no rows; a column of docs named n_<kind> is kept, and the
    count is then called _n_<kind>.
    """
    text = F.col(text_col).cast("string")
    counts = [f"n_{k}" for k in KINDS]
    shown = unused(docs.columns, *counts)
    (held,) = unused(docs.columns, "pseudonyms")
    done = F.when(text.isNotNull(), pseudonyms(text, key, reverse)).otherwise(F.struct(F.lit(None).cast("string").alias("text"), *[F.lit(0).cast("long").alias(c) for c in counts]))
    kept = F.array(done)
    if changed_only:  # inside the array, so that no filter works the pseudonyms out again
        kept = F.filter(kept, lambda s: sum((s[c] for c in counts[1:]), s[counts[0]]) > 0)
    out = docs.select("*", F.explode(kept).alias(held))
    return out.select(*[F.col(f"{held}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns], *[F.col(f"{held}.{c}").alias(n) for c, n in zip(counts, shown, strict=True)])
