import datetime
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.conftest import prose, rng, table

from twinsift.llm import pii, queries

KEY = "a key"


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def card(r, n=16):
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, **options):
    rows = pii.pseudonymise(table(spark, enumerate(texts)), options.pop("key", KEY), **options).collect()
    return {r["doc_id"]: r for r in rows}


def test_values_keep_their_format(spark):
    r = rng(1)
    cards = [card(r, n) for n in (13, 15, 16, 19) for _ in range(20)]
    spaced = [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in (card(r) for _ in range(10))]
    dates = [str(datetime.date(1700, 1, 1) + datetime.timedelta(r.randrange(146_097))) for _ in range(40)]
    phones = [f"+1 ({r.randrange(1000):03}) {r.randrange(200, 1000)}-{r.randrange(10_000):04}" for _ in range(40)]
    ssns = [f"{r.choice([1, 5, 665, 667, 899]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10_000):04}" for _ in range(30)]
    ips = [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(30)]
    mails = [f"{''.join(r.choice('abzAZ019._%+-') for _ in range(r.randrange(1, 40)))}@mail{k}.example.com" for k in range(30)]
    values = cards + spaced + dates + phones + ssns + ips + mails
    got = run(spark, [f"before {v} after" for v in values])
    new = [got[i]["text"].removeprefix("before ").removesuffix(" after") for i in range(len(values))]
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    for old, v in zip(values, new, strict=True):
        if old in ips:
            assert all(0 <= int(x) <= 255 for x in v.split("."))
        else:
            assert shape(old) == shape(v)
        if old in cards + spaced:
            assert luhn(re.sub(" ", "", v))
        if old in dates:
            datetime.date.fromisoformat(v)
        if old in ssns:
            assert v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
        if old in phones:
            assert v[8] in "23456789"[:8] or int(v[9:12]) >= 200
    assert sum(a != b for a, b in zip(values, new, strict=True)) > 0.95 * len(values)
    kinds = (cards + spaced, dates, phones, ssns, ips, mails)
    for kind in kinds:  # different values stay different, equal ones equal
        pairs = {(a, b) for a, b in zip(values, new, strict=True) if a in kind}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_reversible(spark):
    r = rng(2)
    texts = [f"{prose(r, 5)} {card(r)} on 31.12.1999, 02/29/2000; 2024-02-29 call +1 (012) 555-0199 or (212) 555-0199, 123-45-6789 at 8.8.8.8 or a.B9@x.example.org" for _ in range(12)]
    there = run(spark, texts)
    back = run(spark, [there[i]["text"] for i in range(len(texts))], reverse=True)
    assert [back[i]["text"] for i in range(len(texts))] == texts
    assert all(tuple(there[i][f"n_{k}"] for k in pii.KINDS) == (1, 3, 1, 1, 2, 1) for i in range(len(texts)))
    assert run(spark, texts[:1], key="another")[0]["text"] != there[0]["text"]


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "2023-02-29", "31/31/2020", "000-12-3456", "666-12-3456", "256.1.1.1", "1.2.3.4.5", "0000000000000000", "a@b", "x4111111111111111", "no data at all", ""]
    got = run(spark, texts)
    assert [got[i]["text"] for i in range(len(texts))] == texts and not any(got[i][f"n_{k}"] for i in got for k in pii.KINDS)


def test_neighbours(spark):
    r = rng(3)
    a, b = card(r), card(r)
    got = run(spark, [f"{a} 27.65.93.188", f"+1 (269) 555-3296 {b}", f"{a},{b}.", f"x {a}\n{a} y"])
    assert [tuple(got[i][f"n_{k}"] for k in ("card", "phone", "ip")) for i in range(4)] == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 0, 0)]
    new = got[3]["text"].split()
    assert new[1] == new[2] != a and got[2]["text"].startswith(new[1])


def test_odd_rows(spark, odd, nothing):
    out = pii.pseudonymise(odd, KEY)
    assert [c for c in out.columns if not c.startswith("n_")] == odd.columns
    assert [r["text"] for r in out.collect()] == [r["text"] for r in odd.collect()]
    assert pii.pseudonymise(nothing, KEY).count() == 0 and pii.pseudonymise(odd, KEY, changed_only=True).count() == 0
    clash = table(spark, [(1, "8.8.8.8")]).withColumn("n_ip", F.lit("x")).withColumn("pseudonyms", F.lit(2))
    row = pii.pseudonymise(clash, KEY).first()
    assert (row["n_ip"], row["_n_ip"], row["n_card"], row["pseudonyms"]) == ("x", 1, 0, 2)


def test_no_python_in_the_plan(spark, odd):
    plan = pii.pseudonymise(odd, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


@pytest.mark.parametrize(("a", "b"), [(1, 1), (3, 5), (10, 7)])
def test_a_permutation(spark, a, b):
    df = spark.range(a * b).select(F.col("id"), pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), KEY, "t").alias("s"))
    rows = df.select("id", F.col("s.left").alias("l"), F.col("s.right").alias("r"), pii.feistel(F.col("s.left"), F.col("s.right"), F.lit(a), F.lit(b), KEY, "t", reverse=True).alias("u")).collect()
    assert {(r["l"], r["r"]) for r in rows} == {(x, y) for x in range(a) for y in range(b)}
    assert all(r["u"]["left"] * b + r["u"]["right"] == r["id"] for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.@+-() /ab", max_size=60), min_size=10, max_size=30))
def test_any_text_comes_back(spark, texts):
    there = run(spark, texts)
    assert all(len(re.sub(r"[0-9]", "", there[i]["text"])) == len(re.sub(r"[0-9]", "", t)) for i, t in enumerate(texts))


def test_the_query_gives_every_document(spark, tmp_path):
    rows = [(1, "write to ann@mail.example.com"), (2, "nothing here"), (3, "card 4111111111111112"), (4, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_pseudonyms(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["n_email"] == 1 and all(got[i]["text"] == t and sum(got[i][f"n_{k}"] for k in pii.KINDS) == 0 for i, t in rows[1:])


def test_long_runs_do_not_overflow(spark):
    """One text each that a pattern could follow for long: labels, blanks, signs, digits, and no end of a word."""
    texts = ["see a@" + "b." * 100_000 + "1", "see a@" + "b." * 100_000 + "com end", "%" * 1_000_000, "a" * 1_000_000, "1" * 300_000, "1.2." * 100_000, "a@" * 200_000, "a@b.co " * 3000, "2020-" * 100_000, "@." * 200_000, "(" * 300_000]
    got = run(spark, texts)
    assert [got[i]["n_email"] for i in range(len(texts))] == [0, 1, 0, 0, 0, 0, 0, 3000, 0, 0, 0]
    assert [len(got[i]["text"]) for i in range(len(texts))] == [len(t) for t in texts]


# ---- all of it once more in plain Python


def plain_feistel(left, right, a, b, kind):
    for r in range(pii.ROUNDS):
        f = int(hashlib.sha256(f"{KEY}|{kind}|{r}|{right if r % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f) % a, right) if r % 2 == 0 else (left, (right + f) % b)
    return left, right


def refilled(m, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in m)


def plain_date(m):
    parts = [int(x) for x in re.split("[-./]", m)]
    year, month, day = parts if m[4] == "-" else (parts[2], *((parts[1], parts[0]) if m[2] == "." else (parts[0], parts[1])))
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def plain_value(kind, m):
    """The pseudonym of a match, or None if it is not valid."""
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        if not luhn(d) or not d.strip("0"):
            return None
        n, h = len(d) - 1, (len(d) - 1) // 2
        x, y = plain_feistel(int(d[:h]), int(d[h:n]), 10**h, 10 ** (n - h), kind)
        body = f"{x:0{h}}{y:0{n - h}}"
        return refilled(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "date":
        if not (day := plain_date(m)):
            return None
        x, y = plain_feistel(*divmod((day - datetime.date(1700, 1, 1)).days, 773), 189, 773, kind)
        return (datetime.date(1700, 1, 1) + datetime.timedelta(x * 773 + y)).strftime("%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y")
    if kind == "ssn":
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x, y = plain_feistel((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, kind)
        area = x // 99 + 1
        return f"{area + (area >= 666):03}-{x % 99 + 1:02}-{y + 1:04}"
    if kind == "phone":
        area = int(d[-10:-7])
        first, n = (0, 200) if area < 200 else (200, 800)
        x, y = plain_feistel((area - first) * 800 + int(d[-7:-4]) - 200, int(d[-4:]), n * 800, 10_000, kind)
        return refilled(m, f"{d[:-10]}{x // 800 + first:03}{x % 800 + 200}{y:04}")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        x, y = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, kind)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    name, rest = m.split("@")
    sides = [name[: len(name) // 2], name[len(name) // 2 :]]
    for r in range(pii.ROUNDS):
        own, other = (0, 1) if r % 2 == 0 else (1, 0)
        digest = hashlib.sha256(f"{KEY}|email|{r}|{sides[other]}".encode()).hexdigest()
        moved = ""
        for i, c in enumerate(sides[own]):
            k = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)
            for first, size in ((97, 26), (65, 26), (48, 10)):
                if first <= ord(c) < first + size:
                    c = chr((ord(c) - first + k) % size + first)
                    break
            moved += c
        sides[own] = moved
    return "".join(sides) + "@" + rest


def plain(text):
    counts = {}
    for kind in pii.KINDS:
        counts[kind] = 0

        def new(m, kind=kind):
            value = plain_value(kind, m[0])
            counts[kind] += value is not None
            return m[0] if value is None else value

        text = re.sub(pii.PATTERNS[kind], new, text, flags=re.A)
    return text, counts


def test_against_a_plain_version(spark):
    r = rng(9)
    values = [
        lambda: card(r, r.choice([13, 15, 16, 19])), lambda: "".join(r.choice("0123456789") for _ in range(r.randrange(9, 21))), lambda: "-".join(re.findall("....", card(r))), lambda: f"{r.randrange(1690, 2110)}-{r.randrange(1, 14):02}-{r.randrange(1, 33):02}",
        lambda: f"{r.randrange(1, 33):02}.{r.randrange(1, 14):02}.{r.randrange(1690, 2110)}", lambda: f"{r.randrange(1, 14):02}/{r.randrange(1, 33):02}/{r.randrange(1690, 2110)}", lambda: f"{r.randrange(1000):03}-{r.randrange(100):02}-{r.randrange(10_000):04}",
        lambda: f"({r.randrange(1000):03}) {r.randrange(1000):03}-{r.randrange(10_000):04}", lambda: f"+1 {r.randrange(1000):03}.{r.randrange(1000):03}.{r.randrange(10_000):04}", lambda: ".".join(str(r.randrange(300)) for _ in range(r.choice([3, 4, 4, 4, 5]))),
        lambda: f"{''.join(r.choice('abXY09._%+-') for _ in range(r.choice([1, 2, 7, 40, 64, 65, 80])))}@{r.choice(['a.b', 'x.example.org', 'x..org', 'a.b.c1', 'mail.example.com2', '-', 'a.co.', 'b.com.1'])}",
    ]
    texts = ["".join(f"{r.choice(['', ' ', ', ', ' on ', '(', 'x', '-', '.'])}{r.choice(values)()}" for _ in range(r.randrange(1, 7))) for _ in range(500)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        text, counts = plain(t)
        assert (got[i]["text"], {k: got[i][f"n_{k}"] for k in pii.KINDS}) == (text, counts), t
    assert min(sum(got[i][f"n_{k}"] for i in range(len(texts))) for k in pii.KINDS) > 5
