import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm.conftest import odd_rows, prose, rng, table

from twinsift.llm import fingerprints as P
from twinsift.llm import queries


def plain(text, n=5, fraction=0.125):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return []
    h = {hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - n + 1))}
    return sorted(x for x in h if x < P.threshold(fraction)) or [min(h)]


def likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain(t), plain(edited), plain(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_against_a_plain_version(spark):
    r = rng(3)
    rows = [(r.randrange(10**6), prose(r, r.randrange(0, 300))) for _ in range(60)] + odd_rows() + [(5, "É ÄB\x0bC  d"), (5, "É ÄB\x0bC  d")]
    assert sorted((tuple(x) for x in P.edit_digest(table(spark, rows)).collect()), key=repr) == digest(rows)


@pytest.mark.parametrize("rows", [[(1, "only one row here")], [(1, "a b"), (2, None)], [(None, "x"), (None, "y")]])
def test_few_rows(spark, rows):
    assert sorted((tuple(x) for x in P.edit_digest(table(spark, rows)).collect()), key=repr) == digest(rows)


def test_no_rows_and_other_columns(spark, odd, nothing):
    assert P.edit_digest(nothing).count() == 0
    assert P.edit_digest(odd).count() == odd.count() and P.fingerprints(odd).columns == [*odd.columns, "sketch"]


def test_no_python_in_the_plan(spark, odd):
    plan = P.edit_digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


def test_merging_and_containment(spark):
    r = rng(4)
    small, other = prose(r, 400), prose(r, 4000)
    df = spark.createDataFrame([(small, f"{other} {small}", other)], "a string, b string, c string").select(*[P.sketch(F.col(c)).alias(c) for c in "abc"])
    row = df.select(P.containment(F.col("a"), F.col("b")).alias("in_b"), P.containment(F.col("a"), F.col("c")).alias("in_c"), (P.merge(F.col("a"), F.col("c"))).alias("m"), "a", "b", "c").first()
    assert row["in_b"] == 1.0 and row["in_c"] < 0.1 and row["m"] == sorted({*row["a"], *row["c"]})
    assert abs(likeness(row["a"], row["b"]) - 400 / 4400) < 0.05


def test_ranges(spark):
    cuts = [-5, 0, 7, 7000, 2**40]
    values = [None, -(2**60), -6, -5, -1, 0, 6, 7, 8, 2**40, 2**60]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", P.range_of(F.col("v"), cuts).alias("r")).collect()
    assert {r["v"]: r["r"] for r in got} == {v: 0 if v is None else sum(c <= v for c in cuts) for v in values}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op10_fingerprints(spark, DATA)
    want = con.sql(P.oracle())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_containment_of_very_unequal_texts(spark):
    """The estimate against the share of five-word shingles itself, over 80 pairs of a text and one ten to forty times as long."""
    r, rows, want = rng(50), [], {}
    for k in range(80):
        short = prose(r, 400).split()
        part = short[: r.randrange(0, 401)]
        at, long = r.randrange(4000), prose(r, r.randrange(4000, 16_000)).split()
        long[at:at] = part
        sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(len(t) - 4)} for t in (short, long)]
        want[k] = len(sets[0] & sets[1]) / len(sets[0])
        rows.append((k, " ".join(short), " ".join(long)))
    df = spark.createDataFrame(rows, "k long, a string, b string").select("k", P.containment(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("c"))
    off = [x["c"] - want[x["k"]] for x in df.collect()]
    assert abs(sum(off)) / len(off) < 0.02 and sum(map(abs, off)) / len(off) < 0.05 and max(map(abs, off)) < 0.25
