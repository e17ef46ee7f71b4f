"""Document fingerprints: a threshold-scaled sketch, in DataFrame functions alone.

A text's shingles are its runs of five words; the sketch retains every shingle hash (the first 64 bits of its MD5) below
a fixed fraction of the range. Sketches merge by union, and their sizes estimate likeness (shared over all) and
containment (shared over own) of texts of very unequal sizes. A text with words but no hash below the threshold retains
its smallest, so that short texts can be told apart; a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.llm._util import id_and_text

_BLANKS = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = 16  # hexadecimal digits of a hash


def threshold(fraction: float) -> str:
    """The first hash that is not retained, in hexadecimal."""
    top = round(fraction * 16**DIGITS)
    if not 0 < top < 16**DIGITS:
        raise ValueError("the fraction must lie between 0 and 1")
    return f"{top:0{DIGITS}x}"


def sketch(text: Column, n: int = 5, fraction: float = 0.125) -> Column:
    """The sorted retained hashes of a text (array of strings); a null text is an empty one."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BLANKS), lambda w: w != "")
    below = threshold(fraction)

    def hashes(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, n), " ").cast("binary")), 1, DIGITS))

    def kept(h):
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < below)))
        return F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(h)))

    def once(value, then):  # the value is worked out once, however often `then` uses it
        return F.element_at(F.transform(F.array(value), then), 1)

    empty = F.array().cast("array<string>")
    return once(words, lambda w: F.when(F.size(w) == 0, empty).otherwise(once(hashes(w), kept)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts together, as long as neither was too short for the threshold."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes, 0 to 1; two empty sketches are alike."""
    all_of = F.size(F.array_union(a, b))
    return F.when(all_of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / all_of.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has, 0 to 1; an empty sketch is in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a).cast("double"))


def fingerprint_text(s: Column) -> Column:
    return F.array_join(s, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, fraction: float = 0.125) -> DataFrame:
    """docs, all rows and columns, with the column `sketch`; repeated rows have equal sketches."""
    return docs.withColumn("sketch", sketch(F.col(text_col).cast("string"), n, fraction))


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the value (null: none), by bisection."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts).cast("array<bigint>")

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.element_at(bounds, F.least(mid + 1, F.lit(len(cuts)))) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, fraction: float = 0.125) -> DataFrame:
    """doc_id, text and sketch of each row, and next_text and next_sketch of the next by ascending id (after the last: the first).

    Null ids come first and equal ids are ordered by text; a null text is an empty one. Rows are dealt out once, by
    ranges of the id between quantiles, so no task sorts them all; the first text of a range also stands, marked, at the
    end of the range before it. An empty table gives no rows; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (quantiles,) = rows.approxQuantile(["doc_id"], [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else ([],)
    rows = rows.withColumn("range", range_of(F.col("doc_id"), sorted({int(q) for q in quantiles})))
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("first"))
    turn = W.orderBy("range")  # one row a range
    before = F.coalesce(F.lag("range").over(turn), F.max("range").over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ends = firsts.select(F.lit(None).cast("long").alias("doc_id"), F.col("first.text").alias("text"), before.alias("range"), F.lit(1).alias("end"))
    by = W.partitionBy("range").orderBy("end", F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.withColumn("end", F.lit(0)).unionByName(ends).withColumn("next_text", F.lead("text").over(by))
    placed = placed.withColumn("sketch", sketch(F.col("text"), n, fraction)).withColumn("next_sketch", F.lead("sketch").over(by))
    return placed.filter("end = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edit_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, fraction: float = 0.125) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document's.
    """
    rows = with_next(docs, id_col, text_col, n, fraction).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), n, fraction).alias("other"), "next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("sketch")).alias("fingerprint"), fingerprint_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("other")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def oracle(n: int = 5, fraction: float = 0.125) -> str:
    """DuckDB SQL for edit_digest() over the table documents."""
    words = f"list_filter(string_split_regex(translate(t, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hashes = f"list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: substring(md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')), 1, {DIGITS}))"
    low = f"list_distinct(list_filter(h, lambda x: x < '{threshold(fraction)}'))"
    return f"""
    WITH placed AS (
      SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER o, first_value(text) OVER o, '') AS next_text
      FROM documents WINDOW o AS (ORDER BY doc_id NULLS FIRST, text)
    ), cut AS (SELECT *, CAST(length(text) AS BIGINT) AS n_chars, length(text) // 4 AS k FROM placed),
    edited AS (SELECT *, substring(text, 1, n_chars - k) || substring(next_text, 1, k) AS edited FROM cut),
    texts AS (SELECT DISTINCT t FROM (SELECT text AS t FROM edited UNION ALL SELECT edited FROM edited)),
    words AS (SELECT t, {words} AS w FROM texts),
    hashes AS (SELECT t, w, CASE WHEN len(w) = 0 THEN [] ELSE {hashes} END AS h FROM words),
    low AS (SELECT t, w, h, {low} AS low FROM hashes),
    kept AS (SELECT t, CASE WHEN len(w) = 0 THEN [] WHEN len(low) > 0 THEN list_sort(low) ELSE [list_min(h)] END AS s FROM low),
    three AS (
      SELECT e.doc_id, e.n_chars, e.edited, a.s AS a, b.s AS b, c.s AS c
      FROM edited e JOIN kept a ON a.t = e.text JOIN kept b ON b.t = e.edited JOIN kept c ON c.t = e.next_text
    )
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
      CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS near_edited,
      CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c)))::DOUBLE END AS near_next
    FROM three
    """
