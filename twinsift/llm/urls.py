"""URL filters: host and path rules, then word segmentation and naive Bayes for urls no rule fits.

Word counts come from the visible text of all pages; a page's own host doesn't count there, so that a joined name is no
word because its pages say it, but a part that several hosts share (www, a registry) is one. A host's letter runs are cut
into words by unigram Viterbi: the substrings of each distinct run are joined with the counts, so neither table is sent
to every task, and a run is cut in one row. A word that no text has costs more the longer it is, and scraps of one or two
letters cost as much as a word more, so an unknown name stays whole. A multinomial naive Bayes model scores the words of
the host and of the path, but for the parts that the rules themselves look at (the labels they name, and the leading parts
of a path): else it would say what the rules say. It is learned from example names and, with less weight, from the hosts
that rules decide, each once for a verdict, held-out rows aside. Its counts are kept in hashed columns of a fixed number.
Words it has not seen say nothing, and it blocks where blocking is four times as likely as allowing.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm._util import forget, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 63  # letters of a host label, and so of a word in it
SHARED = 3  # hosts that have a part which then is a word
SCRAP = 3  # letters of the shortest word that is no scrap
BUCKETS = 1 << 18  # hashed columns of the model
TOLD = 20  # hosts that an example name counts as
SURE = math.log(4)  # log odds from which the method blocks

#: The rules of the registered query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Names with a known verdict, in words, that the model is told besides the urls that rules decide.
EXAMPLES = [
    *((x, "block") for x in (
        "cheap pills", "spam farm", "casino bonus", "online poker slots", "adult cams", "porn videos xxx", "viagra cialis pharmacy discount", "payday loans fast cash", "replica watches outlet",
        "crack keygen warez", "torrent pirate downloads", "lottery winner prize", "hot singles dating", "verify account login phishing", "malware trojan virus", "betting odds sportsbook",
        "miracle weight loss diet", "cheats hack generator", "escort girls", "clickbait ads popups", "cheap casino pills", "free spam links", "link farm seo backlinks", "buy followers likes",
    )),
    *((x, "allow") for x in (
        "daily news", "travel blog", "developer docs reference", "public wiki", "library archive", "university research", "science journal", "open source code", "museum history", "city weather",
        "school learning", "book reviews", "cooking recipes", "music art", "photo gallery", "support help", "community forum", "garden guide", "health clinic", "language dictionary",
        "maps transport", "farm market", "legal advice", "film club",
    )),
]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z]+"), lambda w: w != "")


def visible_text(html: Column) -> Column:
    """A page without its tags, scripts and styles. One that is not closed goes on to the end, so that each character is looked at once or twice."""
    scripts = r"(?is)<(script|style)\b(?:.*?</\1\s*>|.*)"
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), scripts, " "), r"<[^<>]*>", " ")


def word_counts(pages: DataFrame, html_col: str = "html", own: Column | None = None) -> DataFrame:
    """word and n over the visible text of all pages; tags, scripts and styles don't count, nor does a page's own name (`own`, an array of words)."""
    text = visible_text(F.col(html_col).cast("string"))
    words = words_of(text)
    if own is not None:  # `own` is worked out once a page, not once a word
        words = F.element_at(F.transform(F.array(own), lambda o: F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z]+"), lambda w: ~F.array_contains(o, w) & (w != ""))), 1)
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(run: str, costs: dict[str, float], total: float) -> list[str]:
    """The cheapest cut of a run into words; of equals, the one with the longest last word.

    A known word costs what `costs` has, an unknown one what `unknown_cost` gives, and a scrap that isn't the whole run
    log(total) more, where `total` is the number of words that were counted.
    """
    best, cut = [0.0], [0]
    for j in range(1, len(run) + 1):
        options = []
        for i in range(max(0, j - LONGEST), j):
            w = run[i:j]
            scrap = math.log(total) if len(w) < SCRAP and len(w) < len(run) else 0.0
            options.append((best[i] + (costs[w] if w in costs else unknown_cost(len(w), total)) + scrap, i))
        cost, i = min(options)
        best.append(cost)
        cut.append(i)
    out, j = [], len(run)
    while j:
        out.append(run[cut[j] : j])
        j = cut[j]
    return out[::-1]


def unknown_cost(letters: int, total: float) -> float:
    """What a word that was not counted costs: as one of a tenth of a count, and ten times less likely with each letter."""
    return math.log(10 * total) + (letters - 1) * math.log(10)


def bucket_of(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


class NaiveBayes:
    """Multinomial over hashed words, with add-one smoothing; a score is the log odds of block. An example counts as `told` hosts."""

    def __init__(self, examples: list[tuple[str, str]] = (), buckets: int = BUCKETS, told: int = 1):
        self.buckets = buckets
        self.counts = np.zeros((2, buckets), np.int64)  # block, allow
        self.names = np.zeros(2, np.int64)
        for text, verdict in examples:
            words = re.findall("[a-z]+", text.lower())
            at = [xxhash.xxh64_intdigest(w.encode(), 42) % buckets for w in words]  # buckets is a power of two: as bucket_of()
            np.add.at(self.counts[int(verdict == "allow")], at, told)
            self.names[int(verdict == "allow")] += told
        self.settle()

    def learn(self, rows: DataFrame) -> None:
        """Adds the words of rows(verdict, host, buckets array<int>), each once for a host and verdict: sums of a fixed number of columns."""
        names = {r["verdict"]: r["n"] for r in rows.select("verdict", "host").distinct().groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        once = rows.select("verdict", "host", F.explode("buckets").alias("bucket")).distinct()
        table = once.groupBy("bucket").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("block", "allow")]).toArrow()
        for k, v in enumerate(("block", "allow")):
            self.counts[k, table["bucket"].to_numpy()] += table[v].to_numpy()
            self.names[k] += names.get(v, 0)
        self.settle()

    def settle(self) -> None:
        seen = self.counts.any(0)
        log = np.log((self.counts + 1) / (self.counts.sum(1, keepdims=True) + max(1, np.count_nonzero(seen))))
        self.weights = np.where(seen, log[0] - log[1], 0.0)
        self.prior = float(np.log((self.names[0] + 1) / (self.names[1] + 1)))

    def summed(self, buckets: pa.Array) -> pa.Array:
        """The sum of the weights of each row's words; of none, 0."""
        ends = np.append(0, np.cumsum(self.weights[buckets.flatten().to_numpy()]))
        at = buckets.offsets.to_numpy() - buckets.offsets[0].as_py()
        return pa.array(ends[at[1:]] - ends[at[:-1]])

    def column(self, tokens: Column) -> Column:
        """The sum of the weights of an array of words."""

        @F.arrow_udf("double")
        def total(b: pa.Array) -> pa.Array:
            return self.summed(b)

        return total(F.transform(tokens, lambda w: bucket_of(w, self.buckets)))


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """runs(run string, distinct) -> run, words: each run cut into the likeliest words of counts(word, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length("run") - i + 1, F.lit(LONGEST))), lambda k: F.substring(F.col("run"), i, k)))
    parts = runs.filter("run <> ''").select("run", F.explode(F.array_distinct(F.flatten(starts))).alias("word"))
    known = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # at most LONGEST words a letter

    def cut(batches):
        for b in batches:
            out = [viterbi(r, {k["word"]: math.log(total / k["n"]) for k in known or ()}, total) for r, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return runs.filter("run <> ''").join(known, "run", "left").select("run", "known").mapInArrow(cut, "run string, words array<string>")


def is_held_out(id_col: str = "page_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def subject_words(path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The words of a path but for its leading parts, as many as the longest rule's path has."""
    deep = max((len([x for x in p.split("/") if x]) for _, p, _ in rules), default=0)
    return words_of(F.array_join(F.slice(F.split(path, "/"), deep + 2, 1 << 20), "/")) if deep else words_of(path)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, examples: list[tuple[str, str]] = EXAMPLES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, words (of the host), score, method and held_out for every row.

    The longest rule that fits decides; where none fits, the method's verdict stands: a score above log 4 blocks. `method`
    is its verdict for every row, so it can be seen what it makes of urls that a rule decides. It learns from the hosts
    of rows that a rule decides and that are not held out (crc32 of the id as text, modulo 4, is 2). A null url or one without :// has an empty host and path
    and no words. Repeated rows are judged each, a null id stays null and is not held out, an empty table gives no rows,
    other columns are not read.
    """
    url = F.col(url_col).cast("string")
    hosts_of = pages.select(host_of(url).alias("host")).distinct().select("host", F.split("host", "[^a-z]+").alias("runs"))
    placed = hosts_of.select("host", F.posexplode("runs").alias("at", "run")).filter("run <> ''")
    shared = placed.select("host", "run").distinct().groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED)
    told = pages.sparkSession.createDataFrame([(w,) for w in sorted({w for x, _ in examples for w in re.findall("[a-z]+", x.lower())})], "word string").withColumn("n", F.lit(1).cast("long"))
    counts = word_counts(pages, html_col, F.split(host_of(url), "[^a-z]+")).unionByName(shared).unionByName(told)
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "counts")

    cut = segment(placed.select("run").distinct(), counts)
    words = placed.join(cut, "run").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))  # a host's parts are few
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("held_out", is_held_out())
    named = sorted({x for h, _, _ in rules for x in re.findall("[a-z]+", h.lower())})  # labels that rules name say what rules say
    words = words.withColumn("host_buckets", F.transform(F.filter("words", lambda w: ~w.isin(*named)) if named else F.col("words"), lambda w: bucket_of(w)))
    none = F.array().cast("array<int>")
    rows = rows.join(words, "host", "left").withColumn("buckets", F.concat(F.coalesce("host_buckets", none), F.transform(subject_words(F.col("path"), rules), lambda w: bucket_of(w))))
    rows = materialise(rows.drop("host_buckets"), "urls")
    forget(counts)

    model = NaiveBayes(examples, told=TOLD)
    model.learn(rows.filter("ruled is not null and not held_out").select(F.col("ruled").alias("verdict"), "host", "buckets"))
    model.counts = None  # the weights alone go to the tasks
    told = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(b: pa.Array) -> pa.Array:
        return told.value.summed(b)

    scored = rows.withColumn("score", F.lit(model.prior) + score("buckets"))
    scored = scored.withColumn("method", F.when(F.col("score") > SURE, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), "score", "method", "held_out")


def held_out_accuracy(judged: DataFrame) -> DataFrame:
    """One row: rows that a rule decides and the model did not learn, and the share of them on which the method agrees, overall and of those to block and to allow."""
    right = F.when(F.col("method") == F.col("verdict"), 1.0).otherwise(0.0)
    by = [F.avg(F.when(F.col("verdict") == v, right)).alias(v) for v in ("block", "allow")]
    return judged.filter("held_out and rule is not null").agg(F.count("*").alias("rows"), F.avg(right).alias("accuracy"), *by)
