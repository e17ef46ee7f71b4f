import math
import os
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from twinsift.llm import urls


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/1?x=/fr/#a", "https://example.com/en/", "https://example.com/en", "http://a.www.example.com/en/x", "http://xexample.com/en/",
    "http://b.example.net/es/?q", "http://b.example.net/fr#/", "http://net/fr/", "ftp://É.ÄB.com/x", "http://a.b://c/d", "x\ny://h.com/\np?q", "http://u:p@h.com:80/a", "http://spam-farm.example.org/en/1", "http://cheappills.org/buy",
    "http://university.library.org/research", "http://h.org?x", "http://h.org#x", "http://" + "long" * 300 + ".org/",
]


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, words string")
    return urls.filter_urls(df).collect()


def test_rules_and_method(spark):
    got = {r["page_id"]: r for r in run(spark, [(i, u, "<p>some words of the text</p>") for i, u in enumerate(URLS)])}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u, urls.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or got[i]["method"]) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    say = {u: got[i]["verdict"] for i, u in enumerate(URLS)}
    assert say["http://spam-farm.example.org/en/1"] == say["http://cheappills.org/buy"] == "block" and say["http://university.library.org/research"] == "allow"


def test_odd_tables(spark):
    assert run(spark, []) == []
    rows = run(spark, [(None, None, None), (1, "http://a.org/", None), (1, "http://a.org/", "")])
    assert sorted(r["host"] for r in rows) == ["", "a.org", "a.org"] and {r["verdict"] for r in rows} == {"allow"}


def cheapest(run, cost):
    if not run:
        return 0.0
    return min(cost(run[:k]) + cheapest(run[k:], cost) for k in range(1, len(run) + 1))


def test_viterbi_is_the_cheapest():
    costs, total = {"ab": 2.0, "abc": 3.5, "c": 1.0, "cab": 2.5, "a": 2.2, "bca": 4.0}, 50
    for n in range(1, 8):
        for k in range(3**n):
            word = "".join("abc"[k // 3**i % 3] for i in range(n))
            cost = lambda w, n=n: (costs[w] if w in costs else urls.unknown_cost(len(w), total)) + (math.log(total) if len(w) < min(3, n) else 0)
            cut = urls.viterbi(word, costs, total)
            assert "".join(cut) == word and abs(sum(map(cost, cut)) - cheapest(word, cost)) < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_joined_names(spark):
    """Names joined from words that the pages' texts have, none of which is told by the examples."""
    counts = urls.word_counts(spark.read.parquet(f"{DATA}/pages.parquet"))
    told = {w for x, _ in urls.EXAMPLES for w in x.split()}
    words = sorted(r["word"] for r in counts.filter("n >= 3 and length(word) >= 4").collect() if r["word"] not in told)
    r = random.Random(9)
    names = {"".join(parts): parts for parts in (r.sample(words, r.choice([2, 2, 3])) for _ in range(300))}
    cut = {x["run"]: x["words"] for x in urls.segment(spark.createDataFrame([(n,) for n in names], "run string"), counts).collect()}
    assert len(names) >= 200 and sum(cut[n] == p for n, p in names.items()) >= 0.9 * len(names)


def test_real_names_and_unknown_ones(spark):
    text = "free bets on cheap casino pills are no bargain: the house of cards may win a track, to be is to be, it's a c or a k " * 3
    counts = urls.word_counts(spark.createDataFrame([(text,)], "html string").withColumn("html", F.regexp_replace("html", "bets|win|track", "")))
    names = ["freebets", "cheapcasinopills", "houseofcards", "bets", "win", "track", "tobe"]
    cut = {x["run"]: x["words"] for x in urls.segment(spark.createDataFrame([(n,) for n in names], "run string"), counts).collect()}
    assert cut == {"freebets": ["free", "bets"], "cheapcasinopills": ["cheap", "casino", "pills"], "houseofcards": ["house", "of", "cards"], "bets": ["bets"], "win": ["win"], "track": ["track"], "tobe": ["tobe"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_subjects_not_languages(spark):
    """The method finds the spam hosts without their rules, and blocks hosts for no language or registry."""
    judged = urls.filter_urls(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet")).select("host", "path", "rule", "method").collect()
    spam = re.compile("casino-win|free-bets|cheap-pills|spam-farm|ads-track|adult-x")
    assert {x["method"] for x in judged if spam.search(x["host"])} == {"block"}
    rest = [x for x in judged if not spam.search(x["host"])]
    for key in (lambda x: x["path"].split("/")[1], lambda x: x["host"].rpartition(".")[2]):
        for k in {key(x) for x in rest}:
            mine = [x for x in rest if key(x) == k]
            assert sum(x["method"] == "block" for x in mine) <= 0.1 * len(mine), k


def plain_scores(rows, rules, examples):
    """Rules, cuts, counts and scores of whole tables, without Spark."""
    parse = [(i, u, h, *plain(u, rules)) for i, u, h in rows]
    letters = lambda t: re.findall("[a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    counts = Counter(w for _, _, h, host, *_ in parse for w in letters(re.sub("<[^<>]*>", " ", h or "")) if w not in re.split("[^a-z]+", host))
    hosts = {p[3] for p in parse}
    runs = {h: letters(h) for h in hosts}
    counts.update({w: n for w, n in Counter(w for h in hosts for w in set(runs[h])).items() if n >= urls.SHARED})
    counts.update({w for x, _ in examples for w in letters(x)})
    total = sum(counts.values())
    costs = {w: math.log(total / n) for w, n in counts.items()}
    cut = {h: [w for r in runs[h] for w in urls.viterbi(r, costs, total)] for h in hosts}
    named = {w for h, _, _ in rules for w in letters(h)}
    deep = max(len([x for x in p.split("/") if x]) for _, p, _ in rules)
    words = lambda host, path: [w for w in cut[host] if w not in named] + letters("/".join(path.split("/")[deep + 1 :]))
    seen, names = {"block": Counter(), "allow": Counter()}, Counter()
    for text, v in examples:
        seen[v].update({w: n * urls.TOLD for w, n in Counter(letters(text)).items()})
        names[v] += urls.TOLD
    for v, host in {(p[6], p[3]) for p in parse if p[6] and zlib.crc32(str(p[0]).encode()) % 4 != 2}:
        names[v] += 1
        seen[v].update({w for p in parse if p[3] == host and p[6] == v and zlib.crc32(str(p[0]).encode()) % 4 != 2 for w in words(host, p[4])})
    known, sums = set(seen["block"]) | set(seen["allow"]), {v: sum(c.values()) for v, c in seen.items()}
    share = lambda w, v: math.log((seen[v][w] + 1) / (sums[v] + len(known)))
    prior = math.log((names["block"] + 1) / (names["allow"] + 1))
    return {i: (host, path, rule, verdict, cut[host], prior + sum(share(w, "block") - share(w, "allow") for w in words(host, path) if w in known)) for i, _, _, host, path, rule, verdict in parse}


def test_whole_tables_against_a_plain_version(spark):
    r = random.Random(4)
    hosts = ["freebets.example.com", "www.dailynews.org", "casino-win.example.net", "travelblog.net", "tiontion.example.org", "a.shop.com", "b.shop.com", "www.example.com"]
    rows = [(k, f"http{r.choice(['', 's'])}://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.choice(['play', 'read', ''])}/{k}", r.choice([None, "<p>daily news of travel and free bets</p>", "shop blog casino win", "freebets freebets"])) for k in range(120)]
    want = plain_scores(rows, urls.RULES, urls.EXAMPLES)
    for x in run(spark, rows):
        host, path, rule, verdict, words, score = want[x["page_id"]]
        assert (x["host"], x["path"], x["rule"], x["words"]) == (host, path, rule, words) and abs(x["score"] - score) < 1e-9
        assert x["method"] == ("block" if score > urls.SURE else "allow") and x["verdict"] == (verdict or x["method"])


def test_counts_follow_the_pages(spark):
    html = ["<html><script>var spam = 1</script><p>Hello hello</p>", "<style>x</style>hello<b>World</b>", None]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    assert {r["word"]: r["n"] for r in urls.word_counts(df).collect()} == {"hello": 3, "world": 1}
    runs = spark.createDataFrame([("helloworld",), ("hello",), ("zz",)], "run string")
    cut = {r["run"]: r["words"] for r in urls.segment(runs, urls.word_counts(df)).collect()}
    assert cut == {"helloworld": ["hello", "world"], "hello": ["hello"], "zz": ["zz"]}


def test_naive_bayes(spark):
    model = urls.NaiveBayes([("bad pills", "block"), ("good news", "allow")])
    row = spark.range(1).select(model.column(F.array(F.lit("pills"), F.lit("unknown"))).alias("p"), model.column(F.array(F.lit("news"))).alias("n"), model.column(F.array().cast("array<string>")).alias("e")).first()
    assert row["p"] > 0 > row["n"] and row["e"] == 0


def test_the_model_is_learned_from_the_rules(spark):
    """Hosts of a blocked registry share words with others; held-out rows tell what the model makes of them."""
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow")]
    names = {"bad": ["winbet", "betcash", "cashwin"], "good": ["newsday", "daybook", "booknews"]}
    rows = [(i, f"http://{names[side][i % 3]}.{side}.org/{'play' if side == 'bad' else 'read'}/{i}", "win bet cash news day book") for i in range(300) for side in [["bad", "good"][i // 3 % 2]]]
    rows += [(1000 + k, f"http://{w}.example.org/", "") for k, w in enumerate(["betwin", "bookday"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urls.filter_urls(df, rules, examples=[]).cache()
    told = urls.held_out_accuracy(judged).first()
    assert told["rows"] > 40 and told["accuracy"] == told["block"] == told["allow"] == 1.0
    last = {r["page_id"]: r for r in judged.filter("page_id >= 1000").collect()}
    assert (last[1000]["verdict"], last[1001]["verdict"]) == ("block", "allow") and last[1000]["words"][:2] == ["bet", "win"]


def test_a_model_against_plain_counts(spark):
    examples = [("bad pills bad", "block"), ("good news", "allow"), ("news of pills", "allow")]
    model = urls.NaiveBayes(examples)
    words = {v: [w for x, y in examples if y == v for w in x.split()] for v in ("block", "allow")}
    known = {w for v in words.values() for w in v}
    df = spark.createDataFrame([(w,) for w in [*sorted(known), "unseen"]], "w string").select("w", model.column(F.array("w")).alias("s"))
    for r in df.collect():
        want = math.log((words["block"].count(r["w"]) + 1) / (len(words["block"]) + len(known))) - math.log((words["allow"].count(r["w"]) + 1) / (len(words["allow"]) + len(known)))
        assert abs(r["s"] - (want if r["w"] in known else 0)) < 1e-9
    assert abs(model.prior - math.log(2 / 3)) < 1e-12


def test_words_of_any_length_count(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    df = spark.createDataFrame([(f"<p>{long} hat kapitän {'x' * 5000}</p>",)], "html string")
    counts = urls.word_counts(df)
    assert {r["word"] for r in counts.collect()} >= {long, "hat", "x" * 5000}
    runs = spark.createDataFrame([(long + "hat",)], "run string")
    assert urls.segment(runs, counts).first()["words"] == [long, "hat"]


def test_a_page_does_not_count_its_own_name(spark):
    df = spark.createDataFrame([("joinedname joined name", ["joinedname", "org"])], "html string, own array<string>")
    assert {r["word"]: r["n"] for r in urls.word_counts(df, own=F.col("own")).collect()} == {"joined": 1, "name": 1}


def test_tags_that_are_not_closed(spark):
    html = ["a<script>b " * 20_000, "<" * 200_000 + "c", "d <style>e", "f < g </p> h", "<SCRIPT>x</script >i<style>y</style>j", "<script>" * 8_000 + "k</style>"]
    df = spark.createDataFrame([(h,) for h in html], "html string").repartition(1)
    began = time.time()
    got = [r[0].split() for r in df.select(urls.visible_text(F.col("html")).alias("v")).collect()]
    assert time.time() - began < 20
    assert sorted(got) == sorted([["a"], ["<" * 200_000 + "c"], ["d"], ["f", "<", "g", "h"], ["i", "j"], []])
