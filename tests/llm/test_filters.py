"""URL reputation, quality rules and license scan."""

import re
from collections import Counter

import pytest

from folioforge.llm import license_scan, quality_rules, url_reputation
from folioforge.llm.queries import URL_RULES

def test_addresses_share_nothing(spark):
    outcomes = [("10.0.0.1", True)] * 40 + [("10.9.0.1:80", False)] * 40 + [("a.co.uk", False)] * 3
    df = spark.createDataFrame(outcomes, "host string, bad boolean")
    got = {r["host"]: r["mean"] for r in url_reputation.host_reputations(df).collect()}
    assert got["10.0.0.1"] > 0.9 and got["10.9.0.1:80"] < 0.1


def test_repeated_and_long_urls(spark):
    long = "http://a.net/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long, "h")] * 3 + [(2, "http://" + "b." * 50_000 + "org/fr/", "h")], "page_id long, url string, host string")
    got = url_reputation.judge_urls(pages, spark.createDataFrame([], "host string, bad boolean"), URL_RULES).collect()
    assert sorted((r["page_id"], r["rule"], len(r["path"])) for r in got) == [(1, "net/", 200_001)] * 3 + [(2, "org/fr/", 4)]


URLS = [
    ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://notnet/", "notnet", "/", None, "allow"),
    ("http://example.com?x=/de/", "example.com", "", None, "allow"),
    ("http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("x://b.org/fr/a://c.net/", "b.org", "/fr/a://c.net/", "org/fr/", "allow"),
    ("//b.org/fr/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄA.de#x", "Äa.de", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u[0], "clash") for i, u in enumerate(URLS)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, bad boolean")
    got = url_reputation.judge_urls(pages, none, URL_RULES).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    for i, (_, *want) in enumerate(URLS):
        assert found[i] == tuple(want), URLS[i]
    assert url_reputation.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_shrinks_to_the_level_above(spark):
    outcomes = [("bad.x.com", True)] * 60 + [("good.x.com", False)] * 60 + [("one.x.com", True)]
    outcomes += [("a.y.co.uk", False)] * 40 + [("b.z.co.uk", True), ("b.z.co.uk", None)]
    df = spark.createDataFrame(outcomes, "host string, bad boolean")
    got = {r["host"]: r for r in url_reputation.host_reputations(df).collect()}
    assert got["b.z.co.uk"]["n"] == 1 and got["b.z.co.uk"]["k"] == 1
    assert got["bad.x.com"]["mean"] > 0.9 > got["one.x.com"]["mean"] > got["good.x.com"]["mean"]
    # One bad page of one says less than sixty of sixty.
    assert got["one.x.com"]["deviation"] > got["bad.x.com"]["deviation"]
    pages = spark.createDataFrame(
        [(1, "http://bad.x.com/"), (2, "http://one.x.com/"), (3, "http://new.x.com/")], "page_id long, url string"
    )
    judged = url_reputation.judge_urls(pages, df, [])
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    assert verdicts == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow")}


def counted(text):
    """The counts of the contract, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd, odd_rows, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.judged(odd, "doc_id")
    rows = Counter((r["doc_id"], *(r[n] for n in names)) for r in got.collect())
    assert rows == Counter((r[0], *counted(r[1])) for r in odd_rows)
    assert quality_rules.judged(none, "doc_id").count() == 0


def test_quality_windows_overlap(spark):
    texts = ["a b c a b c a b c", "a a a a", "a a a", "x y z q x y z", "l\nl\n\nl \nm", "a b c d b c d b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules.judged(df, "doc_id").collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_quality_keeps_prose_and_all_columns(spark):
    prose = " ".join(["the river of that town runs to the sea and is cold in winter,"] + [f"word{i} of the" for i in range(40)])
    junk = " ".join(f"### w{i} $$$" for i in range(80))
    df = spark.createDataFrame([(1, prose, 7), (2, junk, 7), (3, None, 7)], "doc_id long, text string, n_words long")
    kept = quality_rules.keep_good(df)
    assert [tuple(r) for r in kept.collect()] == [(1, prose, 7)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan and "Python" not in plan


def test_license_scan(spark, odd, odd_rows, none):
    got = license_scan.scan(odd)
    assert got.count() == len(odd_rows) and license_scan.scan(none).count() == 0
    mit = license_scan.TEMPLATES[1][1]
    texts = [
        "Released under the MIT License. x MIT license",
        "so " + mit + " end",
        "so " + mit.replace("without limitation", "with no limitation at all") + " end",
        mit[:80],
        "licensed under CC BY-NC 4.0.",
        "GNU General-Public   License Öl mitÖ license",
        "All rights",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x["doc_id"]: x for x in license_scan.scan(df).collect()}
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["last_word"], r[0]["labels"]) == (2, 3, 6, "mit")
    assert r[1]["labels"] == "mit" and r[1]["base_labels"] == "" and r[1]["score"] == 1.0
    assert r[2]["labels"] == "mit" and 0.8 < r[2]["score"] < 1
    assert r[3]["labels"] == "" and 0 < r[3]["score"] < 0.5
    assert r[4]["labels"] == "cc-by-nc" and r[4]["first_word"] is None and r[4]["n_base"] == 0
    assert r[5]["base_labels"] == "gpl" and r[5]["first_word"] == 1 and r[5]["n_words"] == 7
    assert r[6]["n_words"] == 2 and r[6]["score"] == 0
    spans = license_scan.spans(df.filter("doc_id = 1")).filter("verified").collect()
    assert [(s["first_word"], s["last_word"]) for s in spans] == [(1, len(re.findall(license_scan.WORD, mit.lower())))]
    with pytest.raises(ValueError):
        license_scan.spans(df, (("x", "two words"),))
