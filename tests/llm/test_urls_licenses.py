import re

from odd_texts import ODD

from trawlframe.llm.license_scan import BASE_PHRASES, scan_licenses, signature_rules
from trawlframe.llm.q_urls import RULES
from trawlframe.llm.url_filter import judge_urls

RULE_SCHEMA = "host string, path string, verdict string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = fold(re.match("[^/?#]*", rest).group())
    path = re.match("[^?#]*", rest[len(host):]).group()
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls_against_brute_force(spark):
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.org", "badexample.org", "example.com", "x.y.com",
             "org.", ".org", "a..org", "", "example.org:80", "com"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12?x=/es/", "/fr/#a", "/de/", "?a://b/", "#x", "/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://", "a://b://c/"]
    urls += ["http://example.org/es/1"] * 40
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://org/")], "page_id long, url string")
    pages = pages.selectExpr("*", "'x' AS host", "'y' AS key", "'z' AS verdict", "0 AS slice")
    nested = RULES + [("example.org", "/es/1", "allow"), ("example.org", "/e", "block"), ("a.example.org", "", "block")]
    for rules in (RULES, nested):
        got = judge_urls(pages.select("page_id", "url"), spark.createDataFrame(rules, RULE_SCHEMA)).collect()
        assert len(got) == len(urls) + 1
        for row in got:
            assert (row.host, row.path, row.rule, row.verdict) == judged(row.url, rules)
    clash = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA))
    assert clash.count() == len(urls) + 1


def test_the_rules_of_the_query_as_stated(spark):
    """Written out once more, so that a slip in RULES shows."""
    expected = {
        "http://a.org/x": ("org/", "allow"), "http://example.org/es/x": ("example.org/es/", "block"),
        "http://www.example.org/en/1": ("example.org/en/1", "block"),
        "http://example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
        "http://b.com/fr/": ("com/fr/", "allow"), "http://b.com/de/": ("com/de/", "block"),
        "http://b.com/en/": (None, "allow")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(expected)], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(expected.values())


def test_rules_that_fit_nothing_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("org", "x", "block"),
                                 ("org", None, "allow"), ("org", "", "block")], RULE_SCHEMA)
    assert judge_urls(pages, odd).first().verdict == "block"  # equal rules: block wins
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert judge_urls(pages, none, default="block").first().verdict == "block"
    assert judge_urls(pages.limit(0), odd).count() == 0


def test_one_host_with_most_urls(spark):
    pages = spark.range(3000).selectExpr(
        "id AS page_id", "concat('http://hot.example.org/en/', id % 1500) AS url")
    got = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in got} == {
        "example.org/en/1": sum(str(i % 1500).startswith("1") for i in range(3000)),
        "org/": sum(not str(i % 1500).startswith("1") for i in range(3000))}


def test_base_places_and_words(docs):
    texts = ODD + ["mit license mit license", "the GNU General Public-License; cc by cc by",
                   "xmit license mit licenses apache\x00license \x7f cc\n\nby", "ümit license cc byé mit license"]
    words = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = scan_licenses(docs(*texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        found = words.findall(fold(texts[row.doc_id] or ""))
        places = sorted((i, i + len(p.split()), label) for p, label in BASE_PHRASES.items()
                        for i in range(len(found)) if found[i:i + len(p.split())] == p.split())
        assert row.n_words == len(found)
        assert [tuple(b) for b in row.base] == places


def test_rules_priority_and_containment(docs):
    rules = signature_rules()
    assert len(rules) > 300
    assert [r[0] for r in rules] == sorted((r[0] for r in rules), reverse=True)

    def labels(text):
        return [d.label for d in scan_licenses(docs(text)).first().detections]

    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("licensed under the GNU General Public License, version 3. MIT License") == ["gpl-3.0", "mit"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("a license to kill") == []
    detections = scan_licenses(docs("see Apache License 2.0 " * 500)).first().detections
    assert len(detections) == 500


def test_every_pattern_finds_its_own_name(docs):
    import itertools

    samples = []
    for _, _, label, keyword, pattern in signature_rules():
        text = pattern.replace("[sc]", "s").replace("share ?alike", "sharealike")
        while (m := re.search(r"\(\?:([^()|]*)[^()]*\)\??", text)):
            text = text[:m.start()] + m.group(1) + text[m.end():]
        text = re.sub(r" \?|v\?", "", text)
        samples.append((label, keyword, text))
    rows = scan_licenses(docs(*[t for _, _, t in samples])).collect()
    found = {r.doc_id: {d.label for d in r.detections} for r in rows}
    missed = [(s, found[i]) for i, s in enumerate(samples) if not any(
        f.startswith(s[0].split("-")[0]) for f in found[i])]
    assert not list(itertools.islice(missed, 5))
