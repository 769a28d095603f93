"""URL rules and host reputation."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.llm import reputation as r

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def pages_of(spark, urls):
    """Pages with columns that clash with the operator's own."""
    return spark.createDataFrame([Row(i, u, "h", 1, True) for i, u in enumerate(urls)], "page_id long, url string, host string, n int, bad boolean")


def votes(spark, rows):
    return spark.createDataFrame(rows, "key long, bad boolean")


def judged(spark, urls, outcomes=(), **options):
    out = r.filter_urls(pages_of(spark, urls), votes(spark, list(outcomes)), RULES, key=F.col("page_id"), **options)
    return {x.page_id: x for x in out.collect()}


def test_urls_and_rules(spark):
    want = {
        "http://A.Example.ORG/es/1?x=/q#f": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "x://org": ("org", "", None, "allow"),
        "x://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/?": ("b.com", "/de/", "com/de/", "block"),
        "x://b.com?/de/": ("b.com", "", None, "allow"),
        "x://b.com#a://c/d": ("b.com", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme/de/": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "x://ÄB.com/de/\nnext": ("Äb.com", "/de/\nnext", "com/de/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = judged(spark, list(want))
    assert [(x.host, x.path, x.rule, x.verdict) for _, x in sorted(got.items())] == list(want.values())


def test_domains(spark):
    rows = [("a.b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.example.com", "com", "example.com"), ("u@h.de:80", "de", "h.de"), ("10.0.0.1:8", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost"), ("", "", ""), ("[::1]:8", "[::1]", "[::1]")]
    suffix, domain = r.suffix_and_domain(F.col("h"))
    df = spark.createDataFrame([(h,) for h, _, _ in rows], "h string").select("h", suffix, domain)
    assert [tuple(x) for x in df.collect()] == rows


def test_bad_hosts_go(spark):
    """Many bad pages block a host; few don't; a new host of a bad domain goes with it; one of a good domain stays."""
    hosts = {"worst.spam.net": (200, 190), "thin.fine.net": (2, 2)}
    hosts |= {f"h{i}.spam.net": (60, 55) for i in range(12)} | {f"h{i}.fine.net": (60, 3) for i in range(12)} | {f"www.site{i}.net": (20, 1) for i in range(30)}
    urls, outcomes = [], []
    for h, (n, b) in hosts.items():
        for i in range(n):
            outcomes.append((len(urls), i < b))
            urls.append(f"http://{h}/p{i}")
    fresh = len(urls)
    urls += ["http://new.spam.net/", "http://new.fine.net/", "http://www.unseen.net/"]
    got = judged(spark, urls, outcomes, limit=0.5)
    verdict = {x.host: x.verdict for x in got.values()}
    assert {h for h, v in verdict.items() if v == "block"} == {"worst.spam.net", "new.spam.net"} | {f"h{i}.spam.net" for i in range(12)}
    assert got[fresh].bad_mean > 0.7 and got[fresh + 1].bad_mean < 0.3 and got[fresh + 2].bad_least < 0.2
    assert all(x.bad_least <= x.bad_mean for x in got.values())


def test_cases(spark):
    assert judged(spark, []) == {}
    got = judged(spark, ["x://a.net/"] * 3 + [None], [(0, True), (0, False), (None, True), (1, None)])
    assert {x.host for x in got.values()} == {"a.net", ""} and len(got) == 4
    one = r.reputations(pages_of(spark, ["x://a.net/"] * 3), votes(spark, [(0, True), (0, False), (1, None)]), key=F.col("page_id")).first()
    assert (one.n, one.b) == (1, 1)


def test_strength():
    """Equal shares are a strong prior, shares apart a weak one."""
    assert r.strength(None, None) == r.strength(-1.0, 5.0) == r.STRONGEST
    assert r.strength(1.0, 11.0) == pytest.approx(10)
    assert r.strength(5.0, 5.1) == r.WEAKEST


def test_native(spark):
    """No Python in the plan."""
    plan = r.filter_urls(pages_of(spark, ["x://a.net/"]), votes(spark, [(0, True)]), RULES, key=F.col("page_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
