"""URL filtering by rules and by empirical-Bayes host reputation.

A url's host and path are cut out by two expressions.  Rules come first: a rule
``host/path`` fits its host and all subdomains if the url's path starts with
the rule's; of the fitting ones the longest decides (of equally long ones that
with the longer host).

Where no rule fits, the host's reputation decides.  Pages whose outcome is
known (bad or not) are counted for their host, and each level's share of bad
pages is shrunk towards the level above it, corpus -> suffix -> registered
domain -> host, by a beta-binomial prior: the posterior of a level's share,
mean (bad + m q) / (n + m), where q is the mean above and the strength m is
estimated at each level from the spread of its shares (moments; little spread
is a strong prior), but is never more than the pages behind q.  A host is blocked if the lower bound of its posterior,
mean - z standard deviations, is over ``limit``.  A host without known pages
has its domain's prior and is judged by that.

Only counts per (host, outcome key) meet the outcomes, so a host or a key that
holds a third of all rows is combined before any shuffle; the hosts' table is
written before pages are joined to it, so that adaptive execution may send it
to all (by its size) or split a hot host.

Defined cases: a null url or one without ``://`` has an empty host and path,
and such pages share one reputation; a page without an outcome only lacks a
vote; of repeated outcomes of a key the bad one counts; repeated pages count
each; without outcomes every host has the prior 1/2 of an empty corpus, whose
bound is under any limit of 1/2 or more; null ids are ids like others; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Public suffixes of two labels (fixed values; any other suffix is the last label).
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def suffix_and_domain(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column]:
    """Public suffix and registered domain (the suffix and a label) of a host, without user and port; an address is both."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    two = last(2).isin(*two_labels) if two_labels else F.lit(False)
    address = bare.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, bare).when(two, last(2)).otherwise(last(1)), F.when(address, bare).when(two, last(3)).otherwise(last(2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, "host/path") that fits; nulls without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(set(rules), key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1], r[0])):
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _spread(children: DataFrame, on: list[str]) -> DataFrame:
    """One row: over, under: the two sums whose quotient estimates the correlation of pages of one child.

    children: on, n, b and their parent's pn and pb.

    Per parent with share p, v = p (1 - p), N pages and K children: the children's
    weighted squared deviations S have the mean v ((K - 1) + rho (N - sum n^2 / N - (K - 1))).
    """
    share = F.col("pb") / F.col("pn")
    held = children.filter("n > 0")
    off = F.col("n") * F.pow(F.col("b") / F.col("n") - share, 2)
    per = held.groupBy(*on, "pn", "pb").agg(F.sum(off).alias("s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.count("*").alias("k"))
    v, free = share * (1 - share), F.col("k") - 1
    return per.agg(F.sum(F.col("s") - v * free).alias("over"), F.sum(v * (F.col("pn") - F.col("nn") / F.col("pn") - free)).alias("under"))


def strength(over: float | None, under: float | None) -> float:
    """Pages that a prior counts for: 1 / rho - 1, held within WEAKEST and STRONGEST."""
    if not over or not under or over <= 0 or under <= 0:
        return STRONGEST
    return min(max(under / over - 1, WEAKEST), STRONGEST)


def reputations(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", key: Column | None = None, z: float = 1.645) -> DataFrame:
    """One row per host: host, domain, suffix, n (known pages), b (bad ones), bad_mean, bad_least.

    outcomes: key, bad (boolean).  key: a page's key, of its columns.
    """
    one = pages.select(host_of(F.col(url_col)).alias("host"), (F.col("key") if key is None else key).alias("key")).groupBy("host", "key").agg(F.count("*").alias("c"))
    known = materialize(outcomes.filter("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad")), "reputation-outcomes")
    suffix, domain = suffix_and_domain(F.col("host"))
    voted = one.join(known, "key", "left").groupBy("host").agg(
        F.sum(F.when(F.col("bad").isNotNull(), F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0)).alias("b")
    )
    hosts = materialize(voted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "b"), "reputation-hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    domains = materialize(total(hosts, "suffix", "domain"), "reputation-domains")
    suffixes = materialize(total(domains, "suffix"), "reputation-suffixes")
    # Four rows of sums: all that comes to the driver.
    n, b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    under = lambda df, parents, *by: df.join(parents.select(*by, F.col("n").alias("pn"), F.col("b").alias("pb")), [*by])
    top = suffixes.withColumns({"pn": F.lit(max(n, 1)), "pb": F.lit(b)})
    levels = ((top, []), (under(domains, suffixes, "suffix"), ["suffix"]), (under(hosts, domains, "suffix", "domain"), ["suffix", "domain"]))
    found = [_spread(c, on).withColumn("level", F.lit(i)) for i, (c, on) in enumerate(levels)]
    m = {r["level"]: strength(r["over"], r["under"]) for r in found[0].unionByName(found[1]).unionByName(found[2]).collect()}

    def shrunk(level: int, q: Column, size: Column) -> tuple[Column, Column]:
        """Posterior mean and size of a level whose parents have the mean q from size pages."""
        prior = F.least(F.lit(m[level]), size)
        return (F.col("b") + prior * q) / (F.col("n") + prior), F.col("n") + prior

    top = suffixes.select("suffix", *(c.alias(a) for c, a in zip(shrunk(0, F.lit((b + 1.0) / (n + 2.0)), F.lit(n + 2.0)), ("q", "size"))))
    mid = domains.join(top, "suffix").select("suffix", "domain", *(c.alias(a) for c, a in zip(shrunk(1, F.col("q"), F.col("size")), ("q", "size"))))
    mid = materialize(mid, "reputation-priors")
    mu, pages_behind = shrunk(2, F.col("q"), F.col("size"))
    least = mu - z * F.sqrt(mu * (1 - mu) / (pages_behind + 1))
    return hosts.join(mid, ["suffix", "domain"]).select("host", "domain", "suffix", "n", "b", mu.alias("bad_mean"), F.greatest(least, F.lit(0.0)).alias("bad_least"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", key: Column | None = None, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), bad_mean, bad_least (of its host)."""
    hosts = materialize(reputations(pages, outcomes, url_col, key, z).select("host", "bad_mean", "bad_least"), "reputation-verdicts")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_least") > limit, "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select(F.col(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_mean", "bad_least")
