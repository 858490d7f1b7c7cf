"""URL filters: empirical-Bayes reputation of hosts, in DataFrame functions only.

Labelled pages are outcomes, good or bad. Bad shares are shrunk level by level:
the corpus is the prior of a suffix, the suffix of a registered domain, the
domain of a host. How strongly a level is shrunk is the beta-binomial
concentration estimated from the spread of its groups by the method of moments.
A host is blocked when the lower posterior bound of its bad share exceeds a
threshold; explicit rules override that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "com.br", "com.cn", "co.za", "com.mx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; empty if there is none or the url is null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def suffix_of(host: Column) -> Column:
    """The last label of a host, or the last two if names are registered under them; no user or port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict): the longest that fits host or a subdomain and begins the path; else nulls.

    Of rules of one length that fit, the first in alphabetical order wins. The
    rules are a short list in code: each is one branch of an expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(begin))
        text, verdict = F.when(fits, F.lit(name + begin)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _concentration(groups: DataFrame, low: float = 1.0, high: float = 1e6) -> float:
    """Beta-binomial concentration of groups (n, bad), by moments; high if they do not differ beyond chance."""
    sums = groups.agg(*(F.coalesce(F.sum(e), F.lit(0)).cast("double") for e in ("n", "bad", F.col("n") * F.col("n"), F.col("bad") * F.col("bad") / F.col("n"))), F.count("*")).first()
    n, bad, squares, within, k = sums
    if not n or bad in (0, n) or k < 2:
        return high
    share = bad / n
    spread, chance = within - n * share**2, share * (1 - share)
    room = chance * (n - squares / n - (k - 1))
    if room <= 0 or spread <= chance * (k - 1):
        return high
    rho = (spread - chance * (k - 1)) / room
    return min(high, max(low, 1 / rho - 1))


def reputations(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad: long) -> (host, n, bad, mean, lower): posterior mean of the bad share and its lower bound.

    Hosts without outcomes take their domain's posterior, and so on upward;
    with no outcomes at all the share is 0.5. The bound is mean - z standard
    deviations of the beta posterior, 0 at least. Only a few sums per level
    reach the driver.
    """
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    base = (total["bad"] or 0) / total["n"] if total["n"] else 0.5
    strength = {name: _concentration(level.filter("n > 0")) for name, level in (("suffix", suffixes), ("domain", domains), ("host", hosts))}

    def posterior(prior: Column, level: str) -> Column:
        return (F.col("bad") + F.lit(strength[level]) * prior) / (F.col("n") + F.lit(strength[level]))

    suffixes = suffixes.select("suffix", posterior(F.lit(base), "suffix").alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", posterior(F.col("suffix_mean"), "domain").alias("domain_mean"))
    found = hosts.join(domains, "domain").withColumn("mean", posterior(F.col("domain_mean"), "host"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(strength["host"]) + 1))
    return found.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """pages (page_id, url) and outcomes (page_id, bad 0/1) -> (page_id, host, path, rule, verdict, bad_share).

    Every row of ``pages`` comes back once, also with a null or unusable url
    (host and path empty). Outcomes of a page that repeat count once, the worst
    of them; null ids and outcomes count nowhere. A host is blocked when the
    lower bound of its bad share exceeds ``threshold``; a rule decides first.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    worst = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    known = pages.select("page_id", "host").distinct().join(worst, "page_id", "left")
    hosts = known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rated = reputations(hosts).select("host", F.col("mean").alias("bad_share"), (F.col("lower") > threshold).alias("poor"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("poor"), "block").otherwise("allow"))
    return pages.join(rated, "host").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("bad_share", 6).alias("bad_share"))
