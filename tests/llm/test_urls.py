import math
import random

import duckdb
import pytest

from flowkit.llm import queries, urls
from flowkit.llm.queries import URL_RULES


def judged(spark, pages, outcomes, **more):
    p = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, n int")
    o = spark.createDataFrame(outcomes, "page_id long, bad int")
    return urls.judge(p, o, URL_RULES, **more)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("HTTP://A.Example.COM/en/5?x#y", "a.example.com", "/en/5", "com/en/", "block"),
        ("http://a.example.com/en/72", "a.example.com", "/en/72", "example.com/en/7", "allow"),
        ("http://badexample.com/en/72", "badexample.com", "/en/72", "com/en/", "block"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://example.net?/de/8", "example.net", "", None, "allow"),
        ("x://org/es/1\n", "org", "/es/1\n", "org/es/", "block"),
        ("a://b.org/x://c/de/", "b.org", "/x://c/de/", None, "allow"),
        ("http://É.COM#f", "É.com", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    (r,) = judged(spark, [(1, url)], []).collect()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_domains(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "x.shop.co.uk", "shop.co.uk", "co.uk", "u:p@h.example.org:8080"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [(r.d, r.s) for r in df.select(urls.domain_of(df.h).alias("d"), urls.suffix_of(df.h).alias("s")).collect()]
    assert got == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", ""), ("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.org", "org")]


def model(counts, z=1.645):
    """The same shrinkage in plain Python."""
    from collections import Counter

    def level(key):
        n, b = Counter(), Counter()
        for host, (x, y) in counts.items():
            n[key(host)] += x
            b[key(host)] += y
        return {k: (n[k], b[k]) for k in n}

    def strength(groups):
        g = [(n, b) for n, b in groups.values() if n]
        total, bad = sum(n for n, _ in g), sum(b for _, b in g)
        if not total or bad in (0, total) or len(g) < 2:
            return 1e6
        m = bad / total
        spread = sum(n * (b / n - m) ** 2 for n, b in g)
        room = m * (1 - m) * (total - sum(n * n for n, _ in g) / total - (len(g) - 1))
        if room <= 0 or spread <= m * (1 - m) * (len(g) - 1):
            return 1e6
        return min(1e6, max(1.0, room / (spread - m * (1 - m) * (len(g) - 1)) - 1))

    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    hosts, domains, suffixes = level(lambda h: h), level(domain), level(suffix)
    total = (sum(n for n, _ in hosts.values()), sum(b for _, b in hosts.values()))
    base = total[1] / total[0] if total[0] else 0.5
    sh, sd, ss = strength(hosts), strength(domains), strength(suffixes)
    post = lambda nb, prior, s: (nb[1] + s * prior) / (nb[0] + s)
    out = {}
    for h in hosts:
        mean = post(hosts[h], post(domains[domain(h)], post(suffixes[suffix(h)], base, ss), sd), sh)
        out[h] = (mean, max(0.0, mean - z * math.sqrt(mean * (1 - mean) / (hosts[h][0] + sh + 1))))
    return out


def test_reputations_against_plain_python(spark):
    r = random.Random(8)
    counts = {}
    for d in ("a.com", "b.com", "c.org", "d.net"):
        for sub in ("x", "y", "z", "w"):
            n = r.choice([0, 3, 40, 200])
            counts[f"{sub}.{d}"] = (n, sum(r.random() < (0.9 if d == "b.com" else 0.1) for _ in range(n)))
    df = spark.createDataFrame([(h, *c) for h, c in counts.items()], "host string, n long, bad long")
    expected = model(counts)
    for x in urls.reputations(df).collect():
        assert (x.mean, x.lower) == pytest.approx(expected[x.host])
    assert urls.reputations(df.limit(0)).count() == 0


def test_bad_host_is_blocked_and_rows_are_kept(spark):
    pages = [(i, f"http://bad.example.org/fr/{i}") for i in range(60)] + [(100 + i, f"http://good.example.net/fr/{i}") for i in range(60)]
    pages += [(5, "http://bad.example.org/es/1"), (5, "http://bad.example.org/es/1"), (None, "http://new.example.net/fr/")]
    outcomes = [(i, int(i < 60)) for i, _ in pages if i is not None] + [(3, 0), (None, 1), (4, None)]
    got = judged(spark, pages, outcomes).collect()
    assert len(got) == len(pages)
    assert {r.verdict for r in got if r.host == "bad.example.org"} == {"block"} and {r.verdict for r in got if r.host != "bad.example.org"} == {"allow"}
    assert judged(spark, pages, outcomes).filter("page_id is null").first().host == "new.example.net"


def test_no_python_in_the_plan(spark):
    plan = queries.op8_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_oracle(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL["op8_url_filters"])
    names = [d[0] for d in found.description]
    expected = sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=lambda r: r["page_id"])
    got = sorted((r.asDict() for r in queries.op8_url_filters(spark, sf).collect()), key=lambda r: r["page_id"])
    assert got == expected
