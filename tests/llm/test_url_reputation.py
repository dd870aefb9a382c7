import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import url_reputation as op
from pairlens.llm.queries import ORACLE_SQL


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def tail(a, b, limit=0.5, n=200_001):
    """The beta tail by a fine sum over the logit, where the density has no poles."""
    z = np.linspace(-60, 60, n)
    log = a * -np.log1p(np.exp(-z)) + b * -np.log1p(np.exp(z))
    w = np.exp(log - log.max())
    return w[z > math.log(limit / (1 - limit))].sum() / w.sum()


def brute(pages):
    """Verdicts by plain dictionaries."""
    judged = [(i, *parts(u), *rule_of(*parts(u))) for i, u, *_ in pages]
    name = {r[1]: re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"(?s)^.*@", "", r[1])) for r in judged}
    n, x = Counter(), Counter()
    for r in judged:
        n[name[r[1]]] += r[4] is not None
        x[name[r[1]]] += r[4] == "block"

    def up(h):
        if re.fullmatch(r"[0-9.]+", h):
            return h, ""
        w = h.split(".")
        return (h if len(w) < 3 else ".".join(w[-2:])), w[-1]

    def grouped(keys):
        out = defaultdict(lambda: [0, 0])
        for h in n:
            out[keys(h)][0] += n[h]
            out[keys(h)][1] += x[h]
        return out

    def weight(level, mean):
        s = sum(a * (b / a - mean[k]) ** 2 - mean[k] * (1 - mean[k]) for k, (a, b) in level.items() if a)
        d = sum(mean[k] * (1 - mean[k]) * (a - 1) for k, (a, b) in level.items() if a)
        return 1.0 if not d else 1000.0 if s <= 0 else min(max(d / s - 1, 1), 1000)

    tops, domains, hosts = grouped(lambda h: up(h)[1]), grouped(lambda h: up(h)), grouped(lambda h: h)
    root = (sum(x.values()) + 1) / (sum(n.values()) + 2)
    k = weight(tops, {s: root for s in tops})
    t = {s: (k * root + b) / (k + a) for s, (a, b) in tops.items()}
    k = weight(domains, {d: t[d[1]] for d in domains})
    d = {c: (k * t[c[1]] + b) / (k + a) for c, (a, b) in domains.items()}
    k = weight(hosts, {h: d[up(h)] for h in hosts})
    risk = {h: tail(k * d[up(h)] + b, k * (1 - d[up(h)]) + a - b) for h, (a, b) in hosts.items()}
    return [(i, h, p, r, v or ("block" if risk[name[h]] >= 0.9 else "allow"), n[name[h]], x[name[h]]) for i, h, p, r, v in judged], risk


def pages_of(rng):
    odd = [
        None, "", "no scheme", "http://", "http:///x", "https://EXAMPLE.org/es/1", "https://a.b.Example.ORG/en/12?x", "http://example.org", "http://example.org?q=/es/", "http://notexample.org/es/",
        "x://y://z.com/fr/", "http://com/fr/1", "http://1.2.3.4:80/a", "http://u@h.example.com:99/de/1", "http://t.example.com./de/", "http://É.com/de/#a", "http://a.com/fr\n/b", "http://a\nb.com/fr/", "ftp://localhost/x",
    ]
    urls = list(odd)
    for _ in range(1500):
        d, path = int(rng.integers(0, 25)), ["fr", "de", "en/1", "en/2", "es"][int(rng.integers(0, 5))]
        if d % 5 == 0 and rng.random() < 0.9:
            path = path.replace("fr", "de")
        host = f"{['www', 'm', 'x.y'][int(rng.integers(0, 3))]}.d{d}.{['com', 'org', 'net'][d % 3]}" if d % 4 else f"blog.{['a', 'b'][d % 2]}.example.{['com', 'org', 'net'][d % 3]}"
        urls.append(f"https://{host}/{path}/{int(rng.integers(0, 99))}?p=1")
    urls += ["https://hot.bad.com/de/1"] * 700 + ["https://hot.bad.com/en/1", "https://hot.good.com/en/1"] + ["https://hot.good.com/fr/1"] * 300 + ["https://long.com/fr/" + "x" * 200_000]
    return [(k if k % 50 else None, u, "<html>", "host", "clash") for k, u in enumerate(urls)]


SCHEMA = "page_id long, url string, html string, host string, name string"


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_dictionaries(spark, seed):
    pages = pages_of(np.random.default_rng(seed))
    want, risk = brute(pages)
    assert min(abs(r - 0.9) for r in risk.values()) > 1e-6 and {r >= 0.9 for r in risk.values()} == {True, False}
    df = spark.createDataFrame(pages, SCHEMA).repartition(5)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, op.judge(df).collect()), key=key) == sorted(want, key=key)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    got = con.execute(ORACLE_SQL["op12_url_filters"]).fetchall()
    assert sorted(((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in got), key=key) == sorted(want, key=key)


def test_beta_tail_from_small_to_large_counts(spark):
    cases = [(0.01, 0.02), (0.5, 0.5), (1, 1), (3.2, 1.7), (40, 60), (600, 560), (20_000, 20_100), (1, 900), (900, 1)]
    df = op.above(spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double"), 0.5, "p")
    for r in df.collect():
        z = np.linspace(-3000, 3000, 6_000_001) if r.a < 1 else np.linspace(-30, 30, 2_000_001)
        log = -r.a * np.logaddexp(0, -z) - r.b * np.logaddexp(0, z)
        w = np.exp(log - log.max())
        assert abs(r.p - (w[z > 0].sum() + w[z == 0].sum() / 2) / w.sum()) < 1e-6


def test_rules_alone_never_yield_to_reputation_and_levels_know_long_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.co.uk",), ("x",), ("",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in op.with_levels(df, "host", ("co.uk",)).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x": ("x", "x"), "": ("", "")}


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in op.judge(df).collect()} == {"allow"}
    assert op.judge(df.where("page_id > 5")).count() == 0


def test_main_path_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string").withColumn("extra", F.lit(1))
    plan = op.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
