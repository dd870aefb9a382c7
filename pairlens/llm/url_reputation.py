"""Verdicts on URLs: rules first, then the reputation of the host.

A rule names a host and the start of a path; it fits that host and its subdomains,
and the longest rule decides.  What rules decide are the labelled outcomes of a
host: allowed or blocked pages.  All other pages are judged by their host, whose
rate of blocked pages has a beta posterior.  Its prior comes from the registered
domain, that one's from the suffix, and the suffix's from all labelled pages; how
strongly a level holds its members together is estimated from the spread of their
rates about the level above (moments of the beta-binomial), not set.  A page is
blocked when the posterior puts at least BELIEF on a rate over LIMIT.

Everything is DataFrame functions: hosts are one grouped table, the levels above
are grouped from it, and pages meet the hosts in a join that broadcasts only hosts
that hold many pages.

Defined cases: a null url and one without '://' have an empty host and path, and
are judged as a host of their own; hosts without labelled pages have the posterior
of their domain, without any labels at all every host has that of a fair coin; user
and port are no part of the name that is judged; numeric addresses are their own
domain; repeated rows are judged each; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import join_hot, stored

#: Verdict, host and start of the path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host is blocked when its rate of blocked pages exceeds LIMIT with probability BELIEF or more.
LIMIT, BELIEF = 0.5, 0.9
#: The estimated weight of a prior, in labelled pages, stays between these.
WEIGHTS = (1.0, 1000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_levels(df: DataFrame, host: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """df with name, domain and suffix; `suffixes` are those of several labels (co.uk), all others have one."""
    df = df.withColumn("name", F.regexp_replace(host, r"\A.*@|\.?(:[0-9]*)?\z", ""))
    labels = F.split("name", r"\.")
    short, long = F.element_at(labels, -1), F.concat_ws(".", F.slice(labels, -2, 2))
    two = long.isin(*suffixes) if suffixes else F.lit(False)
    number = F.col("name").rlike(r"\A[0-9.]+\z")
    domain = F.when(number | (F.size(labels) < 3), F.col("name")).when(two, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(long)
    return df.withColumns({"domain": domain, "suffix": F.when(number, "").when((F.size(labels) > 1) & two, long).otherwise(short)})


def log_gamma(z: Column) -> Column:
    """Stirling's series eight steps up, and back by the recurrence: about 1e-10 for any z above zero."""
    y, product = z + 8, z
    for k in range(1, 8):
        product = product * (z + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def below(x: Column, a: Column, b: Column) -> Column:
    """The part of a beta distribution below x, where x is at most its mean: terms fall from the start."""
    step = lambda s, k: F.struct((s["term"] * x * (a + b + k - 1) / (a + k)).alias("term"), (s["sum"] + s["term"] * x * (a + b + k - 1) / (a + k)).alias("sum"))
    terms = F.sequence(F.lit(1), F.ceil(60 + 12 * F.sqrt(a + b)).cast("int"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda s: s["sum"])
    return F.exp(a * F.log(x) + b * F.log(1 - x) - F.log(a) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) * total


def above(df: DataFrame, limit: float, out: str) -> DataFrame:
    """df with the probability that a beta variable with columns a and b exceeds limit."""
    low = F.lit(limit) < F.col("a") / (F.col("a") + F.col("b"))
    p = F.when(low, limit).otherwise(1 - limit)
    df = df.withColumns({"__x": p, "__a": F.when(low, F.col("a")).otherwise(F.col("b")), "__b": F.when(low, F.col("b")).otherwise(F.col("a"))})
    df = df.withColumn("__p", below(F.col("__x"), F.col("__a"), F.col("__b")))
    return df.withColumn(out, F.when(low, 1 - F.col("__p")).otherwise(F.col("__p"))).drop("__x", "__a", "__b", "__p")


def prior_weight(level: DataFrame) -> float:
    """How many labelled pages the mean of the level above is worth, by the spread of the rates about it.

    With correlation r, n (rate - mean)^2 is mean (1 - mean) (1 + (n - 1) r) on
    average; r over all members of the level gives the weight 1 / r - 1.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    got = level.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("mean"), 2) - spread).alias("s"), F.sum(spread * (F.col("n") - 1)).alias("d")).first()
    if not got["d"]:
        return WEIGHTS[0]
    r = got["s"] / got["d"]
    return min(max(1 / r - 1, WEIGHTS[0]), WEIGHTS[1]) if r > 0 else WEIGHTS[1]


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = (), limit: float = LIMIT) -> DataFrame:
    """(name, rows, n, x, risk) per host of outcomes (host, verdict: allow, block or null); risk is the posterior over limit."""
    n, x = F.count("verdict"), F.count_if(F.col("verdict") == "block")
    hosts = with_levels(outcomes.groupBy("host").agg(F.count("*").alias("rows"), n.alias("n"), x.alias("x")), "host", suffixes)
    hosts = stored(hosts.groupBy("name", "domain", "suffix").agg(*[F.sum(k).alias(k) for k in ("rows", "n", "x")]), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("members")), "domains")
    tops = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("members")), "suffixes")
    total = tops.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    tops = tops.withColumn("mean", F.lit(((total["x"] or 0) + 1) / ((total["n"] or 0) + 2)))

    def shrunken(level: DataFrame, key: str) -> DataFrame:
        k = prior_weight(level)
        return stored(level.select(key, "members", ((k * F.col("mean") + F.col("x")) / (k + F.col("n"))).alias("mean")), f"{key}-means")

    above_domains = shrunken(tops, "suffix")
    above_hosts = shrunken(stored(join_hot(domains.withColumnRenamed("members", "hosts"), above_domains, "suffix", "members").withColumnRenamed("hosts", "members"), "domain-priors"), "domain")
    hosts = stored(join_hot(hosts, above_hosts, "domain", "members"), "host-priors")
    k = prior_weight(hosts)
    hosts = hosts.withColumns({"a": k * F.col("mean") + F.col("x"), "b": k * (1 - F.col("mean")) + F.col("n") - F.col("x")})
    return above(hosts, limit, "risk").select("name", "rows", "n", "x", "risk")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, suffixes: tuple[str, ...] = (), limit: float = LIMIT, belief: float = BELIEF) -> DataFrame:
    """page_id, host, path, rule, verdict, and the labelled and blocked pages of the host."""
    each = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    each = each.withColumn("hit", fitting(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", "hit.verdict")
    hosts = stored(reputation(each.select("host", "verdict"), suffixes, limit), "reputation")
    j = join_hot(with_levels(each, "host", suffixes).drop("domain", "suffix"), hosts, "name", "rows", how="left")
    own = F.when(F.col("risk") >= belief, "block").otherwise("allow")
    return j.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.col("n").alias("n_labelled"), F.col("x").alias("n_blocked"))
