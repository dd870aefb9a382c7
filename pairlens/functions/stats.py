"""Statistics as column expressions: intervals, exact tests, corrections, cluster errors, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The 97.5 per cent point of the normal distribution (fixed value).
Z = 1.959963984540054


def wilson(k: Column, n: Column, clamp: bool = True) -> tuple[Column, Column]:
    """Lower and upper end of the 95 per cent Wilson interval; null when n is zero."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = mid - half, mid + half
    if not clamp:
        return low, high
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)), F.when(n.isNotNull(), F.least(F.lit(1.0), high))


def rate_record(k: Column, n: Column) -> Column:
    """struct<k, n, rate, low, high>."""
    low, high = wilson(k, n)
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), F.try_divide(k.cast("double"), n.cast("double")).alias("rate"), low.alias("low"), high.alias("high"))


def _log_share(n: Column, m: Column) -> Column:
    """ln of C(n, m) / 2^n for 0 < m <= n / 2: by logarithms of m factors up to m = 50, beyond by Stirling's series.

    The leading terms are written in (n - 2 m) / n, so that nothing large cancels.
    """
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(m, F.lit(50).cast("long")), F.lit(1).cast("long"))), F.lit(0.0), lambda acc, k: acc + F.log((n - m + k).cast("double")) - F.log(k.cast("double")))
    x, y = n.cast("double"), m.cast("double")
    z, d = x - y, (x - 2 * y) / x
    lead = -x / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d)) - 0.5 * F.log(2 * F.pi() * y * (z / x))
    rest = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    return F.when(m <= 50, few - x * F.log(F.lit(2.0))).otherwise(lead + rest(x) - rest(y) - rest(z))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p: twice the binomial tail at one half, at most 1; 1 without discordant pairs.

    The tail is summed relative to its largest term, in logarithms, so large counts
    do not underflow; terms beyond ten standard deviations, below 1e-80 of the sum,
    are left out.
    """
    b, c = b.cast("long"), c.cast("long")
    n, m = b + c, F.least(b, c)
    # terms relative to C(n, m): going down from k = m, each is the one above times k / (n - k + 1)
    most = F.least(m, F.ceil(10 * F.sqrt(n.cast("double"))).cast("long") + 50)
    steps = F.when(m > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(most, F.lit(1).cast("long"))), lambda i: m - i + 1)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def fold(acc: Column, k: Column) -> Column:
        t = acc["t"] * k / (n - k + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.aggregate(steps, start, fold, lambda acc: acc["s"])
    p = 2 * total * F.exp(F.when(m > 0, _log_share(n, m)).otherwise(-n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def discordant(a: Column, b: Column) -> list[Column]:
    """Counts both, a_only, b_only, neither over paired booleans (null is false)."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return [F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither")]


def holm(df: DataFrame, p: str, family: list[str], ties: list[str], out: str = "holm_p", members: int | None = None) -> DataFrame:
    """Add Holm's step-down adjusted p within each family; ties break by the given columns.

    members: how many tests every family must have; another number fails the query.
    """
    w = Window.partitionBy(*family).orderBy(p, *ties)
    size = F.count("*").over(Window.partitionBy(*family))
    if members is not None:
        size = F.when(size == members, size).otherwise(F.raise_error(F.concat(F.lit(f"a family must have {members} tests, not "), size.cast("string"))).cast("long"))
    step = F.least(F.lit(1.0), (size - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn(out, F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def cluster_error(df: DataFrame, cluster: str, value: str, by: list[str]) -> DataFrame:
    """Mean of value with its cluster-robust standard error, z and 95 per cent interval, by group.

    The variance is the sum over clusters of squared residual sums, times
    G / (G - 1), over the squared number of rows; null with fewer than two clusters.
    """
    per = df.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("m"))
    tot = per.groupBy(*by).agg(F.sum("s").alias("s1"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("m")).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count("*").alias("g"))
    mean = F.try_divide(F.col("s1"), F.col("n"))
    squares = F.greatest(F.lit(0.0), F.col("ss") - 2 * mean * F.col("sm") + mean * mean * F.col("mm"))
    error = F.sqrt(F.try_divide(squares * F.col("g"), (F.col("g") - 1) * F.col("n") * F.col("n")))
    return tot.select(*by, F.col("g").alias("clusters"), "n", mean.alias("mean"), error.alias("error")).withColumns(
        {"z": F.try_divide(F.col("mean"), F.col("error")), "low": F.col("mean") - Z * F.col("error"), "high": F.col("mean") + Z * F.col("error")}
    )


def interval_alpha(df: DataFrame, item: str, value: str, by: list[str]) -> DataFrame:
    """Interval agreement alpha: one minus observed over expected squared distance.

    Pairs within an item against pairs over all ratings, those of singly rated
    items included; both from sums and sums of squares, so no pairs are formed.
    Null where no item has two ratings or all ratings are equal.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("m"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    tot = per.groupBy(*by).agg(
        F.sum(F.col("m") * F.col("q") - F.col("s") * F.col("s")).alias("within"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"),
        F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
    )
    observed = F.try_divide(F.col("within"), F.col("pairs"))
    expected = F.try_divide(F.col("n") * F.col("q") - F.col("s") * F.col("s"), F.col("n") * (F.col("n") - 1) / 2)
    return tot.select(*by, F.col("n").alias("ratings"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def quantile(values: Column, q: float, rule: str = "linear") -> Column:
    """A quantile of an array: linear interpolation, the nearest index, or a fixed order statistic (rule 'index:k')."""
    v = F.array_sort(values)
    n = F.size(v)
    if rule.startswith("index:"):
        return F.try_element_at(v, F.lit(int(rule[6:]) + 1))
    at = q * (n - 1)
    if rule == "nearest":
        return F.try_element_at(v, (F.bround(at) + 1).cast("int"))
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(v, low + 1), F.try_element_at(v, F.least(low + 2, n))
    return a + (b - a) * (at - low)
