import math

import numpy as np
from pyspark.sql import functions as F

from pairlens.operators import fixed_bootstrap as B


def test_binomial_inverts_the_distribution_function():
    rng = np.random.default_rng(1)
    for size, p in ((1, 0.3), (7, 0.5), (250, 0.02), (40, 0.999)):
        u = rng.random(400)
        cdf = np.cumsum([math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(size + 1)])
        want = [int(np.sum(cdf <= x)) for x in u]
        assert B.binomial(np.full(400, size), p, u).tolist() == np.minimum(want, size).tolist()
    n = rng.integers(0, 50, 300)
    got = B.binomial(n, 0.4, rng.random(300))
    assert (got >= 0).all() and (got <= n).all() and B.binomial(n, 1.0, rng.random(300)).tolist() == n.tolist() and not B.binomial(n, 0.0, rng.random(300)).any()
    big = B.binomial(np.full(2000, 10**8), 0.25, rng.random(2000))
    assert abs(big.mean() - 25e6) < 5 * math.sqrt(1e8 * 0.1875 / 2000) and 0.9 < big.std() / math.sqrt(1e8 * 0.1875) < 1.1


def test_counts_of_a_stratum_add_up_in_every_draw():
    cells = np.array([3, 1, 5, 2, 9])
    counts = dict(B.counts_below(np.full(4000, cells.sum()), cells, ("s", "r"), 7))
    table = np.stack([counts[k] for k in range(5)])
    assert (table.sum(0) == cells.sum()).all() and (table >= 0).all()
    # means and covariances are those of the multinomial
    n, p = cells.sum(), cells / cells.sum()
    assert np.allclose(table.mean(1), n * p, atol=0.15)
    assert np.allclose(np.cov(table), n * (np.diag(p) - np.outer(p, p)), atol=0.35)


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, s string, v double")


def test_sizes_hold_for_any_blocks_and_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "x", float(v)) for v in rng.normal(size=300)] + [("a", "y", 1.0)] * 40 + [("b", None, float(v)) for v in rng.integers(0, 3, 50)] + [("b", "x", None)]
    df = frame(spark, rows)
    ones = df.withColumn("v", F.when(F.col("v").isNotNull(), F.lit(1.0)))
    assert {(r.g, r.m) for r in B.bootstrap_means(ones, ["g"], "s", "v", 50).distinct().select("g", "m").collect()} == {("a", 1.0), ("b", 1.0)}
    # a constant shift moves every mean by exactly that, so no row is lost or doubled whatever the tree looks like
    for block in (4096, 16):
        base = {(r.g, r.draw): r for r in B.bootstrap_sums(df.repartition(3), ["g"], "s", "v", 60, 3, block).collect()}
        again = {(r.g, r.draw): r for r in B.bootstrap_sums(df.repartition(7), ["g"], "s", "v", 60, 3, block).collect()}
        assert len(base) == 120 and {r.n for k, r in base.items() if k[0] == "a"} == {340} and all(abs(base[k].s - again[k].s) < 1e-9 for k in base)
        means = [base["a", d].s / 340 for d in range(60)]
        assert abs(np.mean(means) - np.mean([v for g, _, v in rows if g == "a"])) < 0.05 and np.std(means) > 0


def test_spread_is_that_of_resampling_rows(spark):
    rng = np.random.default_rng(8)
    x, y = rng.choice([-1.0, 0.0, 1.0], 200, p=[0.1, 0.6, 0.3]), rng.choice([-1.0, 0.0, 1.0], 50, p=[0.5, 0.3, 0.2])
    got = np.array([r.m for r in B.bootstrap_means(frame(spark, [("g", "x", float(v)) for v in x] + [("g", "y", float(v)) for v in y]), ["g"], "s", "v", 10_000, 2).collect()])
    plain = np.concatenate([rng.choice(x, (10_000, 200)), rng.choice(y, (10_000, 50))], 1).mean(1)
    assert abs(got.mean() - plain.mean()) < 0.003 and abs(got.std() - plain.std()) < 0.002
    assert np.allclose(np.quantile(got, [0.025, 0.975]), np.quantile(plain, [0.025, 0.975]), atol=0.012)


def test_no_rows(spark):
    assert B.bootstrap_means(frame(spark, []), ["g"], "s", "v", 5).count() == 0
