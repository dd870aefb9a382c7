import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlens.operators import checks, ranking, resample


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lookup_fails_on_unknown_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (1, "z")], "k int, v string")
    known = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, name string")
    assert rows(checks.lookup(a, known, "k")) == [(1, "x", "one"), (1, "z", "one"), (2, "y", "two")]
    for bad in (4, None):
        with pytest.raises(PySparkException, match="unknown k"):
            checks.lookup(a.union(spark.createDataFrame([(bad, "w")], "k int, v string")), known, "k").collect()


def test_slices_wildcards_places_and_spread(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], k * k) for k in range(6)], "k int, g string, v int")
    assert rows(checks.exact_slice(df, ["k"], 2, 3).select("k")) == [(2,), (3,), (4,)]
    with pytest.raises(ValueError, match="asked for"):
        checks.exact_slice(df, ["k"], 4, 3)
    assert df.where(checks.wanted(g=["*"])).count() == 6 and df.where(checks.wanted(g=["a"], k=["*", "x"])).count() == 3
    assert rows(df.select("g", checks.place_in(["b"], "g")).distinct()) == [("a", None), ("b", 0)]
    assert rows(checks.spread(df, ["g"], "v", 20)) == [("b", 1, 25)]
    assert rows(checks.first_copies(df, ["g"], ["k"])) == [(0, "a", 0), (1, "b", 1)]


def test_expected_calls(spark):
    items = spark.createDataFrame([(1,), (2,)], "item int")
    e = checks.expected_calls(items, "item", ["c1", "c2"], ["s"], ["p"])
    assert rows(e) == [(i, c, s) for i in (1, 2) for c, s in (("c1", "s"), ("c2", "s"), ("p", ""))]
    o = e.where("not (item = 1 and condition = 'p')").unionByName(e.where("item = 2 and condition = 'c1'")).unionByName(spark.createDataFrame([(9, "c1", "s")], e.schema))
    assert rows(checks.call_differences(e, o, e.columns)) == [(1, "p", "", "missing"), (2, "c1", "s", "repeated"), (9, "c1", "s", "unexpected")]


def test_signatures_are_those_of_one_row_at_a_time(spark):
    n, space = 60, 80
    of = lambda item, k: (item * 7919 + k * k * 31 + k) % space if item % 3 else (item // 3 + k) % 7 + k * 9 % space
    used, want = set(), []
    for item in range(n):
        k = next(k for k in range(100) if of(item, k) not in used)
        used.add(of(item, k))
        want.append((item, k, of(item, k)))
    i = F.col("item")
    sig = lambda k: F.when(i % 3 != 0, (i * 7919 + k * k * 31 + k) % space).otherwise((F.floor(i / 3) + k) % 7 + k * 9 % space).cast("int")
    got = checks.unique_signatures(spark.range(n).select(F.col("id").cast("int").alias("item")).repartition(5), "item", sig)
    assert rows(got) == sorted(want, key=str)
    with pytest.raises(ValueError, match="attempts"):
        checks.unique_signatures(spark.range(5).select(F.col("id").alias("item")), "item", lambda k: k * 0, attempts=3)


def test_specs_and_settings(spark):
    assert rows(checks.run_specs(spark, ["a=p", "m@d=q", "d/x/m=r,s"]))[1:] == [("d/x/m", "m", "d", "x", ["r", "s"]), ("m@d", "m", "d", None, ["q"])]
    with pytest.raises(ValueError, match="not a spec"):
        checks.run_specs(spark, ["nothing"])
    text = "a: 1 # one\nb: [x, 2.5, true]\nc:\n  d: 'e f'\n  g: ~\nh: plain text\n"
    assert checks.config(text) == {"a": 1, "b": ["x", 2.5, True], "c": {"d": "e f", "g": None}, "h": "plain text"}


def test_rehash_counts_mismatches(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string")
    assert rows(checks.rehashed(m, f)) == [("a", "1", "1", True), ("b", "2", "9", False), ("c", "3", None, False)]


def test_wide_ranks_equal_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h")).unionByName(spark.createDataFrame([(None, 1000 + k, f"{k:02x}") for k in range(9)], "g long, id long, h string"))
    assert rows(ranking.ranked(df, ["h"], ["g"], wide=True).select("id", "rank")) == rows(ranking.ranked(df, ["h"], ["g"]).select("id", "rank"))


def test_poisson_weights_and_draws(spark):
    df = spark.range(400).withColumn("v", F.col("id").cast("double"))
    x = resample.scattered(resample.drawn(df, 500), "draw", "id", 5, "x")
    w = x.select(resample.poisson(F.col("x")).alias("w")).agg(F.avg("w"), F.var_samp("w"), F.count_if(F.col("w") == 0) / F.count("*")).first()
    assert abs(w[0] - 1) < 0.01 and abs(w[1] - 1) < 0.02 and abs(w[2] - 0.36788) < 0.005
    got = x.where("id = 7 and draw = 11").first().x
    h = (7 * 48271 + 11 * 16807 + 5) % resample.P
    h = (h * h + 11 * 40692 + 5) % resample.P
    h = (h * h + 7) % resample.P
    assert got == (h * 48271 + 11) % resample.P
    m = resample.bootstrap_means(df.withColumn("g", F.lit(1)), ["g"], "id", "v", 2000, 5).agg(F.avg("m"), F.stddev("m")).first()
    assert abs(m[0] - 199.5) < 1 and abs(m[1] - 115.6 / 20) < 0.6  # standard error of a mean of 400


def test_families_must_have_their_size(spark):
    from pairlens.functions import stats

    df = spark.createDataFrame([("f", 0.01), ("f", 0.04)], "fam string, p double")
    assert [r.holm_p for r in stats.holm(df, "p", ["fam"], ["p"], members=2).orderBy("p").collect()] == [0.02, 0.04]
    with pytest.raises(PySparkException, match="must have 3"):
        stats.holm(df, "p", ["fam"], ["p"], members=3).collect()


def test_mcnemar_of_large_counts(spark):
    from math import erfc, sqrt

    from pairlens.functions import stats

    got = spark.range(1).select(stats.mcnemar(F.lit(1_000_000), F.lit(1_003_000)), stats.mcnemar(F.lit(3_000_000_000), F.lit(3_000_000_000)), stats.mcnemar(F.lit(0), F.lit(60))).first()
    z = (3000 - 1) / sqrt(2_003_000)
    assert got[0] == pytest.approx(erfc(z / sqrt(2)), rel=1e-3) and got[1] == 1.0 and got[2] == pytest.approx(2 / 2**60, rel=1e-9)
