import numpy as np
from pyspark.sql import functions as F

from pairlens.operators import quantiles as op


def test_equal_to_sorting_for_any_limit(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", 1.0)] * 500 + [("b", float(v)) for v in rng.integers(0, 5, 77)] + [(None, 3.5), ("c", None), ("d", 2.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    rules = {"linear": (0.9, "linear"), "middle": (0.5, "linear"), "nearest": (0.3, "nearest"), "fourth": "index:3"}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for limit in (100_000, 20):
        got = {r.g: r for r in op.quantiles(df, ["g"], "v", rules, limit).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            v = sorted(v)
            r = got[g]
            assert r.n == len(v) and abs(r.linear - np.quantile(v, 0.9)) < 1e-12 and abs(r.middle - np.median(v)) < 1e-12
            assert r.nearest == v[round(0.3 * (len(v) - 1))] and r.fourth == (v[3] if len(v) > 3 else None)


def test_whole_tables_long_values_and_no_rows(spark):
    df = spark.range(0, 1001).select((F.col("id") * 2).alias("v"))
    assert op.quantiles(df, [], "v", {"m": (0.5, "linear")}, 30).collect()[0].m == 1000.0
    assert op.quantiles(df.where("v < 0"), [], "v", {"m": (0.5, "linear")}).count() == 0


def test_no_group_is_gathered(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = op.quantiles(df, ["g"], "v", {"m": (0.5, "linear")}, 100)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("collect_list", "collect_set", "percentile(", "median("))
