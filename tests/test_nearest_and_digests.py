import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from pairlens.operators import digests, nearest


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_place_equals_brute_force_at_poles_date_line_and_in_crowds(spark):
    rng = np.random.default_rng(4)
    points = [(k, "n", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for k in range(150)]
    points += [(200 + k, "n", float(48 + rng.normal() / 500), float(11 + rng.normal() / 500)) for k in range(120)]
    points += [(400, "n", 90.0, 0.0), (401, "n", -89.9, 10.0), (402, "n", 10.0, 179.9), (403, "n", 10.0, -179.9), (404, "n", 0.0, 0.01), (405, "n", 0.0, -0.01), (406, "n", 0.0, 0.01), (407, "m", 1.0, 1.0), (408, "n", None, 1.0)]
    left = [(k, "n", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for k in range(200)]
    left += [(300, "n", 89.9, 170.0), (301, "n", -90.0, 0.0), (302, "n", 10.0, 180.0), (303, "n", 10.0, -180.0), (304, "n", 0.0, 0.0), (305, "m", -60.0, -170.0), (306, "x", 0.0, 0.0), (307, "n", 48.0, 11.0), (308, "n", 48.0, 11.0), (309, "n", None, None)]
    l, r = spark.createDataFrame(left, "id int, n string, lat double, lon double"), spark.createDataFrame(points, "s int, n string, lat2 double, lon2 double")
    want = {}
    for i, n, a, o in left:
        met = [(km((a, o), (x, y)), s) for s, m, x, y in points if m == n and x is not None] if a is not None else []
        if met:
            want[i] = min(met)
    for full in (32, 2):
        got = {r.id: (r.km, r.s) for r in nearest.nearest_place(l.repartition(3), r, ["n"], "lat", "lon", "lat2", "lon2", "s", full).collect()}
        assert set(got) == set(want) and all(abs(got[i][0] - want[i][0]) < 1e-6 for i in want)
        assert {i: s for i, (_, s) in got.items()} == {i: s for i, (_, s) in want.items()}
    assert got[304][1] == 404


def test_digests_equal_whole_joins_for_any_chunk(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("k"), F.col("id"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).repartition(6)
    rows = df.collect()
    for chunk in (1 << 20, 200):
        got = {r.g: (r.sha256, r.lines) for r in digests.set_digests(df, "g", "k", chunk).collect()}
        for g in (None, 1, 2):
            ids = sorted({str(r.k) for r in rows if r.g == g})
            assert got[g] == (hashlib.sha256(("\n".join(ids) + "\n").encode()).hexdigest(), len(ids))
        got = {r.g: r.sha256 for r in digests.sequence_digests(df, "g", ["id"], F.concat(F.lit("v"), "k"), chunk=chunk).collect()}
        for g in (None, 1, 2):
            assert got[g] == hashlib.sha256("\n".join(f"v{r.k}" for r in sorted(rows, key=lambda r: r.id) if r.g == g).encode()).hexdigest()
    assert digests.set_digests(df.where("id < 0"), "g", "k").count() == 0
