import numpy as np

from pyspark.sql import functions as F

from pairlens.llm import near_dedup as op
from pairlens.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, bands int"


def true_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(*(w[k:] for k in range(5)), strict=False))


def brute(rows):
    sets = [true_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
            if None not in (rows[i][0], rows[j][0]) and (linked or rows[i][0] == rows[j][0]):
                up[root(i)] = root(j)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root(k)] = min(low.get(root(k), r[0]), r[0])
    out = [(r[0], len(sets[k]), low.get(root(k)) if r[0] is not None else None) for k, r in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(3000)]
    words = lambda n: [vocab[k] for k in rng.integers(0, 3000, n)]
    rows, base = [], [words(300) for _ in range(6)]
    shared = words(40)
    for k in range(90):
        w = list(base[k % 6])
        for at in rng.integers(0, 300, rng.integers(0, 7)):
            w[at] = f"new{k}"
        rows.append((k * 3 + 1, " ".join(w)))
    chain = words(200)
    for k in range(25):
        chain = chain[3:] + words(3)
        rows.append((1000 - k, " ".join(chain)))
    rows += [(2000 + k, " ".join(shared + words(30))) for k in range(40)]
    rows += [(3000 + k, rows[0][1].upper() if k % 2 else rows[0][1]) for k in range(20)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "one two"), (4004, "One  TWO"), (4005, "one two three"), (None, rows[0][1]), (1, "other text of the same id, short")]
    rows += [(5000, "x " * 60_000), (5001, "x " * 59_000), (5002, "É a b c d"), (5003, "é a b c d")]
    return [(i, t, "clash", 1) for i, t in rows]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in op.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [x[:300], x[60:360], x[:1], x[:2], np.zeros(0, np.uint64)]
    sk = op.sketches(sets)
    assert (sk[:4] != np.iinfo(np.uint64).max).all()
    assert abs((sk[0] == sk[1]).mean() - 240 / 360) < 0.12
    assert (op.sketches([s[::-1] for s in sets]) == sk).all()
    alone = np.concatenate([op.sketches([s]) for s in sets])
    assert (alone == sk).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def test_every_pair_of_a_cluster_is_settled():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 300)
    sets = []
    for _ in range(120):
        s = base.copy()
        at = rng.choice(300, rng.integers(0, 40), replace=False)
        s[at] = rng.integers(0, 2**62, len(at))
        sets.append(np.unique(s))
    sk = (op.sketches([s.view(np.uint64) for s in sets]) & np.uint64(255)).astype(np.uint8)
    comp = np.arange(120) * 10
    found = op.links_between(np.arange(120), np.arange(120), comp, sk, sets)
    up = list(range(120))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in found:
        x = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x) and root(a) != root(b)
        up[root(a)] = root(b)
    for a in range(120):
        for b in range(a):
            x = len(np.intersect1d(sets[a], sets[b]))
            if 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                assert root(a) == root(b)


def clustered(rng, n, size=200, edits=40):
    base = rng.integers(0, 2**62, size)
    sets = []
    for _ in range(n):
        s = base.copy()
        at = rng.choice(size, rng.integers(0, edits), replace=False)
        s[at] = rng.integers(0, 2**62, len(at))
        sets.append(np.unique(s))
    return sets


def test_large_clusters_take_several_blocks_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = np.random.default_rng(5)
    # one large cluster with a group of close copies and loose ones, and a small cluster
    sets = [*clustered(rng, 120, edits=9), *clustered(rng, 30, edits=40), *clustered(rng, 9)]
    sk = (op.sketches([s.view(np.uint64) for s in sets]) & np.uint64(255)).astype(np.uint8)
    rows = [(0 if k < 150 else 1, k, k, sk[k].tobytes(), sets[k].tolist()) for k in range(len(sets))]
    members = spark.createDataFrame(rows, "cluster long, id long, comp long, sketch binary, members array<long>")
    plan = op.across(members)._jdf.queryExecution().toString()
    assert "repartition" in plan.lower() or "REPARTITION_BY_COL" in plan
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if (a < 150) == (b < 150) and op.meets(sets[a], sets[b], 85)}
    links, left = op.peeled(members, block=16)
    # rows that met their pivots leave the pairs of blocks
    assert links and op.paired_blocks(left).count() < 0.8 * op.paired_blocks(members).count()
    cells = op.paired_blocks(members).groupBy("cluster", "i", "j").count().collect()
    assert len(cells) > 40 and max(r["count"] for r in cells) < 80
    found = [tuple(r) for df in [*links, op.across(left)] for r in df.collect()]
    assert {(max(p), min(p)) for p in found} <= pairs
    only = [tuple(r) for r in op.across(members).collect()]
    for got in (found, only):
        labels = {k: k for k in range(len(sets))}
        for edges in (got, pairs):
            for a, b in edges:
                x, y = labels[a], labels[b]
                if edges is pairs:
                    assert x == y
                elif x != y:
                    labels = {k: (x if v == y else v) for k, v in labels.items()}


def test_hot_keys_join_like_others(spark):
    from pairlens.llm.common import join_hot

    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, 1), (99, 2)], "key long, x long")
    one = rows.where("key <> 99").groupBy("key").count().withColumn("v", rows["key"] * 2)
    for most in (3, 100):
        for how in ("inner", "left"):
            want = sorted(map(tuple, rows.join(one.drop("count"), "key", how).collect()), key=str)
            assert sorted(map(tuple, join_hot(rows, one, "key", "count", how, most).collect()), key=str) == want


def test_hubs_and_pivots_are_split(spark):
    from pairlens.llm import common
    from pairlens.llm.components import components

    n = 60_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    sizes = []
    one = spark.createDataFrame([(0, "hub")] + [(k, "leaf") for k in range(1, 50)], "a long, name string")
    held = common.split_of(common.stored(star.groupBy("a").agg(F.count("*").alias("n")), "held"), "a", "n", 2_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = common.join_split(star.repartition(8), one.hint("shuffle_hash"), "a", "b", held).repartition(16, "b")
        assert met.count() == n - 1 and {r.name for r in met.select("name").distinct().collect()} == {"hub"}
        dealt = star.join(held, "a").select(F.pmod(F.xxhash64("b"), F.col("__salts")).alias("salt")).groupBy("salt").count().collect()
        sizes = sorted(r["count"] for r in dealt)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 30 and sizes[-1] < 1.2 * sizes[0]
    got = components(star)
    assert got.count() == n and {r.component for r in got.select("component").distinct().collect()} == {0}
    chain = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3)], "a long, b long")
    assert sorted(map(tuple, components(chain).collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]
