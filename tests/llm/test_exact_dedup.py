import hashlib

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, keep_id string, run int"


def brute(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = by[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample():
    rng = np.random.default_rng(0)
    rows = [(int(i), f"text {rng.integers(40)}", "x", 1) for i in range(300)]
    rows += [(1000 + i, "hot", None, None) for i in range(150)]
    rows += [(2000, None, "", 0), (2001, "", "", 0), (None, "only null id", "", 0), (None, "hot", "", 0), (7, rows[7][1], "", 0)]
    rows += [(3000, "long " * 50_000, "", 0), (3001, "long " * 50_000, "", 0), (3002, "Text 1", "", 0), (3003, "text 1 ", "", 0)]
    return rows


def test_matches_brute_force_over_partitions(spark):
    rows = sample()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert rows_of(op.deduplicate(df, most_rows=40)) == brute(rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = sample()
    weak = lambda raw: hashlib.sha256(raw).digest()[:1] + b"\x00"
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = op.deduplicate(df, digest=weak, most_rows=30).select("doc_id", "keep_id", "group_size", "kept")
    assert rows_of(got) == sorted((r[:4] for r in brute(rows)), key=str)


def test_empty_table(spark):
    got = op.deduplicate(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_levels_merge_like_a_dictionary():
    rng = np.random.default_rng(1)
    truth, runs = {}, []
    for _ in range(9):
        d = np.array([hashlib.sha256(bytes([x])).digest() for x in rng.integers(0, 200, 60)], "S32")
        top, n = rng.integers(0, 1000, 60), rng.integers(1, 5, 60)
        for k, t, c in zip(d.tolist(), top.tolist(), n.tolist(), strict=True):
            old = truth.get(k, (-1, 0))
            truth[k] = (max(old[0], t), old[1] + c)
        runs.append(op.level_of(d, top, n))
    out = op.compact(runs)
    assert dict(zip(out.digests.tolist(), zip(out.top.tolist(), out.n.tolist(), strict=True), strict=True)) == truth
    assert (out.digests[1:] > out.digests[:-1]).all()
    assert (out.find(np.array([b"absent"], "S32")) == -1).all()


def test_filters_hold_back_entries_that_are_alone(spark):
    df = spark.createDataFrame(sample(), SCHEMA).repartition(6)
    runs = op.flush_runs(df, most_rows=40).cache()
    cells = {}
    for r in runs.where("filter is not null").collect():
        own = {e.cell for e in runs.where(f"filter is null and run = {r.run}").collect()}
        assert set(np.frombuffer(r["filter"], np.int32).tolist()) == own
        for c in own:
            cells[c] = cells.get(c, 0) + 1
    assert {r.cell for r in op.shared_cells(runs).collect()} == {c for c, n in cells.items() if n > 1}
    alone = [r for r in runs.where("filter is null").collect() if cells[r.cell] == 1]
    assert alone and all(op.cell_of(bytes(r.digest)) == r.cell for r in alone)
