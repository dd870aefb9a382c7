import re
from itertools import permutations

import numpy as np
import pytest

from pairlens.llm import filter_audit as op
from pairlens.llm.queries import ORACLE_SQL


def fails(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": first,
    }


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc, text, lang, *_ in docs:
        text = text or ""
        first = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in docs)
        parts.setdefault(lang or "", []).append((doc, fails(text, first)))
    out = []
    for part, rows in parts.items():
        table, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                redundant = sum(r[1][f] for r in rows) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                table.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in table]
    return sorted(out)


def rows_of(rng):
    vocab = [f"w{k}" for k in range(400)] + ["Big", "WORD", "a|b", "50%"]
    docs = []
    for k in range(60):
        n = int(rng.integers(0, 400))
        docs.append((k, " ".join(vocab[j] for j in rng.integers(0, rng.integers(5, 404), n)), ["en", "de", None, ""][int(rng.integers(0, 4))]))
    docs += [(100, docs[3][1], "de"), (101, docs[3][1], "en"), (2, docs[3][1], "en"), (101, docs[3][1], "en"), (None, docs[3][1], "fr"), (None, None, "fr"), (102, None, "en"), (103, "", "en"), (104, "A" * 99 + " \n\t" * 70_000, "en")]
    labels = [(int(k), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for k in rng.integers(0, 104, 80)] + [(2, None, 1), (None, 1, 1), (5, 0, None)]
    return docs, labels


def tables(spark, docs, labels):
    df = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_filters_applied_in_order(spark, seed):
    docs, labels = rows_of(np.random.default_rng(seed))
    got = op.audit_filters(*tables(spark, docs, labels))
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_zeta_transform_equals_sums_over_disjoint_masks():
    counts = np.random.default_rng(3).integers(0, 1000, (7, 32))
    got = op.survivors(counts)
    for s in range(32):
        assert (got[:, s] == counts[:, [m for m in range(32) if not m & s]].sum(1)).all()


def test_empty_table(spark):
    assert op.audit_filters(*tables(spark, [], [])).count() == 0


def test_sql_states_the_same(spark):
    import duckdb

    docs, labels = rows_of(np.random.default_rng(5))
    docs = [d for d in docs if d[0] is not None]
    d, lab = tables(spark, docs, labels)
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("labels", lab.toPandas())
    cur = con.execute(ORACLE_SQL["op13_filter_audit"])
    names = [c[0] for c in cur.description]
    got = op.audit_filters(d, lab)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
