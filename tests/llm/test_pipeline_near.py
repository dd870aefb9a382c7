import numpy as np
import pytest

import corpus_pipeline
from pairlens.llm import near_dedup


def jaccard(a, b):
    s, t = (set(near_dedup.shingle_set(x).tolist()) for x in (a, b))
    return len(s & t) / len(s | t)


def test_stage_drops_pairs_between_80_and_85_per_cent(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(5000)]
    rows, near, far = [], set(), set()
    for k in range(60):
        w = [vocab[j] for j in rng.integers(0, 5000, 300)]
        other = list(w)
        # each replaced word takes five shingles out of both sets: 6 of them leave 0.816, 7 leave 0.789
        for n in range(6 + k % 2):
            other[20 + 40 * n] = f"new{k}x{n}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        j = jaccard(*[t for _, t in rows[-2:]])
        assert 0.8 <= j < 0.85 if k % 2 == 0 else j < 0.8
        (far if k % 2 else near).add(2 * k + 1)
    # a star: all lie near its last document alone, so the first one stays
    middle = [vocab[j] for j in rng.integers(0, 5000, 300)]
    for k in range(12):
        w = list(middle)
        for n in range(6):
            w[5 + 3 * k + 45 * n] = f"star{k}x{n}"
        rows.append((1000 + k, " ".join(w)))
    rows.append((1012, " ".join(middle)))
    assert all(0.8 <= jaccard(t, rows[-1][1]) < 0.85 for _, t in rows[-13:-1])
    near |= set(range(1001, 1013))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {i for i, _ in rows} - near
    # the contract of op7 stays at 85
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()} == {i for i, _ in rows}


@pytest.mark.parametrize(("percent", "bands", "least"), [(85, (30, 6), 0.65), (80, (36, 5), 0.6)])
def test_bands_and_prefilter_follow_from_the_threshold(percent, bands, least):
    assert near_dedup.banding(percent) == bands and near_dedup.sketch_least(percent) == least
