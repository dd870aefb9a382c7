import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import quality_classifier, quality_rules, textstats, trees

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for at, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for k in (at, at + 1, at + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


TEXTS = [None, "", "  \n\t", "a b c a b c", "a a a a", "x\ny\nx\n \n \ny\nx", "é über same  wide", "a|b <c> 100% #1", "one two three", "w " * 40_000, "a b c d a b c e\x0bb c d", "\x1c\x85 odd \x1fseparators"]


def test_counts_match_brute_force():
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join("ab|\nc"[k] for k in rng.integers(0, 5, rng.integers(0, 30))) for _ in range(300)]
    for t in texts:
        assert textstats.counts_of(t)[0] == brute_counts(t), t
        assert np.isfinite(textstats.counts_of(t)[1]).all()


def corpus(n=500):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for k in range(n):
        w = [f"word{j}" for j in rng.integers(0, 200, rng.integers(60, 200))]
        bad = k % 6 == 0
        if bad:
            w = [f"{x}$$$" for x in w] if k % 12 else [x for x in w[:30] for _ in range(5)]
        docs.append((k, " ".join(w), 0.1, "x"))
        labels.append((k, int(not bad), 0))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    odd = [(900, None, 0.1, "x"), (901, "", 0.1, "x"), (None, docs[1][1], 0.1, "x"), (3, docs[3][1], 0.1, "x"), (902, "long text with words " * 20_000, 0.0, None)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score double, kept string").repartition(4)
    lab = spark.createDataFrame([*labels, (1, None, 0), (None, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    return d, lab, {i: q for i, q, _ in labels}, len(docs) + len(odd)


def test_classifier_is_right_on_held_out_rows(spark):
    d, lab, truth, n = frames(spark)
    model = quality_classifier.train(d, lab)
    rows = quality_classifier.score_documents(d, lab).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert 0 < len(model.rules) < 60
    assert not [r for r in rows if r.doc_id is None][0].held_out
    both = quality_classifier.classify(d.select("text"), model).collect()
    x = textstats.stats_of([r.text for r in both])[1]
    assert np.allclose([r["__quality"] for r in both], model.score(x), atol=1e-12)


def test_rules_keep_clean_and_fail_base_cases(spark):
    d, lab, truth, n = frames(spark)
    rows = quality_rules.judge_documents(d, lab).collect()
    assert len(rows) == n
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id in truth and not r.base_failed:
            assert r.kept == bool(truth[r.doc_id])


def test_empty_tables_and_no_labels(spark):
    d, lab, *_ = frames(spark)
    none = lab.limit(0)
    assert {round(r.score, 6) for r in quality_classifier.score_documents(d, none).select("score").distinct().collect()} == {0.5}
    assert quality_rules.judge_documents(d, none).where("not base_failed and not kept").count() == 0
    assert quality_classifier.score_documents(d.limit(0), lab).count() == 0
    assert quality_rules.judge_documents(d.limit(0), lab).count() == 0


def test_forest_obeys_constraints_and_flat_arrays_match_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=1500)) > 0).astype(float)
    f = trees.fit(x, y, trees=25, depth=3, monotone={0: 1, 1: -1})
    base = rng.normal(size=(200, 4))
    for feature, sign in ((0, 1), (1, -1)):
        grid = np.repeat(base, 15, 0)
        grid[:, feature] = np.tile(np.linspace(-3, 3, 15), 200)
        steps = np.diff(f.raw(grid).reshape(200, 15), axis=1) * sign
        assert (steps >= -1e-9).all()
    assert trees.fit(x, y, trees=25, depth=3).probability(x)[y == 1].mean() > 0.6

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            k = 0
            while f.left[t, k] != k:
                k = f.left[t, k] if row[f.feature[t, k]] <= f.threshold[t, k] else f.right[t, k]
            total += f.value[t, k]
        return total

    assert np.allclose([walk(r) for r in base], f.raw(base))


def test_stats_pass_other_columns_through(spark):
    d = spark.createDataFrame([(1, "a b", [1, 2], {"k": 1})], "n_words long, text string, arr array<int>, m map<string,int>")
    row = textstats.with_stats(d).select("n_words", "arr", "m", F.col("__stats.n_words").alias("w")).collect()[0]
    assert (row.n_words, row.arr, row.m, row.w) == (1, [1, 2], {"k": 1}, 2)


def test_rules_are_the_distinct_paths_of_the_trees():
    # a tree of two splits and one of a single split; node 0 is the root, a leaf points to itself
    forest = trees.Forest(
        feature=np.array([[0, 1, 0, 0, 0], [0, 0, 0, 0, 0]]), threshold=np.array([[2.0, 5.0, 0, 0, 0], [2.0, 0, 0, 0, 0]]),
        left=np.array([[1, 3, 2, 3, 4], [1, 1, 2, 3, 4]]), right=np.array([[2, 4, 2, 3, 4], [2, 1, 2, 3, 4]]), value=np.zeros((2, 5)), base=0.0, depth=2,
    )
    got = {r.terms for r in quality_classifier.rules_of(forest)}
    leaves = {((0, False, 2.0),), ((0, True, 2.0), (1, True, 5.0)), ((0, True, 2.0), (1, False, 5.0))}
    inner = {((0, True, 2.0),)}
    assert leaves <= {tuple(sorted(t, key=lambda x: (x[0], not x[1]))) for t in got} | got
    assert {tuple(sorted(t)) for t in got} <= {tuple(sorted(t)) for t in leaves | inner}
    x = np.array([[1.0, 4.0], [1.0, 6.0], [3.0, 0.0]])
    for r in quality_classifier.rules_of(forest):
        want = [all(row[f] <= v if low else row[f] > v for f, low, v in r.terms) for row in x]
        assert r.holds(x).tolist() == want


def test_lasso_weights_are_the_optimum():
    rng = np.random.default_rng(9)
    z = (rng.random((400, 12)) < rng.random(12)).astype(float)
    truth = np.zeros(12)
    truth[:3] = [2.0, -1.5, 1.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(z @ truth - 0.5)))).astype(float)
    penalty = 0.01
    b, w = quality_classifier.lasso_logistic(z, y, penalty, steps=4000)
    mean = z.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    residual = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = ((z - mean) / scale).T @ residual / 400  # on the standardised rules, where the penalty applies
    assert abs(residual.mean()) < 1e-4
    on = np.abs(w) > 1e-6
    assert 0 < on.sum() < 12
    assert np.allclose(slope[on], -penalty * np.sign(w[on]), atol=1e-3) and (np.abs(slope[~on]) <= penalty + 1e-3).all()
