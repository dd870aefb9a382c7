import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import toxicity as op


def maximal(scores):
    """All maximal segments by the definition: take the best segment, then go on to its left and right."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] or (total == best[2] and b - a < best[1] - best[0])):
                best = (a, b, total)
    if best is None:
        return []
    a, b, _ = best
    left, right = maximal(scores[:a]), maximal(scores[b + 1 :])
    return [*left, best, *[(x + b + 1, y + b + 1, s) for x, y, s in right]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.sampled_from([1, 3]))
def test_segments_are_the_maximal_ones(draws, other):
    rng = np.random.default_rng(len(draws))
    scores = [d + float(rng.random()) * 1e-6 if d > 5 else -float(other) for d in draws]
    got = op.segments(np.array(scores))
    want = maximal(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus():
    rng = np.random.default_rng(0)
    vocab = [f"wo{chr(97 + k % 26)}{chr(97 + k // 26)}rd" for k in range(400)]
    bad = ["vile", "rotten", "grimy"]
    docs, labels = [], []
    for k in range(600):
        w = [vocab[j] for j in rng.integers(0, 400, rng.integers(20, 200))]
        toxic = k % 8 == 0
        if toxic:
            for at in rng.integers(0, len(w), 4):
                w[at] = bad[rng.integers(3)] + "abcdef"[rng.integers(6)]
        docs.append((k, " ".join(w), 0.5))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(1000, None, 0.1), (1001, "", 0.1), (None, "vilea vilea viled", 0.1), (1002, "calm " * 50_000 + "vilea rottenb grimyc vilea", 0.1), (3, docs[3][1], 0.5)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score double").repartition(4)
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = op.score_documents(d, lab).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.held_out]
    truth = {i: t for i, _, t in labels}
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert by[1000].predicted == by[1001].predicted == 0 and not by[None].held_out
    assert by[None].predicted == 1 and by[1002].predicted == 1


def test_without_labels_or_documents(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs[:5], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.score_documents(d, none).count() == 5
    assert op.score_documents(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_log_odds_shrink_towards_prefixes():
    rng = np.random.default_rng(1)
    words = ["grimy", "grimyness", "grimoire", "calm", "calmer", "ab", "unseen"]
    counts = {f: (int(rng.integers(0, 40)), int(rng.integers(0, 40))) for w in words[:-1] for f in op.features_of(w)}
    odds = op.log_odds(counts, 300, 100, step=0.0)
    share = lambda f, above: (counts[f][1] + op.PRIOR * above) / (sum(counts[f]) + op.PRIOR)
    for w in words[:-1]:
        p = 0.25
        for f in reversed(op.features_of(w)):
            p = share(f, p)
            assert abs(odds[f] - (np.log(p / (1 - p)) - np.log(0.25 / 0.75))) < 1e-12
    few = op.log_odds(counts, 300, 100, step=0.4)
    assert set(few) < set(odds)
    model = op.Model(odds)
    assert model.score("grimyxyz") == odds["grimy*"] - op.DRIFT and model.score("unseen") == -op.DRIFT


def test_extreme_values_are_found_again():
    rng = np.random.default_rng(2)
    size = rng.integers(20, 2000, 6000).astype(float)
    best = (np.log(0.02 * size) - np.log(-np.log(rng.random(6000)))) / 0.8
    decay, scale = op.extreme_values(size, np.maximum(best, 0))
    assert abs(decay - 0.8) < 0.03 and abs(scale - 0.02) < 0.003


def test_evidence_and_probability_match_brute_force():
    rng = np.random.default_rng(4)
    odds = {"vile": 4.0131, "vile*": 3.0077, "calm": -2.0171, "grim*": 2.5309, "odd": 0.9173}
    model = op.Model(odds, 0.9, 0.05, -3.0, 2.0)
    words = ["vile", "vilely", "calm", "grimy", "odd", "other", "x1y"]
    texts = [" ".join(words[k] for k in rng.integers(0, 7, rng.integers(0, 25))) for _ in range(200)]
    found, evidence = model.scored([*texts, None, ""])
    for t, f, e in zip([*texts, None, ""], found, evidence, strict=True):
        tokens = op.TOKEN.findall((t or "").lower())
        own = []
        for x in tokens:
            w = next((odds[k] for k in [x, x[:6] + "*", x[:5] + "*", x[:4] + "*"] if k in odds and (k == x or len(x) >= len(k) - 1)), 0.0)
            own.append(w - op.DRIFT)
        want = [(a, b, s) for a, b, s in maximal(own) if 0.05 * len(own) * np.exp(-0.9 * s) <= op.SIGNIFICANT]
        assert [(a, b) for a, b, *_ in f] == [(a, b) for a, b, _ in want]
        total = sum(-np.log10(0.05 * len(own) * np.exp(-0.9 * s)) for *_, s in want)
        assert abs(e - total) < 1e-9
        assert abs(model.probability(np.array([e]))[0] - 1 / (1 + np.exp(3.0 - 2.0 * np.log1p(total)))) < 1e-12
    assert evidence.max() > 0 and found[-1] == found[-2] == []


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(6)
    x = rng.random(400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 2 * x))).astype(float)
    a, s = op.logistic(x, y)
    loss = lambda a, s: np.log1p(np.exp(-(2 * y - 1) * (a + s * x))).sum() + 0.005 * s * s
    assert all(loss(a, s) <= loss(a + d, s + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
