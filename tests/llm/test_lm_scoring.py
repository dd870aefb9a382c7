import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pairlens.llm import attention
from pairlens.llm import lm_scoring as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows():
    rng = np.random.default_rng(0)
    names = ["The", "cat", "sat", "on", "mat,", "Élan", "über", "dog's", "ran", "far."]
    out = [(k, " ".join(names[j] for j in rng.integers(0, 10, rng.integers(1, 80))) + f" only{k}", 0.0) for k in range(120)]
    return [*out, (500, None, 0.0), (501, "", 0.0), (None, "the cat", 0.0), (3, out[3][1], 0.0), (502, "the mat " * 30_000, 0.0)]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(attention.train, "__defaults__", (60, 16, 0.02, 0))
    monkeypatch.setattr(op, "FREQUENT", 6)


def test_baseline_and_model_match_brute_force(spark, small):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, score double").repartition(5)
    train = [t for i, t, _ in data if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in (t or "").encode().lower().split())
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    scorer, counts = op.train(df, PATH)
    assert (scorer.train_tokens, scorer.distinct) == (n, v)
    got = sorted(map(tuple, op.score(df, scorer, counts).collect()), key=str)
    want = []
    for i, t, _ in data:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((i, len(w) + 1, sum(count[x] > 0 for x in w) + 1, base, naive(scorer, w)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4], rel=1e-4)


def naive(scorer, w):
    """Score of one text, a window at a time, by the forward pass that training uses."""
    total = 0.0
    s = op.Part(pa.array([b" ".join(w).decode()]), PATH).sequences()[0].astype(int)
    m, at = len(s) - 1, 0
    while True:
        x = np.full(attention.WINDOW, op.end_of(PATH))
        x[: len(s[at : at + attention.WINDOW][: m - at])] = s[at : min(at + attention.WINDOW, m)]
        logits = attention.forward(scorer.model.weights, x[None])[0][0].astype(float)
        logp = logits - np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True)
        for k in range(0 if at == 0 else attention.OVERLAP, attention.WINDOW):
            if at + k < m:
                y = s[at + k + 1]
                total += logp[k, scorer.model.class_of[y]] + scorer.model.share[scorer.model.class_of[x[k]], y]
        if at + attention.WINDOW >= m:
            return total / math.log(10)
        at += attention.WINDOW - attention.OVERLAP


def test_windows_count_each_target_once():
    for lengths in ([2], [33, 34, 35, 2], [500, 3, 59, 60, 61]):
        seqs = [np.arange(n) + 1000 * k for k, n in enumerate(lengths)]
        x, y, c, owner = attention.windows_of(seqs, 99_999)
        for k, s in enumerate(seqs):
            assert sorted(y[owner == k][c[owner == k]].tolist()) == s[1:].tolist()
        assert (y[c] == x[c] + 1).all()


def test_probabilities_sum_to_one_and_gradients_are_right():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 40, (50, attention.WINDOW + 1))
    m = attention.train(windows, 41, steps=20)
    x = np.repeat(windows[:1, :-1], 41, 0)
    total = np.exp(m.scores(x, np.repeat(np.arange(41)[:, None], attention.WINDOW, 1))).sum(0)
    assert np.allclose(total, 1, atol=1e-4)
    big = attention.Model({k: v * 30 if k == "qkv" else v * 5 for k, v in m.weights.items()}, m.class_of, m.share)
    logits = attention.forward(big.weights, windows[:, :-1])[0].astype(float)
    logits -= logits.max(2, keepdims=True)
    logits -= np.log(np.exp(logits).sum(2, keepdims=True))
    want = np.take_along_axis(logits, m.class_of[windows[:, 1:]][:, :, None], 2)[:, :, 0] + m.share[m.class_of[windows[:, :-1]], windows[:, 1:]]
    assert np.allclose(big.scores(windows[:, :-1], windows[:, 1:]), want, atol=1e-2)
    later = x[:1].copy()
    later[0, 20:] = 7
    a, b = (m.scores(z, windows[:1, 1:])[0, :20] for z in (x[:1], later))
    assert np.allclose(a, b, atol=1e-5)
    w = {k: v.astype(np.float64) for k, v in attention.initial(12, 5).items()}
    ids = rng.integers(0, 12, (3, attention.WINDOW))
    goal = rng.normal(size=(3, attention.WINDOW, 5))
    grad = attention.backward(w, attention.forward(w, ids)[1], goal)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape) if k != "ids" else (int(ids[0, 0]), 3)
        old, e = w[k][at], 1e-5
        w[k][at] = old + e
        up = (attention.forward(w, ids)[0] * goal).sum()
        w[k][at] = old - e
        down = (attention.forward(w, ids)[0] * goal).sum()
        w[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-4)


def test_empty_table(spark, small):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.score_documents(df, PATH).count() == 0
