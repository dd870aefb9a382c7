from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from pairlens.llm import attention
from pairlens.llm import lm_scoring as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_and_windows_come_from_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(attention.train, "__defaults__", (20, 16, 0.02, 0))
    monkeypatch.setattr(op, "PART", 100)
    monkeypatch.setattr(op, "FAN", 2)
    rng = np.random.default_rng(1)
    names = ["the", "cat", "sat", "on", "mat", "far", "dog"]
    rows = [(k, " ".join(names[j] for j in rng.integers(0, 7, 40))) for k in range(60)]
    rows.append((1000, "the cat sat " * 2000))  # far more than 64 windows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seqs = op.Part(pa.array([t for _, t in rows]), PATH).sequences()
    size = op.end_of(PATH) + 1
    pairs = np.concatenate([s[:-1].astype(int) * size + s[1:] for s in seqs])

    got = op.gathered(docs, PATH, 1.0).collect()
    code, c = np.unique(pairs, return_counts=True)
    want = dict(zip(code.tolist(), c.tolist(), strict=True))
    found = {}
    for r in got:
        if r.before is not None:
            found[r.before * size + r.own] = found.get(r.before * size + r.own, 0) + r.c
    assert found == want
    spoken = Counter(w for _, t in rows for w in t.encode().split())
    assert sum((Counter({bytes(r.word): r.c}) for r in got if r.word is not None), Counter()) == spoken
    many = sum(-(-(len(s) - 1) // attention.WINDOW) for s in seqs)
    assert sum(r.ids is not None for r in got) == many > 64 + 60 * 2
    part = sum(r.ids is not None for r in op.gathered(docs, PATH, 0.5).collect())
    assert 0.3 * many < part < 0.7 * many

    model = op.fit(op.gathered(docs, PATH, 1.0), PATH)
    a, b = (int(op.Part(pa.array([w]), PATH).sequences()[0][1]) for w in ("cat", "sat"))
    n_before = c[(code // size) == a].sum()
    assert n_before > 64 and abs(np.exp(model.share[model.class_of[a], b]) - 1) < 0.1  # few ids: each has a class of its own
    # weights move away from what the bounded start gives
    x = np.stack([np.frombuffer(r.ids, np.int32) for r in got if r.ids is not None])
    mass = np.bincount(model.class_of, np.bincount(code % size, c, minlength=size) + 0.1)
    start = attention.train(x[np.lexsort(x.T[::-1])], size, tables=(model.class_of, model.share, mass)).weights
    assert not np.allclose(start["out"], model.weights["out"])
    loss = lambda w: -attention.Model(w, model.class_of, model.share).scores(x[:, :-1], x[:, 1:]).mean()
    assert loss(model.weights) < loss(start)


def test_ids_of_words_do_not_depend_on_their_neighbours():
    from pairlens.llm.bpe import Encoder

    lib = Encoder(PATH)
    texts = ["a\u00a0 \u00a0b c", "x\u2003y d'ont 's \u3000", "", "word " * 9 + "\x1c1\x1d e", "^" * 1500 + " z", "été naïve 12a3 !?x"]
    for own in ([texts[5], None, "plain\x0bwords\x0c ONLY É"], texts):
        part = op.Part(pa.array(own), PATH)
        for t, x, n in zip(own, part.sequences(), part.many, strict=True):
            words = (t or "").encode().lower().split()
            want = b"".join(lib.encode_batch([" " + w.decode()])[0] for w in words)
            assert x[1:-1].astype("<u4").tobytes() == want and x[0] == x[-1] == op.end_of(PATH) and n == len(words)
