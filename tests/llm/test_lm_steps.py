import numpy as np
import pytest

from pairlens.llm import attention


def model(size, classes, kind=np.float32):
    return {k: v.astype(kind) for k, v in attention.initial(size, classes).items()}


def columns(a):
    return np.ascontiguousarray(a.reshape(-1, a.shape[2]).T)


@pytest.mark.parametrize("grown", [1, 40])  # grown: products of queries and keys leave the range of exp
def test_columns_agree_with_the_plain_passes(grown):
    rng = np.random.default_rng(3)
    w = model(50, 9, float)
    w["qkv"] *= grown
    for n in (4, 7, 4):
        ids, goal = rng.integers(0, 50, (n, attention.WINDOW)), rng.normal(size=(n, attention.WINDOW, 9))
        logits, kept = attention.forward(w, ids)
        want = attention.backward(w, kept, goal)
        run = attention.Run(w)
        assert np.allclose(run.forward(ids), columns(logits), atol=1e-9)
        got, inputs = run.backward(n, columns(goal))
        got["ids"] = np.zeros_like(w["ids"])
        np.add.at(got["ids"], ids.ravel(), inputs.T)
        assert want.keys() == got.keys()
        for k in want:
            assert np.allclose(got[k], want[k], rtol=1e-7, atol=1e-7 * abs(want[k]).max()), k


def test_a_step_moves_weights_as_plain_adam_does():
    rng = np.random.default_rng(4)
    x, goal = rng.integers(0, 30, (6, attention.WINDOW)), rng.integers(0, 5, (6, attention.WINDOW))
    start = model(40, 5)
    own, plain = (of({k: v.copy() for k, v in start.items()}) for of in (attention.Refiner, attention.Adam))
    for _ in range(3):
        own.step(x, goal, 0.01)
        plain.step(x, goal, 0.01)
    assert (own.w["ids"][30:] == start["ids"][30:]).all()  # ids that do not occur stay
    for k, v in plain.w.items():
        assert np.allclose(own.w[k], v, atol=2e-3) and abs(own.w[k] - v).mean() < 1e-4 < abs(start[k] - v).mean(), k


def test_a_pass_over_windows_takes_memory_by_the_vocabulary_once(monkeypatch):
    rng = np.random.default_rng(5)
    w, windows, taken = model(200_000, 9), rng.integers(0, 200_000, (24, attention.WINDOW + 1)), []
    plain = np.zeros_like
    monkeypatch.setattr(np, "zeros_like", lambda a, *rest, **more: taken.append(a.size) or plain(a, *rest, **more))
    attention.refined(w, windows, rng.integers(0, 9, 200_000), batch=4)
    assert sum(n == w["ids"].size for n in taken) == 2  # both moments of Adam, and no gradient for each of the six steps
