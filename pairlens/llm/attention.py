"""A small causal self-attention language model over subword ids, in numpy.

Ids fall into classes; the model gives the distribution of the next class from
the ids before it, and each id has a share of its class that depends on the class
before it, so probabilities of all ids sum to one.  One attention layer of one head with learned positions,
a residual path and one hidden layer; trained by Adam on windows of ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Input ids of a window, ids of it that only give context (but for the first window of a text).
WINDOW, OVERLAP = 32, 4
WIDTH, HIDDEN, CLASSES = 16, 32, 64
#: Frequent ids that tell classes apart by how often they stand before an id.
COLUMNS = 256
#: Windows that are evaluated side by side.
BATCH = 48
#: Weight of an id's overall share of its class against its counts behind one class.
SMOOTH = 20.0
_F = np.float32


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    class_of: np.ndarray  # (ids,) int
    share: np.ndarray  # (classes, ids) natural log of the share in the class, by the class before

    def scores(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target; windows and targets: (n, WINDOW).

        As `forward`, with keys before queries and classes before places, so that
        maxima and sums run across rows.
        """
        w, out = self.weights, np.empty(targets.shape)
        t, d = w["places"].shape
        wq, wk, wv = (np.ascontiguousarray(w["qkv"][:, i * d : (i + 1) * d]) for i in range(3))
        wq = wq * _F(d**-0.5)
        mask = np.ascontiguousarray(_mask(t).T)
        wout, out0 = np.ascontiguousarray(w["out"].T), w["out0"][:, None]
        goals = self.class_of[targets]
        for b in range(0, len(windows), BATCH):
            part = slice(b, b + BATCH)
            x = np.take(w["ids"], windows[part], axis=0, mode="clip")
            x += w["places"]
            n = len(x)
            h = x.reshape(-1, d)
            a = (h @ wk).reshape(n, t, d) @ (h @ wq).reshape(n, t, d).transpose(0, 2, 1)
            a += mask
            a -= _halved(np.maximum, a)
            np.exp(a, out=a)
            a /= _halved(np.add, a)
            c = a.transpose(0, 2, 1) @ (h @ wv).reshape(n, t, d)
            h += c.reshape(-1, d) @ w["mix"]
            u = h @ w["up"]
            u += w["up0"]
            np.maximum(u, 0, out=u)
            h += u @ w["down"]
            logits = wout @ h.T
            logits += out0
            goal = goals[part].ravel()
            picked = logits[goal, np.arange(len(goal))]
            top = logits.max(0)
            logits -= top
            np.exp(logits, out=logits)
            out[part] = (picked - top - np.log(logits.sum(0, dtype=float))).reshape(n, t)  # long texts of near certain ids need the precision
        return out + self.share[self.class_of[windows], targets]


def _halved(of: np.ufunc, a: np.ndarray) -> np.ndarray:
    """of.reduce(a, 1, keepdims=True), by halves, for an axis whose length is a power of two."""
    while (n := a.shape[1] // 2) > 0:
        a = of(a[:, :n], a[:, n:])
    return a


def _mask(n: int) -> np.ndarray:
    return np.triu(np.full((n, n), -1e9, _F), 1)


def forward(w: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Class logits (n, WINDOW, classes) and what the backward pass needs; batched masked attention."""
    x = w["ids"][ids]
    x += w["places"]
    n, t, d = x.shape
    qkv = (x.reshape(-1, d) @ w["qkv"]).reshape(n, t, 3, d)
    q, k, v = (np.ascontiguousarray(qkv[:, :, i]) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    a *= _F(d**-0.5)
    a += _mask(t)
    a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(2, keepdims=True)
    c = a @ v
    h = x + (c.reshape(-1, d) @ w["mix"]).reshape(n, t, d)
    u = h.reshape(-1, d) @ w["up"]
    u += w["up0"]
    r = np.maximum(u, 0)
    g = h.reshape(-1, d) + r @ w["down"]
    logits = g @ w["out"]
    logits += w["out0"]
    return logits.reshape(n, t, -1), (ids, x, q, k, v, a, c, h, u, r, g)


def backward(w: dict[str, np.ndarray], kept: tuple, dlogits: np.ndarray) -> dict[str, np.ndarray]:
    ids, x, q, k, v, a, c, h, u, r, g = kept
    n, t, d = x.shape
    flat = lambda z: z.reshape(-1, z.shape[-1])
    dl = flat(dlogits)
    grad = {"out": g.T @ dl, "out0": dl.sum(0)}
    dg = dl @ w["out"].T
    grad["down"] = r.T @ dg
    du = (dg @ w["down"].T) * (u > 0)
    grad["up"], grad["up0"] = flat(h).T @ du, du.sum(0)
    dh = dg + du @ w["up"].T
    grad["mix"] = flat(c).T @ dh
    dc = (dh @ w["mix"].T).reshape(n, t, d)
    da = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    ds = a * (da - (da * a).sum(2, keepdims=True)) * _F(d**-0.5)
    dqkv = np.stack([ds @ k, ds.transpose(0, 2, 1) @ q, dv], 2).reshape(-1, 3 * d)
    grad["qkv"] = flat(x).T @ dqkv
    dx = (dh + dqkv @ w["qkv"].T).reshape(n, t, d)
    grad["places"] = dx.sum(0)
    gi = np.zeros_like(w["ids"])
    np.add.at(gi, ids.ravel(), flat(dx))
    grad["ids"] = gi
    return grad


def initial(size: int, classes: int, seed: int = 0, width: int = WIDTH, hidden: int = HIDDEN, window: int = WINDOW) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(_F)
    return {
        "ids": (rng.normal(size=(size, width)) * 0.3).astype(_F), "places": (rng.normal(size=(window, width)) * 0.1).astype(_F),
        "qkv": draw(width, 3 * width), "mix": draw(width, width), "up": draw(width, hidden), "up0": np.zeros(hidden, _F),
        "down": draw(hidden, width), "out": draw(width, classes), "out0": np.zeros(classes, _F),
    }


def columns_of(before: np.ndarray) -> np.ndarray:
    """A column for each id by its count as an id before: the most frequent have their own, all others the last."""
    top = np.argsort(-before, kind="stable")[:COLUMNS]
    column = np.full(len(before), COLUMNS)
    column[top] = np.arange(COLUMNS)[: len(top)]
    return column


def classes_of(own: np.ndarray, column: np.ndarray, times: np.ndarray, size: int, classes: int = CLASSES, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """A class for each id: k-means over what stands before it; ids not seen share the last class.

    own, column, times: id, column of the id before (columns_of), and how often.
    """
    count = np.bincount(own, times, minlength=size)
    known = np.flatnonzero(count)
    out = np.full(size, classes - 1)
    if len(known) <= classes - 1:
        out[known] = np.arange(len(known))
        return out
    row = np.zeros(size, int)
    row[known] = np.arange(len(known))
    table = np.zeros((len(known), COLUMNS + 1), _F)
    np.add.at(table, (row[own], column), times)
    base = (table.sum(0) / table.sum()).astype(_F)
    n = table.sum(1, keepdims=True)
    table += 8 * base
    table /= n + 8
    np.sqrt(table, out=table)
    rng = np.random.default_rng(seed)
    v = table @ rng.normal(size=(COLUMNS + 1, 48)).astype(_F)
    weight = count[known].astype(_F)
    heavy = np.argsort(-weight, kind="stable")
    centre = v[heavy[: classes - 1]].copy()
    for _ in range(rounds):
        near = ((v * v).sum(1)[:, None] - 2 * v @ centre.T + (centre * centre).sum(1)).argmin(1)
        for c in range(classes - 1):
            m = near == c
            if m.any():
                centre[c] = (v[m] * weight[m, None]).sum(0) / weight[m].sum()
    out[known] = near
    return out


def shares_of(class_of: np.ndarray, behind: np.ndarray, own: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log share of each id in its class by the class before, and the count of each class.

    behind, own, times: class of the id before, id, and how often.
    """
    size, classes = len(class_of), int(class_of.max()) + 1
    count = np.bincount(own, times, minlength=size) + 0.1
    mass = np.bincount(class_of, count, minlength=classes)
    share = np.zeros((classes, size))
    np.add.at(share, (behind, own), times)
    pairs = np.bincount(behind * classes + class_of[own], times, minlength=classes * classes).reshape(classes, classes)
    share += SMOOTH * count / mass[class_of]
    share /= (pairs + SMOOTH)[:, class_of]
    np.log(share, out=share)
    return share.astype(_F), mass


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.s = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, x: np.ndarray, goal: np.ndarray, lr: float) -> None:
        """One step on windows x whose targets have the classes goal."""
        w, m, s = self.w, self.m, self.s
        logits, kept = forward(w, x)
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        np.put_along_axis(p, goal[:, :, None], np.take_along_axis(p, goal[:, :, None], 2) - 1, 2)
        grad = backward(w, kept, p / _F(goal.size))
        for k in w:
            rows = slice(None)
            if k == "ids":  # only rows that occur have a gradient
                rows = np.unique(x)
            g = grad[k][rows]
            m[k][rows] = 0.9 * m[k][rows] + 0.1 * g
            s[k][rows] = 0.99 * s[k][rows] + 0.01 * g * g
            w[k][rows] -= _F(lr) * m[k][rows] / (np.sqrt(s[k][rows]) + _F(1e-6))


class Run:
    """`forward` and `backward` for training: a column for each place of a window, in memory that is used again.

    Queries meet keys, and values the matrix that mixes them, as products of weights
    made once; a row of ones below values and inputs brings the sums of the softmax
    and the biases along.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.d, self.t = w, w["places"].shape[1], len(w["places"])
        self.mask, self.scale = np.ascontiguousarray(_mask(self.t).T), self.d**-0.5
        self.made: dict[int, dict[str, np.ndarray]] = {}
        self.renew()

    def renew(self) -> None:
        """To be called when weights have changed."""
        w = self.w
        self.places = np.ascontiguousarray(w["places"].T)[:, None]
        wq, wk, wv = (w["qkv"][:, i * self.d : (i + 1) * self.d] for i in range(3))
        self.both = np.concatenate([wk @ wq.T * wq.dtype.type(self.scale), (wv @ w["mix"]).T])
        self.up, self.out = (np.ascontiguousarray(np.concatenate([w[k], w[k + "0"][None]]).T) for k in ("up", "out"))
        self.down = np.ascontiguousarray(w["down"].T)

    def room(self, n: int) -> dict[str, np.ndarray]:
        if n not in self.made:
            d, t, kind, m = self.d, self.t, self.w["places"].dtype, n * self.t
            hidden = len(self.up)
            high = {"x": d, "yv": 2 * d + 1, "c": d + 1, "h": d + 1, "r": hidden, "g": d + 1, "logits": len(self.out), "dc": d + 1, "dyv": 2 * d, "dg": d, "du": hidden, "dx": d}
            self.made[n] = {k: np.ones((v, m), kind) for k, v in high.items()} | {k: np.empty((n, t, t), kind) for k in ("e", "de")}
        return self.made[n]

    def apart(self, a: np.ndarray) -> np.ndarray:
        """A matrix for each window."""
        return a.reshape(len(a), -1, self.t).transpose(1, 0, 2)

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """Class logits (classes, n * WINDOW), valid until the next call."""
        n, d, w = len(ids), self.d, self.w
        k = self.room(n)
        x, yv, c, h, r, g, e = (k[z] for z in ("x", "yv", "c", "h", "r", "g", "e"))
        np.add(np.take(w["ids"], ids, axis=0, mode="clip").transpose(2, 0, 1), self.places, out=x.reshape(d, n, self.t))
        np.matmul(self.both, x, out=yv[: 2 * d])
        np.matmul(self.apart(x).transpose(0, 2, 1), self.apart(yv[:d]), out=e)
        e += self.mask
        long = np.einsum("ij,ij->j", x, x).max(initial=0) * np.einsum("ij,ij->j", yv[:d], yv[:d]).max(initial=0)
        if not long < 60**2:  # else no product can leave the range of exp
            e -= _halved(np.maximum, e)
        np.exp(e, out=e)
        np.matmul(self.apart(yv[d:]), e, out=self.apart(c))
        c[:d] /= c[d]
        np.add(x, c[:d], out=h[:d])
        np.matmul(self.up, h, out=r)
        np.maximum(r, 0, out=r)
        np.matmul(self.down, r, out=g[:d])
        g[:d] += h[:d]
        return np.matmul(self.out, g, out=k["logits"])

    def backward(self, n: int, dl: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but ids, and of the inputs (WIDTH, n * WINDOW); dl: that of the logits of the n windows just met, once."""
        d, w, k = self.d, self.w, self.room(n)
        x, yv, c, h, r, g, e, dc, dyv, dg, du, dx = (k[z] for z in ("x", "yv", "c", "h", "r", "g", "e", "dc", "dyv", "dg", "du", "dx"))
        out = g @ dl.T
        np.matmul(w["out"], dl, out=dg)
        down = r @ dg.T
        np.matmul(w["down"], dg, out=du)
        du *= r > 0
        up = h @ du.T
        dh = w["up"] @ du
        dh += dg
        np.divide(dh, c[d], out=dc[:d])
        np.einsum("ij,ij->j", c[:d], dc[:d], out=dc[d])
        np.negative(dc[d], out=dc[d])
        np.matmul(self.apart(dc[:d]), e.transpose(0, 2, 1), out=self.apart(dyv[d:]))
        np.matmul(self.apart(yv[d:]).transpose(0, 2, 1), self.apart(dc), out=k["de"])
        e *= k["de"]
        np.matmul(self.apart(x), e, out=self.apart(dyv[:d]))
        np.matmul(self.apart(yv[:d]), e.transpose(0, 2, 1), out=self.apart(dx))
        dh += dx
        dh += np.matmul(self.both.T, dyv, out=dx)
        both = dyv @ x.T
        wq, wk, wv = (w["qkv"][:, i * d : (i + 1) * d] for i in range(3))
        near, mixed = both[:d] * both.dtype.type(self.scale), both[d:].T
        return {
            "places": dh.reshape(d, n, self.t).sum(1).T, "qkv": np.concatenate([near.T @ wk, near @ wq, mixed @ w["mix"].T], 1), "mix": wv.T @ mixed,
            "up": up[:d], "up0": up[d], "down": down, "out": out[:d], "out0": out[d],
        }, dh


class Refiner:
    """The steps of Adam by way of Run, on w in place; all weights but ids become views of one vector, which a step takes at once."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.others = [k for k in w if k != "ids"]
        self.flat, at = np.concatenate([w[k].ravel() for k in self.others]), 0
        for k in self.others:
            w[k] = self.flat[at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
        self.w, self.run = w, Run(w)
        self.m, self.s = ({k: np.zeros_like(v) for k, v in (("ids", w["ids"]), ("flat", self.flat))} for _ in range(2))

    def step(self, x: np.ndarray, goal: np.ndarray, lr: float) -> None:
        """One step on windows x whose targets have the classes goal."""
        w, run, scale = self.w, self.run, _F(1 / goal.size)
        run.renew()
        p = run.forward(x)
        p -= p.max(0)
        np.exp(p, out=p)
        p *= scale / p.sum(0)
        p[goal.ravel(), np.arange(goal.size)] -= scale
        grad, inputs = run.backward(len(x), p)
        # only rows of ids that occur have a gradient
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(w["ids"]) <= 1 << 16 else ids, kind="stable")  # sorted by digits
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        rows = np.add.reduceat(np.take(np.ascontiguousarray(inputs.T), order, axis=0), first, axis=0)
        flat = np.concatenate([grad[k].ravel() for k in self.others])
        for k, v, at, g in (("ids", w["ids"], ids[first], rows), ("flat", self.flat, slice(None), flat)):
            m = self.m[k][at] * _F(0.9) + _F(0.1) * g
            s = self.s[k][at] * _F(0.99) + _F(0.01) * g * g
            self.m[k][at], self.s[k][at] = m, s
            v[at] -= _F(lr) * m / (np.sqrt(s) + _F(1e-6))


def refined(w: dict[str, np.ndarray], windows: np.ndarray, class_of: np.ndarray, batch: int = 64, rate: float = 0.003) -> dict[str, np.ndarray]:
    """Weights after one pass over all the windows, begun from w."""
    own = Refiner({k: v.copy() for k, v in w.items()})
    for n, start in enumerate(range(0, len(windows), batch), 1):
        part = windows[start : start + batch]
        # a short last batch counts by its length
        own.step(part[:, :-1], class_of[part[:, 1:]], rate * min(1, n / 20) * len(part) / batch)
    return own.w


def train(windows: np.ndarray, size: int, steps: int = 1500, batch: int = 64, rate: float = 0.02, seed: int = 0, *, tables: tuple[np.ndarray, ...] | None = None) -> Model:
    """Fit on windows of WINDOW + 1 ids each; without any, every id has the same probability.

    tables: classes, log shares and class counts (classes_of, shares_of), by default those of the windows.
    """
    if not len(windows):
        w = initial(size, 1)
        return Model({k: np.zeros_like(v) for k, v in w.items()}, np.zeros(size, int), np.full((1, size), -np.log(size), _F))
    x, y = windows[:, :-1], windows[:, 1:]
    if tables is None:
        a, b, once = x.ravel(), y.ravel(), np.ones(y.size)
        class_of = classes_of(b, columns_of(np.bincount(a, minlength=size))[a], once, size)
        tables = class_of, *shares_of(class_of, class_of[a], b, once)
    class_of, share, mass = tables
    w = initial(size, len(mass), seed)
    w["out0"] = np.log(mass + 1e-9).astype(_F)
    w["out0"] -= w["out0"].max()
    own, rng = Adam(w), np.random.default_rng(seed)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        own.step(x[pick], class_of[y[pick]], rate * min(1, step / 50) * (1 - step / (steps + 1)))
    return Model(w, class_of, share)


def windows_of(sequences: list[np.ndarray], pad: int, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, targets, which targets count (each of a sequence once), and the sequence of each window.

    A sequence of m + 1 ids has m targets, the ids after the first.  Windows
    start every window - overlap ids; all but the first of a sequence count only
    the targets behind the overlap.
    """
    stride = window - overlap
    m = np.array([len(s) - 1 for s in sequences], int)
    many = np.where(m <= window, 1, 1 + -(-(m - window) // stride))
    owner = np.repeat(np.arange(len(sequences)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    base = np.cumsum([0, *[len(s) for s in sequences]])[:-1]
    joined = np.concatenate([*sequences, np.full(window + 1, pad, sequences[0].dtype)])
    at = nth[:, None] * stride + np.arange(window)
    inside = at < m[owner][:, None]
    place = np.minimum(base[owner][:, None] + at, len(joined) - 2)
    x, y = np.where(inside, joined[place], pad), np.where(inside, joined[place + 1], pad)
    counts = inside & ((nth == 0)[:, None] | (np.arange(window) >= overlap))
    return x, y, counts, owner
