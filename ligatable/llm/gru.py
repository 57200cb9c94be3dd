"""A gated recurrent layer over symbols in numpy, forward and backward through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_layer(rng: np.random.Generator, symbols: int, hidden: int) -> dict[str, np.ndarray]:
    """Input weights by symbol (the embedding is part of them), recurrent weights, bias."""
    return {
        "w": rng.normal(0, 0.3, (symbols, 3 * hidden)).astype(np.float32),
        "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        "b": np.zeros(3 * hidden, np.float32),
    }


def forward(
    p: dict[str, np.ndarray],
    ids: np.ndarray,
    keep: np.ndarray,
    h: np.ndarray,
    tape: list | None = None,
    go: np.ndarray | None = None,
) -> np.ndarray:
    """States after each of the ``(time, lane)`` symbols, from state ``h (lane, hidden)``.

    ``keep (time, lane)`` is 0 where a step must leave the state as it is, ``go`` where
    the state after a step is zero. With ``tape``, what ``backward`` needs is appended to it.
    """
    n = h.shape[1]
    out = np.empty((*ids.shape, n), np.float32)
    u, b = p["u"], p["b"]
    for t in range(len(ids)):
        x = p["w"][ids[t]]
        a = h @ u + b
        gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        if tape is not None:
            tape.append((h, z, r, new, a[:, 2 * n :]))
        k = keep[t][:, None]
        h = h + k * (1 - z) * (new - h)
        if go is not None:
            h *= go[t][:, None]
        out[t] = h
    return out


def states(p: dict[str, np.ndarray], ids: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What ``forward`` returns, without a tape and faster: lanes lie along the fast axis.

    A logistic gate is half a hyperbolic tangent of half its input, plus a half.
    """
    n = h.shape[1]
    w, u = p["w"].copy(), np.ascontiguousarray(p["u"].T)
    w[:, : 2 * n] = 0.5 * (w[:, : 2 * n] + p["b"][: 2 * n])
    u[: 2 * n] *= 0.5
    bias = p["b"][2 * n :, None]
    out = np.empty((len(ids), n, ids.shape[1]), np.float32)
    a, x = np.empty((2, 3 * n, ids.shape[1]), np.float32)
    gates, new = a[: 2 * n], a[2 * n :]
    z, r = gates[:n], gates[n:]
    h = np.ascontiguousarray(h.T)
    whole = keep.all(axis=1)
    for t in range(len(ids)):
        np.copyto(x, w[ids[t]].T)
        np.matmul(u, h, out=a)
        gates += x[: 2 * n]
        np.tanh(gates, out=gates)
        new += bias
        r += 1
        r *= 0.5
        new *= r
        new += x[2 * n :]
        np.tanh(new, out=new)
        new -= h
        np.subtract(1, z, out=z)
        z *= 0.5
        if not whole[t]:
            z *= keep[t]
        new *= z
        h = np.add(h, new, out=out[t])
    return out.transpose(0, 2, 1)


def backward(
    p: dict[str, np.ndarray],
    ids: np.ndarray,
    keep: np.ndarray,
    tape: list,
    d_out: np.ndarray,
    go: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """Gradients of the layer's weights for gradients ``d_out`` of its states."""
    n = d_out.shape[2]
    d_in, d_rec = np.empty((2, *ids.shape, 3 * n), d_out.dtype)
    dh = np.zeros_like(d_out[0])
    for t in range(len(ids) - 1, -1, -1):
        h, z, r, new, a = tape[t]
        k = keep[t][:, None]
        dh = dh + d_out[t]
        if go is not None:
            dh *= go[t][:, None]
        moved = dh * k
        stay = 1 - z
        d_new = moved * stay
        dh -= d_new
        d_new *= 1 - new * new
        moved *= h - new
        moved *= z
        gates = d_rec[t, :, : 2 * n]
        gates[:, :n] = moved * stay
        gates[:, n:] = d_new * a * r * (1 - r)
        d_rec[t, :, 2 * n :] = d_new * r
        d_in[t, :, : 2 * n] = gates
        d_in[t, :, 2 * n :] = d_new
        dh += d_rec[t] @ p["u"].T
    flat = d_rec.reshape(-1, 3 * n)
    before = np.concatenate([step[0] for step in tape])
    grads = {"w": np.zeros_like(p["w"]), "u": before.T @ flat, "b": flat.sum(axis=0)}
    add_rows(grads["w"], ids.ravel(), d_in.reshape(-1, 3 * n))
    return grads


def add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``into[rows] += values`` where rows repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    into[rows[first]] += np.add.reduceat(values[order], first)


class Adam:
    """Steps on a dictionary of arrays."""

    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] -= (self.rate * scale) * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-8)
