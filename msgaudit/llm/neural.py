"""Recurrent layers with their gradients, in numpy.

Sequences are time-major, ``x[t, b]``; ``mask[t, b]`` is 0 behind a sequence's
end, where states stay as they are.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def init(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)


def sum_by(size: int, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by id: out[i] is the sum of the rows whose id is i."""
    flat, rows = ids.reshape(-1), rows.reshape(-1, rows.shape[-1])
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(flat):
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        out[found] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    """Adam with a step size that falls linearly to zero."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, steps: int):
        self.params, self.rate, self.steps, self.t = params, rate, steps, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = self.rate * max(0.05, 1 - self.t / self.steps)
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= (rate * (self.m[k] / (1 - 0.9 ** self.t))
                               / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)).astype(np.float32)


# --------------------------------------------------------------------- GRU
# gates z (keep) and r (reset), candidate n: h' = (1 - z) n + z h, n = tanh(x_n + r (h U_n + c))

def gru(proj: np.ndarray, mask: np.ndarray | None, u: np.ndarray, c: np.ndarray, keep: bool = False):
    """States over time from the projected inputs ``proj[t, b, 3h]``."""
    steps, batch, width = proj.shape
    h = width // 3
    state = np.zeros((batch, h), np.float32)
    out = np.empty((steps, batch, h), np.float32)
    saved = []
    for t in range(steps):
        rec = state @ u
        gates = sigmoid(proj[t, :, :2 * h] + rec[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        inner = rec[:, 2 * h:] + c
        n = np.tanh(proj[t, :, 2 * h:] + r * inner)
        new = n + z * (state - n)
        if mask is not None:
            new = state + mask[t][:, None] * (new - state)
        if keep:
            saved.append((state, z, r, inner, n))
        state = out[t] = new
    return (out, saved) if keep else out


def gru_states(table: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, u: np.ndarray, c: np.ndarray,
               out: np.ndarray) -> None:
    """States without gradients, feature-major: ``out[t, :, b]`` from rows ``ids[t, b]`` of the projected table.

    The gates' halves of ``table`` and ``u`` must be scaled by 0.5 (see :func:`half_gates`).
    """
    h, half = len(c), np.float32(0.5)
    ut = np.ascontiguousarray(u.T)
    state = np.zeros((h, ids.shape[1]), np.float32)
    rec, x = np.empty((3 * h, ids.shape[1]), np.float32), np.empty((3 * h, ids.shape[1]), np.float32)
    gates, n = rec[:2 * h], rec[2 * h:]
    for t in range(len(ids)):
        x[:] = table[ids[t]].T
        np.matmul(ut, state, out=rec)
        gates += x[:2 * h]
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        n += c[:, None]
        n *= gates[h:]
        n += x[2 * h:]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(state, n, out=new)
        new *= gates[:h]
        new += n
        if mask is not None:
            new -= state
            new *= mask[t]
            new += state
        state = new


def half_gates(a: np.ndarray) -> np.ndarray:
    """The array with its gate columns (the first two thirds) halved."""
    a = a.copy()
    a[..., :2 * a.shape[-1] // 3] *= 0.5
    return np.ascontiguousarray(a, np.float32)


def gru_back(grad: np.ndarray, saved: list, mask: np.ndarray | None, u: np.ndarray):
    """Gradients of (proj, u, c) from those of the states."""
    steps, batch, h = grad.shape
    dproj = np.zeros((steps, batch, 3 * h), np.float32)
    du, dc = np.zeros_like(u), np.zeros(h, np.float32)
    dstate = np.zeros((batch, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, z, r, inner, n = saved[t]
        d = grad[t] + dstate
        live = d if mask is None else d * mask[t][:, None]
        dn = live * (1 - z) * (1 - n * n)
        dz = live * (state - n) * z * (1 - z)
        dinner = dn * r
        dr = dn * inner * r * (1 - r)
        dproj[t] = np.concatenate([dz, dr, dn], 1)
        drec = np.concatenate([dz, dr, dinner], 1)
        du += state.T @ drec
        dc += dinner.sum(0)
        dstate = drec @ u.T + live * z + (d - live)
    return dproj, du, dc
