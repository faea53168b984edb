"""Forward passes of small networks over ordered series, a series at a time in Arrow batches.

Weights travel with the function: a few hundred kilobytes whatever the data's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def scaled(x: np.ndarray, weights: dict) -> np.ndarray:
    return np.nan_to_num(np.clip((x - weights["mean"]) / weights["scale"], -8, 8))


def random_weights(kind: str, features: int, hidden: int = 8, seed: int = 0, layers: int = 2, heads: int = 2) -> dict:
    """Seeded weights for tests and demonstrations."""
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.normal(0, 0.3, s)
    base = {"mean": np.zeros(features), "scale": np.ones(features), "Wo": w(hidden), "bo": float(w(1)[0])}
    if kind in ("gru", "lstm"):
        k = 3 if kind == "gru" else 4
        return base | {"Wih": w(k * hidden, features), "Whh": w(k * hidden, hidden), "bih": w(k * hidden), "bhh": w(k * hidden)}
    if kind == "cnn":
        return base | {"blocks": [{"W": w(hidden, features if b == 0 else hidden, 3), "b": w(hidden), "dilation": 2**b} for b in range(layers)]}
    block = lambda: {"q": w(hidden, hidden), "k": w(hidden, hidden), "v": w(hidden, hidden), "o": w(hidden, hidden), "up": w(2 * hidden, hidden), "down": w(hidden, 2 * hidden)}
    return base | {"We": w(hidden, features), "heads": heads, "layers": [block() for _ in range(layers)]}


def gru(x: np.ndarray, w: dict) -> np.ndarray:
    """Logit per step; the reset gate multiplies the hidden part of the candidate, bias included."""
    h = np.zeros(len(w["Wo"]))
    out = np.empty(len(x))
    gates = scaled(x, w) @ w["Wih"].T + w["bih"]
    for t, gi in enumerate(gates):
        gh = w["Whh"] @ h + w["bhh"]
        (ir, iz, i_n), (hr, hz, hn) = np.split(gi, 3), np.split(gh, 3)
        r, z = _sigmoid(ir + hr), _sigmoid(iz + hz)
        h = (1 - z) * np.tanh(i_n + r * hn) + z * h
        out[t] = w["Wo"] @ h + w["bo"]
    return out


def lstm(x: np.ndarray, w: dict) -> np.ndarray:
    """Logit per step; gates in the order input, forget, cell, output."""
    h = c = np.zeros(len(w["Wo"]))
    out = np.empty(len(x))
    gates = scaled(x, w) @ w["Wih"].T + w["bih"]
    for t, gi in enumerate(gates):
        i, f, g, o = np.split(gi + w["Whh"] @ h + w["bhh"], 4)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[t] = w["Wo"] @ h + w["bo"]
    return out


def cnn(x: np.ndarray, w: dict) -> np.ndarray:
    """Logit per step of causal dilated convolutions with tanh, residual where shapes agree."""
    y = scaled(x, w).T
    for b in w["blocks"]:
        k = b["W"].shape[2]
        pad = np.pad(y, ((0, 0), ((k - 1) * b["dilation"], 0)))
        z = sum(b["W"][:, :, j] @ pad[:, j * b["dilation"] : j * b["dilation"] + y.shape[1]] for j in range(k))
        z = np.tanh(z + b["b"][:, None])
        y = z + y if z.shape == y.shape else z
    return w["Wo"] @ y + w["bo"]


def attention(x: np.ndarray, w: dict) -> np.ndarray:
    """Logit per step of causal multi-head attention blocks; missing inputs are zero before scaling."""
    h = np.clip((np.nan_to_num(x) - w["mean"]) / w["scale"], -8, 8) @ w["We"].T
    t, d = h.shape
    n = w["heads"]
    mask = np.triu(np.full((t, t), -np.inf), 1)
    norm = lambda a: (a - a.mean(axis=1, keepdims=True)) / np.sqrt(a.var(axis=1, keepdims=True) + 1e-5)
    for b in w["layers"]:
        a = norm(h)
        q, k, v = (np.moveaxis((a @ b[c].T).reshape(t, n, d // n), 1, 0) for c in "qkv")
        s = q @ np.swapaxes(k, 1, 2) / np.sqrt(d / n) + mask
        p = np.exp(s - s.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        h = h + np.moveaxis(p @ v, 0, 1).reshape(t, d) @ b["o"].T
        h = h + np.maximum(norm(h) @ b["up"].T, 0) @ b["down"].T
    return h @ w["Wo"] + w["bo"]


KINDS = {"gru": gru, "lstm": lstm, "cnn": cnn, "attention": attention}


def forward(features: DataFrame, kind: str, columns: list[str], weights: dict) -> DataFrame:
    """(id, t, logit) of ``features(id, t, columns...)``."""
    net = KINDS[kind]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        return pd.DataFrame({"id": g.id.values, "t": g.t.values, "logit": net(g[columns].to_numpy(dtype=float), weights)})

    return features.select("id", "t", *columns).groupBy("id").applyInPandas(one, "id long, t long, logit double")
