"""Layers in numpy with their own gradients: linear, layer norm, GELU, dropout, and a perceptron of them.

A forward pass returns the result and what its backward pass needs. Parameters are a dict of arrays by name.
"""

import math

import numpy as np

_STEP = 12 / 4096
_AT = np.linspace(-6, 6, 4097)
_ERF = np.array([math.erf(x) for x in _AT])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_AT * _AT)


def erf(x: np.ndarray) -> np.ndarray:
    """Between exact values and slopes 12/4096 apart, to 1e-11."""
    x = np.clip(x, -6, 6)
    k = np.minimum(((x + 6) / _STEP).astype(np.int64), 4095)
    t = (x - _AT[k]) / _STEP
    a, b = _ERF[k], _ERF[k + 1]
    return a + t * t * (3 - 2 * t) * (b - a) + _STEP * t * (1 - t) * ((1 - t) * _SLOPE[k] - t * _SLOPE[k + 1])


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution at x, and the slope."""
    p = (1 + erf(x / math.sqrt(2))) / 2
    return x * p, p + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, least: float = 1e-5):
    """Over the last axis, by the population's variance."""
    off = x - x.mean(-1, keepdims=True)
    scale = 1 / np.sqrt((off * off).mean(-1, keepdims=True) + least)
    y = off * scale
    return y * gain + shift, (y, scale, gain)


def layer_norm_back(d: np.ndarray, kept):
    y, scale, gain = kept
    dy = d * gain
    dx = (dy - dy.mean(-1, keepdims=True) - y * (dy * y).mean(-1, keepdims=True)) * scale
    return dx, (d * y).sum(0), d.sum(0)


def unit(x: np.ndarray, least: float = 1e-12):
    n = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), least)
    return x / n, (x / n, n)


def unit_back(d: np.ndarray, kept):
    y, n = kept
    return (d - y * (d * y).sum(-1, keepdims=True)) / n


class Perceptron:
    """Linear layers with layer norm, GELU and dropout between them, and none after the last."""

    def __init__(self, widths: list[int], dropout: float = 0.1, seed: int = 0):
        r = np.random.default_rng(seed)
        self.widths, self.dropout, self.p = widths, dropout, {}
        for k, (m, n) in enumerate(zip(widths, widths[1:])):
            bound = 1 / math.sqrt(m)
            self.p[f"w{k}"], self.p[f"b{k}"] = r.uniform(-bound, bound, (m, n)), r.uniform(-bound, bound, n)
            if k < len(widths) - 2:
                self.p[f"g{k}"], self.p[f"s{k}"] = np.ones(n), np.zeros(n)

    def forward(self, x: np.ndarray, rng=None):
        """rng: where dropout takes its choice from; without one there is none."""
        kept, last = [], len(self.widths) - 2
        for k in range(last + 1):
            z = x @ self.p[f"w{k}"] + self.p[f"b{k}"]
            if k == last:
                kept.append((x,))
                x = z
                continue
            n, ln = layer_norm(z, self.p[f"g{k}"], self.p[f"s{k}"])
            a, slope = gelu(n)
            mask = (rng.random(a.shape) >= self.dropout) / (1 - self.dropout) if rng is not None and self.dropout else 1.0
            kept.append((x, ln, slope, mask))
            x = a * mask
        return x, kept

    def backward(self, d: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        grad = {}
        for k in range(len(kept) - 1, -1, -1):
            if k < len(kept) - 1:
                _, ln, slope, mask = kept[k]
                d, grad[f"g{k}"], grad[f"s{k}"] = layer_norm_back(d * mask * slope, ln)
            grad[f"w{k}"], grad[f"b{k}"] = kept[k][0].T @ d, d.sum(0)
            d = d @ self.p[f"w{k}"].T
        return grad, d
