"""Hashed character n-grams of whole texts, and logistic regression over sparse rows."""

from __future__ import annotations

import numpy as np

from . import textkernel as K

_MULT = K._stream(53, 16).astype(np.uint32) | np.uint32(1)


def _lower(text: str) -> str:
    """Lower case one for one, without regard to neighbours: documents stand side by side here."""
    return text.replace("Σ", "σ").replace("İ", "i").lower()


def codepoints(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of a chunk, and the offsets of its documents in them."""
    text = chunk.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(_lower(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[chunk.offsets]


def grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket, below 2**bits, of the n-gram that begins at each code point but the last n - 1."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = points[:m] * _MULT[0]
    h += np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
    for j in range(1, n):
        h += points[j : m + j] * _MULT[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - bits)


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, n_cols: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse rows by full-batch Adam; rows must be sorted."""
    w, b = np.zeros(n_cols), 0.0
    m, v = np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols] * values, len(y)) + b
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.append(np.bincount(cols, values * gap[rows], n_cols) + l2 * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)
