"""The normal distribution function and its inverse on arrays, and keyed random numbers for whole batches."""

from __future__ import annotations

import numpy as np

_ROOT = np.sqrt(2 * np.pi)
#: Terms of the series for small arguments and of the continued fraction for large ones.
SERIES, FRACTION, SWITCH = 70, 60, 3.0


def cdf(x) -> np.ndarray:
    """Phi: by its power series about zero, beyond ``SWITCH`` by the continued fraction of the tail; missing stays missing."""
    x = np.asarray(x, float)
    a = np.abs(x)
    near = np.minimum(np.where(np.isnan(a), 0.0, a), SWITCH)
    term, total = near.copy(), near.copy()
    for k in range(1, SERIES):
        term = term * near * near / (2 * k + 1)
        total = total + term
    upper = 0.5 - np.exp(-0.5 * near * near) / _ROOT * total
    far = np.maximum(np.where(np.isfinite(a), a, SWITCH), SWITCH)
    below = far.copy()
    for k in range(FRACTION, 0, -1):
        below = far + k / below
    tail = np.exp(-0.5 * far * far) / _ROOT / below
    upper = np.where(a > SWITCH, np.where(np.isinf(a), 0.0, tail), upper)
    return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - upper, upper))


def quantile(p) -> np.ndarray:
    """The inverse of ``cdf``: a rational start, then Halley steps; infinite at zero and one, missing outside."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, np.minimum(p, 1 - p), 0.25)
    t = np.sqrt(-2 * np.log(q))
    # A published rational start, right to 5e-4.
    x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    for _ in range(4):
        error = (cdf(x) - q) * _ROOT * np.exp(0.5 * x * x)
        x = x - error / (1 + 0.5 * x * error)
    x = np.where(p > 0.5, -x, x)
    return np.where(inside, x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def uniforms(keys: np.ndarray, n: int, seed: int, stream: int = 0) -> np.ndarray:
    """Numbers in (0, 1) for each key and draw, from a counter that is mixed in 64 bits; the same wherever a key's row lies."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        z = _mixed(z + np.uint64(seed % (1 << 32)) * np.uint64(0xD1342543DE82EF95) + np.uint64(stream) * np.uint64(0x2545F4914F6CDD1D))
        z = _mixed(z + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def normals(keys: np.ndarray, n: int, seed: int, stream: int = 0) -> np.ndarray:
    radius = np.sqrt(-2 * np.log(uniforms(keys, n, seed, stream)))
    return radius * np.cos(2 * np.pi * uniforms(keys, n, seed, stream + 1))


def gammas(keys: np.ndarray, shape: np.ndarray, seed: int, stream: int = 0) -> np.ndarray:
    """Gamma numbers of unit scale by squeezed rejection, round by round for what is still open."""
    n = shape.shape[1]
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_, turn = np.zeros(shape.shape), np.ones(shape.shape, bool), 0
    while open_.any():
        x, u = normals(keys, n, seed, stream + 3 * turn), uniforms(keys, n, seed, stream + 3 * turn + 2)
        v = (1 + c * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = open_ & (v > 0) & (np.log(u) < 0.5 * x * x + d * (1 - v + np.log(v)))
        out = np.where(good, d * v, out)
        open_ &= ~good
        turn += 1
    small = shape < 1
    return np.where(small, out * uniforms(keys, n, seed, stream + 10_000) ** (1 / np.where(small, shape, 1.0)), out)


def counts(u: np.ndarray, start: np.ndarray, ratio) -> np.ndarray:
    """Whole numbers by inversion: ``start`` is the probability of 0, ``ratio(k)`` that of k by that of k - 1."""
    k, p = np.zeros(u.shape), np.broadcast_to(start, u.shape).copy()
    upto, step = p.copy(), 0
    while (more := (u > upto) & (p > 0)).any():
        k += more
        step += 1
        p = p * ratio(step)
        upto = upto + p
    return k
