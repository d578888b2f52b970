"""Learners that factor a table of vectors: whitening, principal, sparse and independent components, non-negative parts.

They read all rows. Of the table only sums of the model's size travel (see sums); what belongs to a row stays with it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import sums
from .draws import draw


def _signed(v: np.ndarray) -> np.ndarray:
    """The largest element of each row positive."""
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def pca(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n principal directions, strongest first, the largest element of each positive; and the mean."""
    mean, c = sums.covariance(rows)
    if n > len(c):
        raise ValueError("fewer directions than prototypes")
    return _signed(np.linalg.eigh(c)[1][:, ::-1].T[:n]), mean


@dataclass
class Whitening:
    """ZCA with a floor: rows less the mean, times V (D + floor)^-1/2 V'; and back."""

    mean: np.ndarray
    forth: np.ndarray
    back: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, floor: float = 0.1) -> Whitening:
        mean, c = sums.covariance(rows)
        d, v = np.linalg.eigh(c)
        root = np.sqrt(np.maximum(d, 0) + floor)
        return cls(mean, v / root @ v.T, v * root @ v.T)

    def transform(self, rows: DataFrame) -> DataFrame:
        mean, forth = self.mean, self.forth
        return sums.applied(rows, lambda x: (x - mean) @ forth)

    def inverse(self, rows: DataFrame) -> DataFrame:
        mean, back = self.mean, self.back
        return sums.applied(rows, lambda x: x @ back + mean)


def sparse_pca(rows: DataFrame, n: int, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Directions with soft-thresholded loadings: power steps on the covariance, which is deflated after each."""
    _, c = sums.covariance(rows)
    return sparse_directions(c, n, penalty, rounds)


def sparse_directions(c: np.ndarray, n: int, penalty: float, rounds: int) -> np.ndarray:
    """A power step on data is C v over its norm, so directions need the covariance alone; a step starts from the leading one."""
    if n > len(c):
        raise ValueError("fewer directions than prototypes")
    out, size = [], np.eye(len(c))
    for _ in range(n):
        v = np.linalg.eigh(c)[1][:, -1]
        for _ in range(rounds):
            w = c @ v
            w = np.sign(w) * np.maximum(np.abs(w) - penalty * np.abs(w).max(initial=0), 0)
            w = w / max(np.linalg.norm(w), 1e-12)
            done = np.allclose(v, w, atol=1e-10)
            v = w
            if done:
                break
        left = size - np.outer(v, v)
        c = left @ c @ left
        out.append(v)
    return _signed(np.array(out))


def _even(w: np.ndarray) -> np.ndarray:
    """The nearest orthogonal matrix."""
    u, _, t = np.linalg.svd(w)
    return u @ t


def ica(rows: DataFrame, n: int, rounds: int = 30, tol: float = 1e-6) -> np.ndarray:
    """Columns of the mixing matrix: whitening from the covariance, then a symmetric fixed point with tanh, whose expectations
    are sums over all rows. Rows of the result are signed; the strongest source comes first."""
    mean, c = sums.covariance(rows)
    d, v = np.linalg.eigh(c)
    d, v = d[::-1], v[:, ::-1]
    if n > int((d > 1e-12 * max(d[0], 1e-300)).sum()):
        raise ValueError("fewer directions than prototypes")
    whiten = v[:, :n] / np.sqrt(d[:n])
    w = _even(np.array([[draw("ica", i, j) - 0.5 for j in range(n)] for i in range(n)]))
    held = rows.select("features").persist()  # each round reads it again
    try:
        for _ in range(rounds):
            turned = whiten @ w.T

            def part(x: np.ndarray) -> np.ndarray:
                z = (x - mean) @ whiten
                y = np.tanh((x - mean) @ turned)
                return np.concatenate([[len(x)], (y.T @ z).ravel(), (1 - y * y).sum(axis=0)])

            got = sums.total(held, part, 1 + n * n + n)
            new = _even((got[1 : 1 + n * n].reshape(n, n) - got[1 + n * n :][:, None] * w) / got[0])
            done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tol
            w = new
            if done:
                break
    finally:
        held.unpersist()
    mixing = np.linalg.pinv(whiten @ w.T)
    return _signed(mixing[np.argsort(-np.linalg.norm(mixing, axis=1), kind="stable")])


def row_factors(x: np.ndarray, h: np.ndarray, steps: int = 20) -> np.ndarray:
    """Non-negative factors of rows by a fixed number of multiplicative steps from even ones: a function of the row and h alone."""
    w = np.ones((len(x), len(h)))
    xh, hh = x @ h.T, h @ h.T
    for _ in range(steps):
        w *= xh / (w @ hh + 1e-12)
    return w


def nmf(rows: DataFrame, n: int, rounds: int = 20, tol: float = 1e-4, steps: int = 20) -> tuple[np.ndarray, list[float]]:
    """Non-negative parts (n x d), each of norm 1, and the loss (squared residue over squared norm) before each round.

    A round's row factors are made where the row is and never stored; n x d and n x n products of them travel. Parts follow by
    multiplicative steps. It ends after `rounds` or when the loss falls by less than tol."""
    d = sums.dimension(rows)
    low, square, count = sums.total(rows, lambda x: np.array([float((x < 0).any()), (x * x).sum(), len(x)]), 3)
    if low:
        raise ValueError("patches must not be negative")
    h = np.array([[draw("nmf", i, j) + 0.1 for j in range(d)] for i in range(n)])
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    held, losses = rows.select("features").persist(), []
    try:
        for _ in range(rounds):

            def part(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
                w = row_factors(x, h, steps)
                return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])

            got = sums.total(held, part, n * d + n * n)
            wx, ww = got[: n * d].reshape(n, d), got[n * d :].reshape(n, n)
            losses.append(float((square - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()) / max(square, 1e-300)))
            if len(losses) > 1 and losses[-2] - losses[-1] < tol:
                break
            for _ in range(steps):
                h = h * wx / (ww @ h + 1e-12)
            h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    finally:
        held.unpersist()
    return h, losses
