"""Filter kernels. A bank is small: a list of rows (kernel, band, ky, kx, w) that is broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BANK = "kernel int, band int, ky int, kx int, w double"


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled to norm 1; a zero array becomes constant."""
    n = np.sqrt((x * x).sum())
    return x / n if n else np.full_like(x, 1 / np.sqrt(x.size))


def gabor(kwidth: int, theta: float, gamma: float = 0.6, phi: float = 0.0, wavelength: float | None = None, sigma: float | None = None, normed: bool = True) -> np.ndarray:
    """A sine along theta under a Gaussian window, about the centre: an odd function at phase 0."""
    wavelength = kwidth / 4 if wavelength is None else wavelength
    sigma = wavelength / 2 if sigma is None else sigma
    at = np.arange(kwidth) - (kwidth - 1) / 2
    y, x = np.meshgrid(at, at, indexing="ij")
    along, across = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
    k = np.exp(-(along**2 + (gamma * across) ** 2) / (2 * sigma**2)) * np.sin(2 * np.pi * along / wavelength + phi)
    return unit(k) if normed else k


def gabor_bank(kwidth: int, orientations: int, phases: int = 1, shift: bool = True, normed: bool = True) -> np.ndarray:
    """(orientation, phase, y, x)."""
    thetas = np.pi / orientations * (np.arange(orientations) + 0.5 * shift)
    return np.array([[gabor(kwidth, t, phi=2 * np.pi * j / phases, normed=normed) for j in range(phases)] for t in thetas])


def multi_scale_bank(kwidth: int, scales: int, orientations: int, phases: int = 1, shift: bool = True, embed: int | None = None, normed: bool = True) -> np.ndarray:
    """(scale, orientation, phase, y, x): window deviations spread from kwidth / 8 to less than kwidth / 2, wavelengths
    twice those, all in arrays of the same width, embed if that is given."""
    thetas = np.pi / orientations * (np.arange(orientations) + 0.5 * shift)
    sigmas = kwidth / 4 * (0.5 + 1.5 * np.arange(scales) / scales)
    return np.array([[[gabor(embed or kwidth, t, phi=2 * np.pi * j / phases, wavelength=2 * s, sigma=s, normed=normed) for j in range(phases)] for t in thetas] for s in sigmas])


def random_bank(n: int, shape: tuple[int, ...], seed: int, normed: bool = True, mean: float = 0.0, std: float = 0.15) -> np.ndarray:
    k = np.random.default_rng(seed).normal(mean, std, (n, *shape))
    return np.array([unit(x) for x in k]) if normed else k


def uniform_bank(n: int, shape: tuple[int, ...], seed: int, low: float = 0.0, high: float = 1.0, normed: bool = True) -> np.ndarray:
    if low >= high:
        raise ValueError("low must be below high")
    k = np.random.default_rng(seed).uniform(low, high, (n, *shape))
    return np.array([unit(x) for x in k]) if normed else k


def blackman(n: int) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t)


def blackman2d(n: int) -> np.ndarray:
    return np.outer(blackman(n), blackman(n))


def lanczos(a: int = 3) -> np.ndarray:
    """The (2a + 1)-square product of windowed sincs, which sums to 1."""
    t = np.arange(-a, a + 1)
    k = np.outer(np.sinc(t) * np.sinc(t / a), np.sinc(t) * np.sinc(t / a)) if a > 0 else np.ones((1, 1))
    return k / k.sum()


def rows(bank: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """A (kernel, band, y, x) or (kernel, y, x) bank as rows."""
    bank = bank[:, None] if bank.ndim == 3 else bank
    return [(*map(int, at), float(bank[at])) for at in np.ndindex(*bank.shape)]


def frame(spark: SparkSession, bank: np.ndarray) -> DataFrame:
    return spark.createDataFrame(rows(bank), BANK)


def array(bank: DataFrame) -> np.ndarray:
    """The bank of a table of rows, (kernel, band, y, x)."""
    held = bank.collect()  # a bank is small
    out = np.zeros(tuple(1 + max(r[c] for r in held) for c in ("kernel", "band", "ky", "kx")))
    for r in held:
        out[r["kernel"], r["band"], r["ky"], r["kx"]] = r["w"]
    return out


def gabor_fill(sigma: float, theta: float, phi: float, gamma: float, wavelength: float, height: int, width: int) -> np.ndarray:
    """A Gabor function on a grid whose centre is half its sides."""
    y, x = np.mgrid[:height, :width].astype(float)
    y, x = y - height / 2, x - width / 2
    across, along = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
    return np.exp(-(across**2 + gamma**2 * along**2) / (2 * sigma**2)) * np.sin(phi + 2 * np.pi * across / wavelength)


def orientation_line(orientation: int, orientations: int = 8, kwidth: int = 11, shifted: bool = False) -> np.ndarray:
    """A line through the centre in the direction of an orientation's stripes, 1 on 0."""
    if not 0 <= orientation < orientations:
        raise ValueError("no such orientation")
    theta, half = np.pi / orientations * (orientation + 0.5 * shifted), kwidth // 2
    steps = np.arange(-half, half + 1)
    flat = abs(np.cos(theta)) >= abs(np.sin(theta))
    slope = np.tan(theta) if flat else 1 / np.tan(theta)
    other = np.clip(np.rint(steps * slope).astype(int) + half, 0, kwidth - 1)
    out = np.zeros((kwidth, kwidth))
    out[(steps + half, other) if flat else (other, steps + half)] = 1
    return out
