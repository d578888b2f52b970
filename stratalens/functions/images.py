"""Images as arrays: grey values, resizing, pyramids, PNG, spectra and noise.

Resampling is separable, with a Lanczos-3 window widened by the reduction when an image
shrinks and a cubic (a = -0.5) when it grows."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..params import Params, ResizeMethod


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Values in [0, 1] of Spark's image bytes (blue, green, red): rounded luma of colour, over 255."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        b, g, r = (x[..., i].astype(np.float64) for i in range(3))
        x = np.floor((299 * r + 587 * g + 114 * b) / 1000 + 0.5)
    else:
        x = x[..., 0]
    return (x / 255).astype(np.float32)


def _weights(old: int, new: int) -> np.ndarray:
    scale = old / new
    reach = max(scale, 1.0)
    support = 3 if scale > 1 else 2
    at = (np.arange(new) + 0.5) * scale - 0.5
    t = np.abs(at[:, None] - np.arange(old)[None, :]) / reach
    if scale > 1:
        w = np.where(t < support, np.sinc(t) * np.sinc(t / 3), 0)
    else:
        w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    if x.shape == (height, width):
        return x
    return (_weights(x.shape[0], height) @ x.astype(np.float64) @ _weights(x.shape[1], width).T).astype(np.float32)


def target_size(p: Params, height: int, width: int) -> tuple[int, int]:
    """(height, width) that a resize policy gives; sizes are truncated to whole pixels."""
    n, method = p.image_resize_length, p.image_resize_method
    if method is ResizeMethod.NONE:
        return height, width
    if method is ResizeMethod.SCALE_AND_CROP:
        return int(n / p.image_resize_aspect_ratio), n
    base = {ResizeMethod.SHORT_EDGE: min(height, width), ResizeMethod.LONG_EDGE: max(height, width), ResizeMethod.WIDTH: width, ResizeMethod.HEIGHT: height}[method]
    return int(height * n / base), int(width * n / base)


def prepare(x: np.ndarray, p: Params) -> np.ndarray:
    height, width = target_size(p, *x.shape)
    if p.image_resize_method is not ResizeMethod.SCALE_AND_CROP:
        return resize(x, height, width)
    ratio = max(height / x.shape[0], width / x.shape[1])
    big = resize(x, max(height, round(x.shape[0] * ratio)), max(width, round(x.shape[1] * ratio)))
    top, left = (big.shape[0] - height) // 2, (big.shape[1] - width) // 2
    return big[top : top + height, left : left + width]


def pyramid(x: np.ndarray, levels: int, factor: float) -> list[np.ndarray]:
    """Each level is made of the one before it; its sides are rounded."""
    if not 0 < factor <= 1:
        raise ValueError("a pyramid's factor is above 0 and at most 1")
    out = [x]
    while len(out) < levels:
        h, w = (round(s * factor) for s in out[-1].shape)
        out.append(resize(out[-1], h, w))
    return out[:levels]


def png(x: np.ndarray) -> bytes:
    """An 8-bit grey PNG of values in [0, 1]."""
    rows = np.clip(x * 255, 0, 255).astype(np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def power_spectrum(x: np.ndarray, width: int | None = None) -> np.ndarray:
    width = width or min(x.shape)
    return np.abs(np.fft.fftshift(np.fft.fft2(x, (width, width)))) ** 2


def radial_spectrum(x: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies in cycles per pixel, summed power and the number of coefficients, by whole radius about the spectrum's middle;
    the first and the last radius are left out, and those beyond half the side."""
    power = power_spectrum(x, width)
    side = len(power)
    at = np.arange(side) - (side - 1) / 2
    r = np.hypot(*np.meshgrid(at, at, indexing="ij")).astype(int).ravel()
    keep = slice(1, min(r.max(), side // 2 + 1))
    total, count = np.bincount(r, power.ravel())[keep], np.bincount(r)[keep]
    return np.arange(len(total)) / side, total, count


def one_over_f_noise(shape: tuple[int, int], beta: float, seed: int) -> np.ndarray:
    """Noise whose power falls as frequency to the power beta (negative), its mean 0."""
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(shape[0]), np.fft.fftfreq(shape[1]), indexing="ij"))
    f[0, 0] = np.inf
    phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, shape)
    return np.real(np.fft.ifft2(f ** (beta / 2) * np.exp(1j * phase)))
