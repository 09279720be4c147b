"""Small arrays built on the driver: kernels, synthetic PSFs, scaled templates.
All of them are bounded by the template size, never by the data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_kernel(sigma: float, size: int | None = None) -> np.ndarray:
    """Unit-sum Gaussian sampled at pixel centres; default side is 8 sigma
    rounded up to odd."""
    if size is None:
        size = int(math.ceil(8.0 * sigma))
        size += 1 - size % 2
    c = (size - 1) / 2.0
    g = np.exp(-0.5 * ((np.arange(size) - c) / sigma) ** 2)
    k = np.outer(g, g)
    return k / k.sum()


def detection_filter(fwhm: float) -> np.ndarray:
    """Smoothing filter of the dual-image detector: sigma >= 0.5 px, side about
    6 sigma."""
    sigma = max(fwhm / 2.355, 0.5)
    size = int(math.ceil(6.0 * sigma))
    return gaussian_kernel(sigma, max(3, size + 1 - size % 2))


def gaussian_psf(size: int = 33, fwhm_pix: float = 3.0) -> np.ndarray:
    if size < 7:
        raise ValueError("PSF size must be >= 7")
    if fwhm_pix <= 0:
        raise ValueError("PSF FWHM must be > 0")
    return gaussian_kernel(fwhm_pix / 2.3548200450309493, size + 1 - size % 2).astype("float32")


def _spline_matrix(n: int) -> np.ndarray:
    """Cubic B-spline collocation on n samples with mirrored ends."""
    m = np.zeros((n, n))
    for i in range(n):
        m[i, i] += 4.0 / 6.0
        m[i, abs(i - 1)] += 1.0 / 6.0
        m[i, n - 1 - abs(n - 2 - i)] += 1.0 / 6.0
    return m


def _spline_resample(n_in: int, n_out: int, pad: int = 12) -> np.ndarray:
    """Linear map from n_in samples to n_out samples: edge padding, cubic
    B-spline coefficients, evaluation on an even grid over the same span."""
    padded = np.zeros((n_in + 2 * pad, n_in))
    padded[np.arange(n_in + 2 * pad), np.clip(np.arange(-pad, n_in + pad), 0, n_in - 1)] = 1.0
    coefficients = np.linalg.solve(_spline_matrix(n_in + 2 * pad), padded)
    at = np.linspace(0.0, n_in - 1.0, n_out) + pad
    base = np.floor(at).astype(int)
    t = at - base
    weights = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6,
               (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    out = np.zeros((n_out, n_in))
    for k, w in enumerate(weights):
        out += w[:, None] * coefficients[base + k - 1]
    return out


def resize_template(template: np.ndarray, scale: float) -> np.ndarray:
    """Cubic-spline zoom of a small template."""
    if np.isclose(scale, 1.0):
        return template.copy()
    shape = [int(round(n * scale)) for n in template.shape]
    if min(shape) < 3:
        raise ValueError(f"scaled template too small at scale={scale:.3f}")
    rows = _spline_resample(template.shape[0], shape[0])
    cols = _spline_resample(template.shape[1], shape[1])
    return rows @ template @ cols.T


def unit_template(template: np.ndarray) -> np.ndarray:
    """Median-subtracted, unit-norm template."""
    t = template - np.median(template)
    norm = math.sqrt(float((t * t).sum()))
    if norm <= 0:
        raise ValueError("template has no structure")
    return t / norm


def template_set(template: np.ndarray, lo: float, hi: float, steps: int) -> list[np.ndarray]:
    filled = np.where(np.isfinite(template), template, 0.0)
    return [unit_template(resize_template(filled, s)) for s in np.linspace(lo, hi, steps)]


def kernel_table(df: DataFrame, sigma: str, size: int) -> DataFrame:
    """Rows (..., dy, dx, weight) of a unit-sum Gaussian per input row."""
    r = size // 2
    s = F.col(sigma)
    line = F.sequence(F.lit(-r), F.lit(r))
    # The kernel is separable, so its sum is the square of a one-axis sum.
    total = F.aggregate(line, F.lit(0.0), lambda t, i: t + F.exp(-0.5 * i * i / (s * s)))
    cells = df.withColumn("_n", total * total).withColumn("dy", F.explode(line)).withColumn("dx", F.explode(line))
    d2 = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return cells.withColumn("weight", F.exp(-0.5 * d2 / (s * s)) / F.col("_n")).drop("_n")
