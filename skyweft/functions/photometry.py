"""Photometric and sizing projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KronCutout, Morphology, SourceCutout
from .sky import ARCSEC, clamp, col

# Fixed value: magnitude error to signal-to-noise, 2.5 / ln(10).
ERR_TO_SNR = 1.0857362047581296


def positive(c: Column | str) -> Column:
    """The value where it is > 0, else NULL."""
    return F.when(col(c) > 0.0, col(c))


def surface_brightness(
    a_world="a_world", b_world="b_world", kron_radius="kron_radius",
    mag_2arc="mag_2arc", magerr_2arc="magerr_2arc", mag_cog="mag_cog", magerr_cog="magerr_cog",
) -> dict[str, Column]:
    a = positive(a_world) * ARCSEC * positive(kron_radius)
    b = positive(b_world) * ARCSEC * positive(kron_radius)
    area = positive(F.lit(math.pi) * a * b)
    return {
        "area_kron_arcsec2": area,
        "mu_2arc": col(mag_2arc) + 2.5 * math.log10(math.pi),
        "snr_sb_2arc": F.lit(ERR_TO_SNR) / positive(magerr_2arc),
        "mu_cog_kron": col(mag_cog) + 2.5 * F.log10(area),
        "snr_sb_cog": F.lit(ERR_TO_SNR) / positive(magerr_cog),
    }


def kron_pixels(kron_radius, a_world, pixel_scale: float | Column) -> Column:
    """Guarded form: NULL unless every factor is positive."""
    return positive(positive(kron_radius) * (positive(a_world) * ARCSEC / positive(col(pixel_scale))))


def kron_pixels_plain(kron_radius, a_world, pixel_scale: float | Column) -> Column:
    """Bare product, any sign."""
    return col(kron_radius) * (col(a_world) * ARCSEC / col(pixel_scale))


def kron_half_size(kron_radius, cfg: KronCutout = KronCutout()) -> Column:
    """Half size in pixels from the unit-less Kron radius."""
    half = F.ceil(F.lit(cfg.kron_multiplier) * col(kron_radius)).cast("int")
    half = F.greatest(F.lit(cfg.min_half_size), half)
    if cfg.max_half_size > 0:
        half = F.least(F.lit(cfg.max_half_size), half)
    return F.when(col(kron_radius).isNotNull(), half)


def source_half_size(kron, sma, cfg: SourceCutout = SourceCutout()) -> Column:
    fixed = F.lit(cfg.fixed_half)
    half = F.coalesce(F.lit(cfg.size_mult) * col(kron) * col(sma), fixed) if cfg.mode == "kron" else fixed
    return clamp(half, cfg.min_half, cfg.max_half)


def stamp_pixels(half: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(2.0 * half).cast("int"))


def stamp_size_arcsec(fwhm, cfg: Morphology = Morphology()) -> Column:
    return clamp(F.lit(cfg.size_factor) * col(fwhm), cfg.size_min, cfg.size_max)


def size_to_radius_deg(size, unit: str = "arcsec", mode: str = "diameter") -> Column:
    to_deg = {"arcsec": 1.0 / 3600.0, "arcmin": 1.0 / 60.0, "deg": 1.0}[unit]
    return col(size) * to_deg / (2.0 if mode == "diameter" else 1.0)


def asinh_stretch(value, low, high, softening: float) -> Column:
    """Scale [low, high] to [0, 1] through asinh. Missing values give 0; an
    empty or inverted range gives 0 everywhere."""
    lo, hi = col(low), col(high)
    norm = F.try_divide(col(value) - lo, hi - lo)
    norm = clamp(F.coalesce(F.nanvl(norm, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0)
    out = clamp(F.asinh(F.lit(softening) * norm) / F.asinh(F.lit(softening)), 0.0, 1.0)
    return F.when(F.coalesce(hi > lo, F.lit(False)), out).otherwise(F.lit(0.0))


def ellipse_axes(equivalent_radius, elongation) -> tuple[Column, Column]:
    """Axes that keep the equal-area radius: a = r sqrt(e), b = r / sqrt(e)."""
    root = F.sqrt(positive(elongation))
    return positive(equivalent_radius) * root, positive(equivalent_radius) / root
