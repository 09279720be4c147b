"""Frozen parameter sets. The defaults are part of the semantics, and every
set validates its own domain before a plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class StarRadius:
    """Magnitude-dependent exclusion radius, arcsec.

    ``null_mag``: what a star without a magnitude gets. "mag0" substitutes the
    pivot magnitude, "r0" uses the unclipped pivot radius, "null" leaves it NULL.
    """

    r0: float = 8.0
    mag0: float = 15.0
    min_radius: float = 1.0
    max_radius: float = 40.0
    null_mag: str = "mag0"

    def __post_init__(self) -> None:
        _require(self.r0 > 0, "r0 must be > 0")
        _require(self.min_radius > 0, "min_radius must be > 0")
        _require(self.max_radius > 0, "max_radius must be > 0")
        _require(self.min_radius <= self.max_radius, "min_radius must be <= max_radius")
        _require(self.null_mag in ("mag0", "r0", "null"), "null_mag must be mag0, r0 or null")


@dataclass(frozen=True)
class QualityCuts:
    flags_max: float = 3.0
    point_min_criteria: int = 3
    point_delta_mag_max: float = 0.3
    point_fwhm_ratio_max: float = 1.35
    point_axis_ratio_min: float = 0.75
    point_kron_max: float = 3.8
    faint_margin_mag: float = 0.5
    faint_magerr_cog_max: float = 0.2
    faint_magerr_auto_max: float = 0.2
    disable_point: bool = False
    disable_faint: bool = False

    def __post_init__(self) -> None:
        _require(self.point_min_criteria > 0, "point_min_criteria must be > 0")
        _require(self.point_fwhm_ratio_max > 0, "point_fwhm_ratio_max must be > 0")
        _require(self.point_axis_ratio_min > 0, "point_axis_ratio_min must be > 0")
        _require(self.point_kron_max > 0, "point_kron_max must be > 0")


@dataclass(frozen=True)
class FootprintCone:
    padding_deg: float = 0.05
    max_radius_deg: float = 2.0

    def __post_init__(self) -> None:
        _require(self.padding_deg >= 0, "padding_deg must be >= 0")
        _require(self.max_radius_deg > 0, "max_radius_deg must be > 0")


@dataclass(frozen=True)
class KronCutout:
    """Square stamp whose half size follows the catalog Kron radius."""

    kron_multiplier: float = 12.0
    default_kron_radius: float = 3.5
    min_half_size: int = 12
    max_half_size: int = 1024
    max_sources: int | None = None
    min_snr: float | None = None
    min_kron_pix: float | None = None

    def __post_init__(self) -> None:
        _require(self.kron_multiplier > 0, "kron_multiplier must be > 0")
        _require(self.default_kron_radius > 0, "default_kron_radius must be > 0")
        _require(self.min_half_size > 0, "min_half_size must be > 0")
        _require(self.max_sources is None or self.max_sources > 0, "max_sources must be > 0")
        _require(self.min_snr is None or math.isfinite(self.min_snr), "min_snr must be finite")
        _require(
            self.min_kron_pix is None or (math.isfinite(self.min_kron_pix) and self.min_kron_pix >= 0),
            "min_kron_pix must be finite and >= 0",
        )


@dataclass(frozen=True)
class SourceCutout:
    """Stamp size for detected sources: Kron-scaled or fixed half size."""

    mode: str = "kron"
    size_mult: float = 2.0
    fixed_half: float = 96.0
    min_half: float = 64.0
    max_half: float = 512.0

    def __post_init__(self) -> None:
        _require(self.mode in ("kron", "fixed"), "mode must be kron or fixed")


@dataclass(frozen=True)
class Coadd:
    mask_nonfinite: bool = True
    allow_nonpositive_weight: bool = False
    weight_floor: float = 0.0
    sigma: float | None = None
    max_iters: int = 5
    err_mode: str = "from-wht"
    empty: str = "nan"
    output_type: str = "float32"

    def __post_init__(self) -> None:
        _require(self.err_mode in ("from-wht", "nan", "inf", "zero"), "unknown err_mode")
        _require(self.empty in ("nan", "zero"), "empty must be nan or zero")
        _require(self.output_type in ("float32", "float64"), "output_type must be float32 or float64")


@dataclass(frozen=True)
class StarMask:
    shape: str = "star12"
    rotation_deg: float = 0.0
    xshift_pix: float = 0.0
    yshift_pix: float = 0.0
    radius: StarRadius = StarRadius(null_mag="r0")

    def __post_init__(self) -> None:
        _require(self.shape in ("circle", "star4", "star8", "star12", "jwst"), "unknown mask shape")


@dataclass(frozen=True)
class Detection:
    threshold_sigma: float = 3.0
    npixels: int = 5
    connectivity: int = 8
    smooth_fwhm: float = 2.0

    def __post_init__(self) -> None:
        _require(self.connectivity in (4, 8), "connectivity must be 4 or 8")
        _require(self.npixels > 0, "npixels must be > 0")


@dataclass(frozen=True)
class Extraction:
    nsigma: float = 2.5
    npixels: int = 50
    box_size: int = 64
    filter_size: int = 3
    kernel_fwhm: float = 2.0
    tile_max: int = 0
    tile_overlap: int = 200
    mosaic_cutout: int = 0
    deblend: bool = False
    deblend_levels: int = 32
    deblend_contrast: float = 0.001

    def __post_init__(self) -> None:
        _require(self.deblend_levels >= 1, "deblend_levels must be >= 1")
        _require(0 <= self.deblend_contrast <= 1, "deblend_contrast must be between 0 and 1")
        _require(not (self.tile_max > 0 and self.mosaic_cutout > 0), "tiling and mosaic cutout are exclusive")


@dataclass(frozen=True)
class MatchedFilter:
    threshold_sigma: float = 5.0
    min_separation: float = 5.0
    fit_window_scale: float = 1.0
    min_fit_corr: float = 0.2
    max_fit_rms_ratio: float = 1.0
    scale_min: float = 0.85
    scale_max: float = 1.15
    scale_steps: int = 7

    def __post_init__(self) -> None:
        _require(self.scale_steps >= 1, "scale_steps must be >= 1")
        _require(self.scale_min > 0 and self.scale_max > 0, "scales must be > 0")
        _require(self.scale_min <= self.scale_max, "scale_min must be <= scale_max")


@dataclass(frozen=True)
class Morphology:
    top_fetch: int = 5000
    top_save: int = 100
    snr_min: float = 30.0
    extended_prob_min: float = 0.9
    point_like_prob_max: float = 0.1
    fwhm_min: float = 0.25
    size_factor: float = 6.0
    size_min: float = 3.0
    size_max: float = 15.0


@dataclass(frozen=True)
class RgbStretch:
    p_low: float = 4.2
    p_high: float = 99.99
    asinh_a: float = 20.0
    gamma: float = 0.6
    r_gain: float = 0.36
    g_gain: float = 0.46
    b_gain: float = 0.36

    def __post_init__(self) -> None:
        _require(self.p_high > self.p_low, "p_high must be > p_low")
        _require(self.asinh_a > 0 and self.gamma > 0, "asinh_a and gamma must be > 0")
        _require(min(self.r_gain, self.g_gain, self.b_gain) > 0, "channel gains must be > 0")
