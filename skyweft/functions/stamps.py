"""Star-mask shapes as unions of bars and discs, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import StarMask
from .sky import star_radius_arcsec

# The mask geometry, as fractions of the star's base radius
# unless named otherwise.
RADIUS_SCALE = 1.10

HEX_CORE = 0.72
HEX_SPIKE_LENGTH = 1.20
HEX_SPIKE_HALF_WIDTH = 0.12
HEX_SPIKE_HALF_WIDTH_MIN_PIX = 2.0

ARM_CORE = 0.45
ARM_HALF_WIDTH = 0.10
ARM_HALF_WIDTH_MIN_PIX = 3.2
MAIN_ARM_LENGTH = 1.10
DIAGONAL_ARM_LENGTH = 0.80
DIAGONAL_ARM_WIDTH_SCALE = 0.75
ARM_LENGTH_SCALE = {0.0: 0.40, 180.0: 0.28}
ARM_ANGLES = {
    "star4": [0.0, 90.0, 180.0, 270.0],
    "star8": [0.0, 90.0, 180.0, 270.0, 45.0, 135.0, 225.0, 315.0],
    "star12": [0.0, 30.0, 90.0, 150.0, 180.0, 210.0, 270.0, 330.0],
}

PIVOT_PIX = 18.0
CORE_FAINT_SCALE_MAX = 2.45
RADIUS_FAINT_SCALE_MAX = 1.95
FAINT_GAMMA = 1.35
ARM_SCALE_MIN = 0.98
ARM_SCALE_MAX = 1.25
ARM_SCALE_GAMMA = 1.20


def mask_radius_pix(mag: Column | str, pixel_scale, cfg: StarMask) -> Column:
    scale = pixel_scale if isinstance(pixel_scale, Column) else F.lit(float(pixel_scale))
    return star_radius_arcsec(mag, cfg.radius) * RADIUS_SCALE / F.greatest(scale, F.lit(1e-9))


def nonlinear_scales(radius: Column) -> dict[str, Column]:
    """Faint stars get larger cores and footprints, bright stars longer arms."""
    bright = radius / (radius + PIVOT_PIX)
    faint = F.pow(1.0 - bright, F.lit(FAINT_GAMMA))
    return {
        "core": 1.0 + faint * (CORE_FAINT_SCALE_MAX - 1.0),
        "radius": 1.0 + faint * (RADIUS_FAINT_SCALE_MAX - 1.0),
        "arm": ARM_SCALE_MIN + F.pow(bright, F.lit(ARM_SCALE_GAMMA)) * (ARM_SCALE_MAX - ARM_SCALE_MIN),
    }


def arm_geometry(radius: Column) -> dict[str, Column]:
    """Per-star sizes of the armed shapes; compute once per star, not per pixel."""
    s = nonlinear_scales(radius)
    effective = radius * s["radius"]
    return {
        "core": F.greatest(F.lit(1.0), ARM_CORE * effective * s["core"]),
        "half_width": F.greatest(F.lit(ARM_HALF_WIDTH_MIN_PIX), ARM_HALF_WIDTH * effective),
        "arm_unit": effective * s["arm"],
    }


def extent_pix(radius: Column, cfg: StarMask) -> Column:
    """Half side of the bounding box that contains the shape."""
    if cfg.shape == "circle":
        return radius
    if cfg.shape == "jwst":
        half_width = F.greatest(F.lit(HEX_SPIKE_HALF_WIDTH_MIN_PIX), HEX_SPIKE_HALF_WIDTH * radius)
        return F.greatest(radius, HEX_SPIKE_LENGTH * radius + half_width)
    g = arm_geometry(radius)
    return F.greatest(radius, g["core"] + MAIN_ARM_LENGTH * g["arm_unit"] + g["half_width"])


def _part(angle: float, start, end, half_width, tip) -> Column:
    """A bar along ``angle`` from start to end, with a disc of radius ``tip``
    around its end. A plain disc is a part of zero length."""
    values = {"ca": F.lit(math.cos(angle)), "sa": F.lit(math.sin(angle)),
              "start": start, "end": end, "half_width": half_width, "tip": tip}
    return F.struct(*[c.cast("double").alias(n) for n, c in values.items()])


def stamp_parts(cfg: StarMask, radius: str = "radius", geometry: dict[str, Column] | None = None) -> Column:
    """The shape as an array of parts. The hexagonal core is the union of the
    three rectangles between its opposite sides."""
    rr, zero = F.col(radius), F.lit(0.0)
    turn = math.radians(cfg.rotation_deg)
    if cfg.shape == "circle":
        return F.array(_part(0.0, zero, zero, rr, rr))
    if cfg.shape == "jwst":
        sector = math.pi / 3.0
        width = F.greatest(F.lit(HEX_SPIKE_HALF_WIDTH_MIN_PIX), HEX_SPIKE_HALF_WIDTH * rr)
        apothem = HEX_CORE * rr * math.cos(sector / 2.0)
        core = [_part(turn + (k + 0.5) * sector, -apothem, apothem, HEX_CORE * rr / 2.0, zero) for k in range(3)]
        spikes = [_part(turn + k * sector, zero, HEX_SPIKE_LENGTH * rr, width, width) for k in range(6)]
        return F.array(*core, *spikes)
    g = geometry or arm_geometry(rr)
    parts = [_part(0.0, zero, zero, g["core"], g["core"])]
    for angle in ARM_ANGLES[cfg.shape]:
        diagonal = cfg.shape == "star8" and angle % 90.0 != 0.0
        length = (DIAGONAL_ARM_LENGTH if diagonal else MAIN_ARM_LENGTH) * ARM_LENGTH_SCALE.get(angle, 1.0) * g["arm_unit"]
        width = g["half_width"] * (DIAGONAL_ARM_WIDTH_SCALE if diagonal else 1.0)
        parts.append(_part(math.radians(angle) + turn, g["core"], g["core"] + length, width, width))
    return F.array(*parts)


def in_part(dx: Column, dy: Column) -> Column:
    """Whether an offset from the star lies in the part given by columns ca, sa,
    start, end, half_width, tip."""
    c = F.col
    along, across = dx * c("ca") + dy * c("sa"), dy * c("ca") - dx * c("sa")
    bar = (along >= c("start")) & (along <= c("end")) & (F.abs(across) <= c("half_width"))
    return bar | ((along - c("end")) * (along - c("end")) + across * across <= c("tip") * c("tip"))


def part_span(center: str, axis: str) -> tuple[Column, Column]:
    """Bounds of a part along one image axis; ``axis`` is ca for x, sa for y."""
    a, b = F.col("start") * F.col(axis), F.col("end") * F.col(axis)
    pad = F.greatest("half_width", "tip")
    return F.col(center) + F.least(a, b) - pad, F.col(center) + F.greatest(a, b) + pad
