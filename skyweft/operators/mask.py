"""Star masks on pixel tables: block-bucketed stamp joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import StarMask
from ..functions import stamps
from ..functions.sky import TangentPlane
from ..plans.halo import block_of
from ..plans.skew import salted_join

BLOCK = 64
BLOCK_KEYS = ["_by", "_bx"]


def place_stars(stars: DataFrame, wcs: TangentPlane, cfg: StarMask = StarMask(), ra="ra", dec="dec_") -> DataFrame:
    """Add pixel centre cx, cy and radius in pixels; unusable stars drop out."""
    x, y = wcs.pixel(ra, dec)
    placed = stars.withColumns({
        "cx": x + cfg.xshift_pix,
        "cy": y + cfg.yshift_pix,
        "radius": stamps.mask_radius_pix("phot_g_mean_mag", wcs.pixel_scale_arcsec(), cfg),
    })
    return placed.where(F.col("cx").isNotNull() & F.col("cy").isNotNull() & (F.col("radius") > 0.0))


def stamp_parts(placed: DataFrame, cfg: StarMask) -> DataFrame:
    """One row per part of a stamp with the pixel blocks it can touch. Thin arms
    touch few blocks. Copies of a star collapse first."""
    base = placed.select("cx", "cy", "radius").distinct()
    geometry = None
    if cfg.shape.startswith("star"):
        base = base.withColumns({f"_{n}": g for n, g in stamps.arm_geometry(F.col("radius")).items()})
        geometry = {n: F.col(f"_{n}") for n in ("core", "half_width", "arm_unit")}
    parts = base.select("cx", "cy", F.explode(stamps.stamp_parts(cfg, geometry=geometry)).alias("_p")).select(
        "cx", "cy", "_p.*")

    return parts.withColumns({"_bys": _blocks("cy", "sa"), "_bxs": _blocks("cx", "ca")})


def _blocks(center: str, axis: str) -> Column:
    lo, hi = stamps.part_span(center, axis)
    return F.sequence(block_of(F.floor(lo), BLOCK), block_of(F.ceil(hi), BLOCK))


def masked_pixels(pixels: DataFrame, placed: DataFrame, cfg: StarMask = StarMask()) -> DataFrame:
    """Semi-join: the pixels that lie in at least one star's stamp."""
    return _stamp_join(pixels, placed, cfg, "left_semi")


def unmasked_pixels(pixels: DataFrame, placed: DataFrame, cfg: StarMask = StarMask()) -> DataFrame:
    return _stamp_join(pixels, placed, cfg, "left_anti")


def _stamp_join(pixels: DataFrame, placed: DataFrame, cfg: StarMask, how: str) -> DataFrame:
    parts = stamp_parts(placed, cfg)
    # The block count per part has no fixed bound, so count exactly (stars only).
    n = parts.agg(F.sum(F.size("_bys") * F.size("_bxs"))).first()[0] or 0
    blocks = parts.withColumn("_by", F.explode("_bys")).withColumn("_bx", F.explode("_bxs")).drop("_bys", "_bxs")
    hit = stamps.in_part(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    keyed = pixels.withColumns({"_by": block_of("y", BLOCK), "_bx": block_of("x", BLOCK)})
    return salted_join(keyed, blocks, BLOCK_KEYS, how, hit, cold_rows=n, spread_by=("y", "x")).drop(*BLOCK_KEYS)


def grid_pixels(spark, height: int, width: int) -> DataFrame:
    """All pixels of an image, generated where they are used."""
    n = F.col("id")
    return spark.range(height * width).select(
        F.floor(n / F.lit(width)).cast("int").alias("y"), F.pmod(n, F.lit(width)).cast("int").alias("x")
    )


def mask_raster(spark, height: int, width: int, placed: DataFrame, cfg: StarMask = StarMask()) -> DataFrame:
    """Sparse raster: (y, x) of masked pixels; no rows when nothing is masked."""
    return masked_pixels(grid_pixels(spark, height, width), placed, cfg)


def apply_mask(pixels: DataFrame, placed: DataFrame, cfg: StarMask = StarMask(), fill: float | None = None,
               value: str = "v") -> DataFrame:
    """Replace masked values by ``fill`` (NULL stands for NaN). The union of the
    semi and anti halves avoids joining a mask back to the pixels."""
    kind = pixels.schema[value].dataType
    filled = masked_pixels(pixels, placed, cfg).withColumn(value, F.lit(fill).cast(kind))
    return filled.unionByName(unmasked_pixels(pixels, placed, cfg))


def mask_summary(pixels: DataFrame, placed: DataFrame, cfg: StarMask = StarMask()) -> DataFrame:
    """Masked pixel count and fraction."""
    marked = masked_pixels(pixels, placed, cfg).select(F.lit(1).alias("m")).unionByName(
        unmasked_pixels(pixels, placed, cfg).select(F.lit(0).alias("m"))
    )
    return marked.agg(F.sum("m").alias("masked_pixels"), F.avg(F.col("m").cast("double")).alias("masked_fraction"))
