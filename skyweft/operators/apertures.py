"""Photometry in apertures that reach beyond a source's own segment.

Ellipses and circles are joined to pixels by the blocks they touch, an equi-join;
the ellipse is tested inside a block only. Pixels of other segments are masked.

Defined cases: a null or non-finite pixel adds nothing; a source without a shape has
no row; a source one pixel wide gets the width of a pixel; sums that are not positive
give the smallest Kron radius, and no half-light radius.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sky import finite
from ..plans.halo import block_of
from ..plans.lineage import cut_lineage, drop_table
from ..plans.skew import salted_join

BLOCK = 64
#: Half-width of a uniform pixel's own light, as a standard deviation.
PIXEL_SIGMA = (1.0 / 12.0) ** 0.5
#: Scale of the ellipse in which the Kron radius is measured, scale of the aperture in
#: Kron radii, and the smallest Kron radius (fixed values).
MEASURE_SCALE, KRON_SCALE, MIN_KRON = 6.0, 2.5, 1.4


def owned_pixels(pixels: DataFrame, labelled: DataFrame, image: Sequence[str] = (), value: str = "v") -> DataFrame:
    """(image..., y, x, v, owner, _by, _bx): finite pixels with the label of the
    segment they belong to."""
    keys = [*image, "y", "x"]
    owner = labelled.select(*keys, F.col("label").alias("owner"))
    joined = pixels.select(*keys, finite(value).alias("v")).where("v is not null").join(owner, keys, "left")
    return joined.withColumns({"_by": block_of("y", BLOCK), "_bx": block_of("x", BLOCK)})


def pixels_around(owned: DataFrame, sources: DataFrame, radius: Column, image: Sequence[str] = ()) -> DataFrame:
    """Pixels of ``owned_pixels`` within ``radius`` of each source's centroid that
    are not another source's: columns of the source, v, and the distances _r (in
    pixels) and _re (in units of the source's ellipse)."""
    image = list(image)
    keys = [*image, "_by", "_bx"]

    def touched(center: str) -> Column:
        return F.sequence(block_of(F.col(center) - F.col("_reach"), BLOCK), block_of(F.col(center) + F.col("_reach"), BLOCK))

    reach = sources.withColumn("_reach", radius).where("_reach is not null and xcentroid is not null and ycentroid is not null")
    spread = reach.withColumn("_by", F.explode(touched("ycentroid"))).withColumn("_bx", F.explode(touched("xcentroid")))
    dx, dy, t = F.col("x") - F.col("xcentroid"), F.col("y") - F.col("ycentroid"), F.radians(F.coalesce("orientation", F.lit(0.0)))
    along = (dx * F.cos(t) + dy * F.sin(t)) / F.greatest("semimajor_sigma", F.lit(PIXEL_SIGMA))
    across = (dy * F.cos(t) - dx * F.sin(t)) / F.greatest("semiminor_sigma", F.lit(PIXEL_SIGMA))
    inside = (dx * dx + dy * dy <= F.col("_reach") * F.col("_reach")) & (F.col("owner").isNull() | (F.col("owner") == F.col("label")))
    joined = salted_join(owned, spread, keys, "inner", inside, spread_by=("y", "x"), cold_rows=spread.count())
    return joined.select(*sources.columns, "v", F.sqrt(dx * dx + dy * dy).alias("_r"), F.sqrt(along * along + across * across).alias("_re"))


def kron_apertures(pixels: DataFrame, labelled: DataFrame, shapes: DataFrame, image: Sequence[str] = (), value: str = "v",
                   min_kron: float = MIN_KRON, bin_pix: float = 0.5) -> DataFrame:
    """(image..., label, kron_radius, kron_flux, kron_area, r50) of every source of
    ``shapes`` (as from ``moments``). The Kron radius is the first moment of the light
    within MEASURE_SCALE times the ellipse; the flux is what KRON_SCALE Kron radii
    hold; r50 is the radius of the circle with half of it, read off the growth curve
    in rings of ``bin_pix`` by linear interpolation."""
    keys = [*image, "label"]
    owned = cut_lineage(owned_pixels(pixels, labelled, image, value), "owned-pixels")
    sources = shapes.select(*keys, "xcentroid", "ycentroid", "semimajor_sigma", "semiminor_sigma", "orientation")
    major = F.greatest("semimajor_sigma", F.lit(PIXEL_SIGMA))
    near = pixels_around(owned, sources, MEASURE_SCALE * major, image).where(F.col("_re") <= MEASURE_SCALE)
    sums = near.groupBy(*keys).agg(F.sum("v").alias("_f"), F.sum(F.col("v") * F.col("_re")).alias("_fr"))
    radius = F.greatest(F.when((F.col("_f") > 0) & (F.col("_fr") > 0), F.col("_fr") / F.col("_f")), F.lit(float(min_kron)))
    sized = cut_lineage(sources.join(sums, keys, "left").withColumn("kron_radius", radius).drop("_f", "_fr"), "kron-radii")

    scale = KRON_SCALE * F.col("kron_radius")
    around = pixels_around(owned, sized, scale * major, image)
    inside = F.col("_re") <= scale
    rings = cut_lineage(around.groupBy(*keys, F.floor(F.col("_r") / bin_pix).alias("_ring")).agg(
        F.sum("v").alias("_f"), F.sum(F.when(inside, F.col("v"))).alias("_in"), F.count(F.when(inside, 1)).alias("_n")), "growth-curves")
    total = rings.groupBy(*keys).agg(F.sum("_in").alias("kron_flux"), F.sum("_n").alias("kron_area"))
    # One row per ring: a source has at most its aperture's radius / bin_pix.
    outward = W.partitionBy(*keys).orderBy("_ring")
    half = F.sum("_in").over(W.partitionBy(*keys)) / 2.0
    curve = rings.withColumns({"_cum": F.sum("_f").over(outward), "_half": half})
    curve = curve.where((F.col("_half") > 0) & (F.col("_cum") >= F.col("_half")))
    crossing = (F.col("_ring") + (F.col("_half") - (F.col("_cum") - F.col("_f"))) / F.col("_f")) * bin_pix
    r50 = curve.groupBy(*keys).agg(F.min_by(crossing, "_ring").alias("r50"))
    out = cut_lineage(sized.select(*keys, "kron_radius").join(total, keys, "left").join(r50, keys, "left"), "kron-apertures")
    for table in (owned, sized, rings):
        drop_table(table)
    return out
