"""Background, smoothing, thresholding, labelling and measurement of sources.

Pixels are rows (image columns..., y, x, v), unique per image and position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Detection, Extraction
from ..functions.kernels import gaussian_kernel
from ..functions.sky import finite
from ..plans.halo import block_of, map_tiles
from ..plans.lineage import cut_lineage
from ..plans.ranking import with_row_number
from ..plans.skew import salted_join
from .apertures import kron_apertures
from .coadd import clip_array
from .deblend import deblend
from .graph import connected_components
from .stats import clipped_stats, clipped_stats_by
from .tiles import in_core

TILE = 256
Y_SHIFT = 1 << 32  # pixel id = y * 2**32 + x, ordered like a raster scan


def pixel_id() -> Column:
    return F.col("y").cast("bigint") * Y_SHIFT + F.col("x").cast("bigint")


# -- smoothing -------------------------------------------------------------------

def convolve(pixels: DataFrame, kernel: np.ndarray, image: Sequence[str] = (), value: str = "v",
             tile: int = TILE) -> DataFrame:
    """Correlation with a small odd kernel; absent pixels count as zero."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2

    def run(planes, present, y0, x0):
        v = np.nan_to_num(planes[value])
        padded = np.pad(v, ((ry, ry), (rx, rx)))
        out = np.zeros_like(v)
        for dy in range(kernel.shape[0]):
            for dx in range(kernel.shape[1]):
                out += kernel[dy, dx] * padded[dy:dy + v.shape[0], dx:dx + v.shape[1]]
        return {value: out}

    return map_tiles(pixels, run, f"{value} double", [value], image, max(tile, ry, rx), max(ry, rx))


def smooth(pixels: DataFrame, fwhm: float, image: Sequence[str] = (), value: str = "v") -> DataFrame:
    sigma = max(fwhm, 0.0) / 2.355
    return convolve(pixels, gaussian_kernel(sigma), image, value) if sigma > 0 else pixels


# -- background ------------------------------------------------------------------

def background_mesh(pixels: DataFrame, box: int = 64, sigma: float = 3.0, iters: int = 5,
                    image: Sequence[str] = (), value: str = "v") -> DataFrame:
    """Clipped median and deviation per box; a box holds at most box**2 pixels,
    so its values fit one array."""
    keys = [*image, "by", "bx"]
    cells = pixels.where(F.col(value).isNotNull()).select(
        *image, block_of("y", box).alias("by"), block_of("x", box).alias("bx"), value
    )
    stacks = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).alias("x"), F.lit(1.0).alias("w")))).alias("s")
    )
    kept = stacks.select(*keys, clip_array(sigma, iters).alias("k"))
    n = F.size("k")
    mid = (F.get("k", ((n - 1) / 2).cast("int"))["x"] + F.get("k", (n / 2).cast("int"))["x"]) / 2
    mean = F.aggregate("k", F.lit(0.0), lambda t, e: t + e["x"]) / n
    with_mean = kept.where(n > 0).withColumns({"med": mid, "_mean": mean})
    var = F.aggregate("k", F.lit(0.0), lambda t, e: t + (e["x"] - F.col("_mean")) * (e["x"] - F.col("_mean"))) / n
    return with_mean.select(*keys, F.col("med").alias("level"), F.sqrt(var).alias("rms"))


def median_filter_mesh(mesh: DataFrame, size: int = 3, image: Sequence[str] = ()) -> DataFrame:
    """Median over the size x size box neighbourhood; edge boxes use what exists.
    Each box is sent to its neighbours, so a group holds at most size**2 rows."""
    r = size // 2
    steps = F.array(*[F.lit(i) for i in range(-r, r + 1)])
    sent = mesh.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    target = sent.select(*image, (F.col("by") + F.col("_dy")).alias("by"), (F.col("bx") + F.col("_dx")).alias("bx"),
                         "level", "rms", ((F.col("_dy") == 0) & (F.col("_dx") == 0)).alias("_own"))
    return (
        target.groupBy(*image, "by", "bx")
        .agg(F.median("level").alias("level"), F.median("rms").alias("rms"), F.bool_or("_own").alias("_own"))
        .where("_own").drop("_own")
    )


def with_background(pixels: DataFrame, mesh: DataFrame, box: int = 64, image: Sequence[str] = ()) -> DataFrame:
    """Bilinear interpolation of the mesh at box centres; outside the outermost
    centres the nearest box continues. Adds level and rms."""
    keys = list(image)
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    # Every mesh node serves the four cells around it: one equi-join per pixel row.
    nodes = mesh.withColumn("_k", F.explode(corners)).select(
        *keys, (F.col("by") - F.col("_k.a")).alias("_cy"), (F.col("bx") - F.col("_k.b")).alias("_cx"),
        F.struct(F.col("_k.a").alias("a"), F.col("_k.b").alias("b"), "level", "rms").alias("_node"),
    ).groupBy(*keys, "_cy", "_cx").agg(F.collect_list("_node").alias("_nodes"))
    ty = (F.col("y") + 0.5) / box - 0.5
    tx = (F.col("x") + 0.5) / box - 0.5
    placed = pixels.withColumns({"_cy": F.floor(ty).cast("int"), "_cx": F.floor(tx).cast("int"),
                                 "_fy": ty - F.floor(ty), "_fx": tx - F.floor(tx)})

    def weight(e: Column) -> Column:
        wy = F.when(e["a"] == 1, F.col("_fy")).otherwise(1.0 - F.col("_fy"))
        wx = F.when(e["b"] == 1, F.col("_fx")).otherwise(1.0 - F.col("_fx"))
        return wy * wx

    def blend(name: str) -> Column:
        # Missing nodes (image edge) drop out and the rest is renormalised.
        top = F.aggregate("_nodes", F.lit(0.0), lambda t, e: t + weight(e) * e[name])
        total = F.aggregate("_nodes", F.lit(0.0), lambda t, e: t + weight(e))
        return F.try_divide(top, total)

    joined = placed.join(nodes, [*keys, "_cy", "_cx"], "left")
    return joined.withColumns({"level": blend("level"), "rms": blend("rms")}).drop(
        "_cy", "_cx", "_fy", "_fx", "_nodes"
    )


# -- connected components -----------------------------------------------------------

def _label_tile(planes, present, y0, x0, connectivity: int):
    """Component id inside one tile: the smallest pixel id of the component."""
    h, w = present.shape
    index = np.full((h, w), -1)
    ys, xs = np.nonzero(present)
    index[ys, xs] = np.arange(len(ys))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    heads, tails = [], []
    for dy, dx in steps:
        a = index[: h - dy, max(0, -dx): w - max(0, dx)]
        b = index[dy:, max(0, dx): w - max(0, -dx)]
        both = (a >= 0) & (b >= 0)
        heads.append(a[both])
        tails.append(b[both])
    heads, tails = np.concatenate(heads), np.concatenate(tails)
    parent = np.arange(len(ys))
    while True:
        a, b = parent[heads], parent[tails]
        if (a == b).all():
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    ids = (ys + y0).astype("int64") * Y_SHIFT + (xs + x0)
    labels = np.zeros((h, w), dtype="int64")
    labels[ys, xs] = ids[parent]
    return {"local": labels}


def tile_labels(pixels: DataFrame, connectivity: int = 8, image: Sequence[str] = (), value: str = "v",
                tile: int = TILE) -> DataFrame:
    """Add ``local``: the component id inside the pixel's tile. Written once,
    because the border, the sizes and the result all read it."""
    return cut_lineage(
        map_tiles(pixels, lambda p, m, y, x: {**_label_tile(p, m, y, x, connectivity), value: p[value]},
                  f"local bigint, {value} double", [value], image, tile), "labels")


def merge_tiles(local: DataFrame, connectivity: int = 8, image: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(image..., local, root) for tile labels that touch another tile's label.
    Only pixels on tile borders make edges, so the graph is far smaller than
    the image."""
    image = list(image)
    edge_row, edge_col = F.pmod("y", F.lit(tile)), F.pmod("x", F.lit(tile))
    border = local.where(edge_row.isin(0, tile - 1) | edge_col.isin(0, tile - 1))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    reach = border.withColumn("_s", F.explode(offsets)).select(
        *image, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"),
        F.col("local").alias("other"))
    node, other = F.col("local"), F.col("other")
    if image:  # node ids must be unique across images
        node = F.struct(*[F.col(c) for c in image], F.col("local").alias("id"))
        other = F.struct(*[F.col(c) for c in image], F.col("other").alias("id"))
    touching = border.select(*image, "y", "x", "local").join(reach, [*image, "y", "x"])
    merged = connected_components(touching.select(node.alias("u"), other.alias("v")))
    if not image:
        return merged.withColumnRenamed("node", "local")
    return merged.select(*[F.col(f"node.{c}").alias(c) for c in image],
                         F.col("node.id").alias("local"), F.col("root.id").alias("root"))


def label_components(pixels: DataFrame, connectivity: int = 8, image: Sequence[str] = (), value: str = "v",
                     tile: int = TILE) -> DataFrame:
    """Add ``root``: the smallest pixel id of the connected component."""
    image = list(image)
    local = tile_labels(pixels, connectivity, image, value, tile)
    merged = merge_tiles(local, connectivity, image, tile)
    # A tile label has at most tile**2 pixels, so this key cannot be hot.
    return local.join(merged, [*image, "local"], "left").select(
        *image, "y", "x", value, F.coalesce("root", "local").alias("root"))


def segment(pixels: DataFrame, threshold: Column | float, npixels: int, connectivity: int = 8,
            image: Sequence[str] = (), value: str = "v", tile: int = TILE) -> DataFrame:
    """Components of at least ``npixels`` pixels above the threshold, labelled
    1..n in raster order of their first pixel (the seed), in each image.

    Sizes, roots and labels are worked out on tile labels; the pixels are
    shuffled once to be labelled and joined once to their label.
    """
    image = list(image)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    above = pixels.where(F.col(value) > limit).select(*image, "y", "x", value)
    local = tile_labels(above, connectivity, image, value, tile)
    merged = merge_tiles(local, connectivity, image, tile)
    parts = cut_lineage(
        local.groupBy(*image, "local").agg(F.count("*").alias("_n")).join(merged, [*image, "local"], "left")
        .select(*image, "local", F.coalesce("root", "local").alias("root"), "_n"), "parts")
    whole = parts.groupBy(*image, "root").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= npixels)
    numbered = with_row_number(whole.select(*image, "root"), "label", [*image, "root"])
    if image:
        before = numbered.groupBy(*image).agg((F.min("label") - 1).alias("_before"))
        numbered = salted_join(numbered, before, image, "inner", spread_by=("root",)).withColumn("label", F.col("label") - F.col("_before")).drop("_before")
    seed_x = F.pmod("root", F.lit(Y_SHIFT))
    labels = salted_join(parts.drop("_n"), numbered, [*image, "root"], "inner").select(
        *image, "local", "label", F.floor((F.col("root") - seed_x) / F.lit(Y_SHIFT)).cast("int").alias("seed_y"),
        seed_x.cast("int").alias("seed_x"))
    return local.join(labels, [*image, "local"]).drop("local")


# -- measurement ---------------------------------------------------------------------

def basic_catalog(labelled: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Pixel count, mean position and bounding box per label."""
    return labelled.where(F.col(keys[-1]) > 0).groupBy(*keys).agg(
        F.count("*").alias("npix"),
        F.avg("x").alias("xcentroid_pix"), F.avg("y").alias("ycentroid_pix"),
        F.min("x").alias("xmin_pix"), F.max("x").alias("xmax_pix"),
        F.min("y").alias("ymin_pix"), F.max("y").alias("ymax_pix"),
    )


def moments(labelled: DataFrame, keys: Sequence[str] = ("label",), value: str = "v") -> DataFrame:
    """Flux-weighted shape per label from partial sums; negative values weigh
    nothing. Positions are taken from the label's seed pixel when the table has
    it, so sums of squares lose no digits far from the image corner."""
    keys = list(keys)
    seeded = {"seed_y", "seed_x"} <= set(labelled.columns)
    sy, sx = (F.col("seed_y"), F.col("seed_x")) if seeded else (F.lit(0), F.lit(0))
    f = F.greatest(F.col(value), F.lit(0.0))
    dx, dy = (F.col("x") - sx).cast("double"), (F.col("y") - sy).cast("double")
    sums = labelled.groupBy(*keys).agg(
        F.count("*").alias("area"), F.sum(value).alias("segment_flux"), F.sum(f).alias("_f"),
        F.min(sx).alias("_sx"), F.min(sy).alias("_sy"),
        F.sum(f * dx).alias("_fx"), F.sum(f * dy).alias("_fy"),
        F.sum(f * dx * dx).alias("_fxx"), F.sum(f * dy * dy).alias("_fyy"), F.sum(f * dx * dy).alias("_fxy"),
    )
    w = F.when(F.col("_f") > 0.0, F.col("_f"))
    shaped = sums.withColumns({"_mx": F.col("_fx") / w, "_my": F.col("_fy") / w}).withColumns({
        "xcentroid": F.col("_mx") + F.col("_sx"), "ycentroid": F.col("_my") + F.col("_sy"),
        "_cxx": F.col("_fxx") / w - F.col("_mx") * F.col("_mx"),
        "_cyy": F.col("_fyy") / w - F.col("_my") * F.col("_my"),
        "_cxy": F.col("_fxy") / w - F.col("_mx") * F.col("_my"),
    })
    # A component one pixel wide has no width; a pixel's own variance is 1/12.
    pixel_var = 1.0 / 12.0
    thin = F.col("_cxx") * F.col("_cyy") - F.col("_cxy") * F.col("_cxy") < pixel_var * pixel_var
    shaped = shaped.withColumns({
        "_cxx": F.when(thin, F.col("_cxx") + pixel_var).otherwise(F.col("_cxx")),
        "_cyy": F.when(thin, F.col("_cyy") + pixel_var).otherwise(F.col("_cyy")),
    })
    mean, diff = (F.col("_cxx") + F.col("_cyy")) / 2.0, (F.col("_cxx") - F.col("_cyy")) / 2.0
    root = F.sqrt(diff * diff + F.col("_cxy") * F.col("_cxy"))
    major = F.sqrt(mean + root)
    minor = F.sqrt(F.greatest(mean - root, F.lit(0.0)))
    return shaped.select(
        *keys, "area", "segment_flux", "xcentroid", "ycentroid",
        major.alias("semimajor_sigma"), minor.alias("semiminor_sigma"),
        F.degrees(0.5 * F.atan2(2.0 * F.col("_cxy"), F.col("_cxx") - F.col("_cyy"))).alias("orientation"),
        F.try_divide(major, minor).alias("elongation"),
        F.sqrt(F.col("area") / math.pi).alias("equivalent_radius"),
    )


def kron_and_half_light(labelled: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("label",),
                        value: str = "v", min_kron: float = 1.4, bin_pix: float = 0.1) -> DataFrame:
    """Second pass over the segment's pixels: first-moment (Kron) radius in units
    of the elliptical radius, and the circular radius that holds half the light,
    from radial sums of width ``bin_pix`` with linear interpolation."""
    keys = list(keys)
    t = F.radians("orientation")
    dx, dy = F.col("x") - F.col("xcentroid"), F.col("y") - F.col("ycentroid")
    along = (dx * F.cos(t) + dy * F.sin(t)) / F.col("semimajor_sigma")
    across = (dy * F.cos(t) - dx * F.sin(t)) / F.when(F.col("semiminor_sigma") > 0, F.col("semiminor_sigma"))
    shape = shapes.select(*keys, "xcentroid", "ycentroid", "semimajor_sigma", "semiminor_sigma", "orientation")
    pixels = salted_join(labelled, shape, keys, "inner", spread_by=("y", "x")).select(
        *keys, F.greatest(F.col(value), F.lit(0.0)).alias("_f"),
        F.sqrt(along * along + across * across).alias("_re"), F.sqrt(dx * dx + dy * dy).alias("_r"))
    rings = pixels.groupBy(*keys, F.floor(F.col("_r") / bin_pix).alias("_ring")).agg(
        F.sum("_f").alias("_f"), F.sum(F.col("_f") * F.col("_re")).alias("_fr"))
    outward = W.partitionBy(*keys).orderBy("_ring")  # one row per ring, bounded by the image diagonal
    rings = rings.withColumns({"_cum": F.sum("_f").over(outward), "_total": F.sum("_f").over(W.partitionBy(*keys))})
    half = F.col("_total") / 2.0
    crosses = (F.col("_cum") >= half) & (F.col("_cum") - F.col("_f") < half)
    at = (F.col("_ring") + F.try_divide(half - (F.col("_cum") - F.col("_f")), F.col("_f"))) * bin_pix
    return rings.groupBy(*keys).agg(
        F.greatest(F.try_divide(F.sum("_fr"), F.sum("_f")), F.lit(min_kron)).alias("kron_radius"),
        F.min(F.when(crosses, at)).alias("r50"),
    )


EXTENDED = ("area", "xcentroid", "ycentroid", "elongation", "equivalent_radius", "kron_radius", "orientation", "r50")


def extended_catalog(labelled: DataFrame, names: Sequence[str] = EXTENDED, value: str = "v",
                     pixels: DataFrame | None = None) -> DataFrame:
    """Label plus the requested columns; 'centroid' stands for both coordinates.
    With the image's ``pixels``, Kron and half-light radii are measured in apertures
    that reach beyond the segment; without, on the segment alone."""
    wanted: list[str] = []
    for n in names:
        wanted += ["xcentroid", "ycentroid"] if n == "centroid" else [n]
    shapes = moments(labelled, value=value)
    if {"kron_radius", "r50"} & set(wanted):
        radii = kron_and_half_light(labelled, shapes, value=value) if pixels is None else kron_apertures(pixels, labelled, shapes, value=value)
        shapes = shapes.join(radii, "label", "left")
    return shapes.select("label", *wanted)


def merge_catalogs(basic: DataFrame, extended: DataFrame, seq: str, prefix: str = "sc_") -> DataFrame:
    """Left join on the integer label with prefixed columns; of several rows with
    one label the last one (by ``seq``) wins; rows without a usable label stay
    unmerged."""
    number = F.col("label").try_cast("int")
    names = [c for c in extended.columns if c not in ("label", seq)]
    last = extended.where(number.isNotNull()).groupBy(number.alias("_label")).agg(
        F.max_by(F.struct(*names), F.col(seq)).alias("_row"))
    return basic.join(last, number == F.col("_label"), "left").select(
        basic["*"], *[F.col(f"_row.{c}").alias(prefix + c) for c in names])


# -- whole flows ------------------------------------------------------------------------

def detect_sources(
    pixels: DataFrame, cfg: Detection = Detection(), image: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, float] | DataFrame]:
    """Clipped threshold, smoothing, segmentation: (labelled pixels with the
    original values, statistics). No source gives no rows. With ``image`` columns
    every image has its own statistics, threshold and labels, all in one plan;
    the statistics are then a table with one row per image."""
    image = list(image)
    if not image:
        stats = clipped_stats(pixels, "v", 3.0)
        if not stats["n"]:
            raise ValueError("image has no finite pixels")
        stats = {**stats, "threshold": stats["median"] + cfg.threshold_sigma * stats["std"]}
        filled = pixels.withColumn("v", F.coalesce(finite("v"), F.lit(stats["median"])))
        limit = F.lit(stats["threshold"])
    else:
        stats = clipped_stats_by(pixels, "v", image, 3.0).withColumn("threshold", F.col("median") + cfg.threshold_sigma * F.col("std"))
        levels = stats.select(*image, "median", "threshold")
        filled = salted_join(pixels, levels, image, "inner", spread_by=("y", "x")).select(
            *image, "y", "x", F.coalesce(finite("v"), F.col("median")).alias("v"))
        limit = F.lit(0.0)
    keys = [*image, "y", "x"]
    seen = smooth(filled, cfg.smooth_fwhm, image)
    if image:  # one limit for all: values above their own image's threshold
        seen = salted_join(seen, levels, image, "inner", spread_by=("y", "x")).select(*keys, (F.col("v") - F.col("threshold")).alias("v"))
    gaps = pixels.where(finite("v").isNull()).select(*keys)
    if not gaps.isEmpty():  # filled pixels may not be detected
        seen = seen.join(gaps, keys, "left_anti")
    found = segment(seen, limit, cfg.npixels, cfg.connectivity, image).drop("v")
    measured = cut_lineage(found.join(filled.select(*keys, "v"), keys), "segments")
    return measured, stats


def subtract_background(pixels: DataFrame, cfg: Extraction = Extraction(), image: Sequence[str] = ()) -> DataFrame:
    mesh = median_filter_mesh(background_mesh(pixels, cfg.box_size, image=image), cfg.filter_size, image)
    return with_background(pixels, mesh, cfg.box_size, image).withColumn("v", F.col("v") - F.col("level"))


def detector_rows(catalog: DataFrame) -> DataFrame:
    """Rows of an external detector's catalog: 0-based positions, usable ones
    that touch no flagged pixel."""
    x, y = finite("X_IMAGE") - 1.0, finite("Y_IMAGE") - 1.0
    flags = F.coalesce(F.col("IMAFLAGS_ISO"), F.lit(0)) if "IMAFLAGS_ISO" in catalog.columns else F.lit(0)
    return catalog.withColumns({"x": x, "y": y}).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (flags == 0))


def core_sources(tile_catalog: DataFrame) -> DataFrame:
    """Tile-relative detections of halo tiles: shift to image coordinates and
    keep those in the tile's own core, so overlaps count once."""
    kept = tile_catalog.where(in_core(F.col("x"), F.col("y")))
    return kept.withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")})


def extract_sources(pixels: DataFrame, cfg: Extraction = Extraction(), masked: DataFrame | None = None,
                    detection: DataFrame | None = None) -> DataFrame:
    """Background-subtracted detection with a local threshold; measured catalog.

    ``detection`` is the stacked image when there is one; ``masked`` holds the
    (y, x) of excluded pixels.
    """
    measured = subtract_background(pixels, cfg)
    seen = measured if detection is None else subtract_background(detection, cfg)
    smoothed = smooth(seen.select("y", "x", "v"), cfg.kernel_fwhm)
    local = smoothed.join(seen.select("y", "x", "rms"), ["y", "x"])
    if masked is not None:
        local = local.join(masked.select("y", "x"), ["y", "x"], "left_anti")
    above = local.where(F.col("v") > cfg.nsigma * F.col("rms"))
    segments = segment(above, F.lit(float("-inf")), cfg.npixels)
    if cfg.deblend:
        segments = deblend(segments, cfg.npixels, cfg.deblend_levels, cfg.deblend_contrast).drop("parent")
    segments = segments.drop("v")
    pixels_of = cut_lineage(segments.join(measured.select("y", "x", "v"), ["y", "x"]), "segments")
    shapes = moments(pixels_of)
    kron = kron_apertures(measured, pixels_of, shapes)
    return shapes.join(kron, "label", "left").select(
        "label", F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y"),
        F.col("semimajor_sigma").alias("sma"), F.col("semiminor_sigma").alias("smi"),
        F.col("kron_radius").alias("kron"), (F.col("kron_radius") * F.col("semimajor_sigma")).alias("kron_radius"),
        "segment_flux", F.col("area").alias("segment_area"))
