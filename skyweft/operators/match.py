"""Matched filtering: multi-scale response, peaks, suppression, local fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchedFilter
from ..functions.kernels import template_set
from ..plans.halo import block_of, map_tiles
from ..plans.lineage import cut_lineage
from ..plans.ranking import with_row_number
from .stats import median, robust_sigma

TILE = 256


def fill_missing(pixels: DataFrame, value: str = "v", fill: float | None = None) -> DataFrame:
    """Replace NULLs by a constant, by default the median of the others."""
    fill = median(pixels, value) if fill is None else fill
    if fill is None:
        raise ValueError("image has no finite values")
    return pixels.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))


def filter_response(pixels: DataFrame, templates: Sequence[np.ndarray], image: Sequence[str] = (),
                    tile: int = TILE) -> DataFrame:
    """Correlate with every template and keep the best response per pixel with
    its scale index; the first scale wins ties. FFTs run per halo tile."""
    reach = max(max(t.shape) for t in templates) // 2 + 1
    tile = max(tile, reach)

    def run(planes, present, y0, x0):
        v = np.nan_to_num(planes["v"])
        stack = []
        for t in templates:
            kh, kw = t.shape
            full = (v.shape[0] + kh - 1, v.shape[1] + kw - 1)
            product = np.fft.rfft2(v, full) * np.fft.rfft2(t[::-1, ::-1], full)
            conv = np.fft.irfft2(product, full)
            top, left = (kh - 1) // 2, (kw - 1) // 2
            stack.append(conv[top:top + v.shape[0], left:left + v.shape[1]])
        stack = np.stack(stack)
        best = stack.argmax(axis=0)
        return {"response": np.take_along_axis(stack, best[None], 0)[0], "scale": best.astype("int32")}

    return map_tiles(pixels, run, "response double, scale int", ["v"], image, tile, reach)


def best_scale(responses: DataFrame, by: Sequence[str] = ("y", "x")) -> DataFrame:
    """Same choice on a long table (y, x, scale, response)."""
    order = F.struct(F.col("response"), -F.col("scale"))
    return responses.groupBy(*by).agg(
        F.max_by("scale", order).alias("scale"), F.max("response").alias("response"))


def _axis_max(df: DataFrame, value: str, out: str, line: str, along: str, image: Sequence[str], block: int) -> DataFrame:
    """Maximum over three neighbours along one axis. Lines are cut into blocks
    that borrow one pixel from each side, so a window partition stays small."""
    b = block_of(along, block)
    first, last = F.pmod(along, F.lit(block)) == 0, F.pmod(along, F.lit(block)) == block - 1
    homes = F.filter(F.array(b, F.when(first, b - 1), F.when(last, b + 1)), lambda h: h.isNotNull())
    w = W.partitionBy(*image, line, "_b").orderBy(along).rangeBetween(-1, 1)
    return (
        df.withColumn("_home", b).withColumn("_b", F.explode(homes))
        .withColumn(out, F.max(value).over(w))
        .where(F.col("_b") == F.col("_home")).drop("_b", "_home")
    )


def local_maxima(pixels: DataFrame, threshold: float, height: int, width: int, value: str = "v",
                 image: Sequence[str] = (), block: int = 1024) -> DataFrame:
    """Pixels at or above the threshold that no 8-neighbour exceeds; the image
    border is excluded. The 3 x 3 maximum is taken one axis at a time."""
    rows = _axis_max(pixels, value, "_row_max", "y", "x", image, block)
    both = _axis_max(rows, "_row_max", "_max", "x", "y", image, block)
    inner = F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)
    return both.where(inner & (F.col(value) >= threshold) & (F.col(value) >= F.col("_max"))).drop("_row_max", "_max")


def suppress_close(points: DataFrame, min_separation: float, score: str = "score",
                   image: Sequence[str] = ()) -> DataFrame:
    """Greedy non-maximum suppression: by falling score (ties by y, x), keep a
    point unless a kept one lies closer than the separation.

    The conflict edges are built once from a grid of separation-sized cells
    (points sit on distinct pixels, so a point has a bounded number of
    neighbours). Rounds then keep every open point that beats all its open
    neighbours and close their neighbours; this gives the greedy result.
    """
    image = list(image)
    key = [*image, "y", "x"]
    cell = max(float(min_separation), 1.0)
    pts = cut_lineage(points, "points")
    placed = pts.select(*key, F.col(score).alias("_s"), F.floor(F.col("y") / cell).alias("_cy"),
                        F.floor(F.col("x") / cell).alias("_cx"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    others = placed.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).select(
        *image, (F.col("_cy") + F.col("_dy")).alias("_cy"), (F.col("_cx") + F.col("_dx")).alias("_cx"),
        F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("_s").alias("_s2"))
    dy, dx = F.col("y") - F.col("y2"), F.col("x") - F.col("x2")
    close = (dy * dy + dx * dx).cast("double") < float(min_separation) ** 2

    def rank(s: str, y: str, x: str) -> Column:
        return F.struct(F.col(s).alias("s"), (-F.col(y)).alias("y"), (-F.col(x)).alias("x"))

    edges = cut_lineage(
        placed.join(others, [*image, "_cy", "_cx"]).where(close & (rank("_s", "y", "x") > rank("_s2", "y2", "x2")))
        .select(*image, "y", "x", "y2", "x2"), "conflicts")  # (y, x) beats (y2, x2)
    lower = [*image, F.col("y2").alias("y"), F.col("x2").alias("x")]
    open_points, kept = pts.select(*key), None
    while True:
        winners = open_points.join(edges.select(*lower).distinct(), key, "left_anti")
        winners = cut_lineage(winners, "winners")
        if winners.isEmpty():
            break
        kept = winners if kept is None else kept.unionByName(winners)
        beaten = edges.join(winners, key, "left_semi").select(*lower).distinct()
        open_points = cut_lineage(
            open_points.join(winners, key, "left_anti").join(beaten, key, "left_anti"), "open", supersedes=open_points)
        edges = cut_lineage(
            edges.join(open_points, key, "left_semi")
            .join(open_points.select(*image, F.col("y").alias("y2"), F.col("x").alias("x2")),
                  [*image, "y2", "x2"], "left_semi").select(*image, "y", "x", "y2", "x2"), "conflicts", supersedes=edges)
    return pts.limit(0) if kept is None else pts.join(kept, key, "left_semi")


def fit_windows(templates: Sequence[np.ndarray], window_scale: float) -> list[tuple[int, int, int, float]]:
    """Central template windows as rows (scale, dy, dx, t)."""
    rows = []
    for i, p in enumerate(templates):
        ph, pw = p.shape
        hh, hw = (max(2, min(n // 2, int(round((n // 2) * window_scale)))) for n in (ph, pw))
        cy, cx = ph // 2, pw // 2
        if cy - hh < 0 or cx - hw < 0 or cy + hh + 1 > ph or cx + hw + 1 > pw:
            continue
        for dy in range(-hh, hh + 1):
            for dx in range(-hw, hw + 1):
                rows.append((i, dy, dx, float(p[cy + dy, cx + dx])))
    return rows


def local_fit(samples: DataFrame, by: Sequence[str], data: str = "d", template: str = "t") -> DataFrame:
    """Least-squares amplitude, correlation and residual ratio per candidate.

    With both series mean-subtracted these are regr_slope, corr and
    sqrt(1 - corr**2); a flat data window has correlation 0 and an infinite ratio.
    """
    fits = samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(data), F.col(template)).alias("fit_amp"),
        F.corr(data, template).alias("_r"), (F.min(data) == F.max(data)).alias("_flat"))
    return fits.select(
        *by, "n", "fit_amp", F.when(F.col("_flat"), 0.0).otherwise(F.col("_r")).alias("fit_corr"),
        F.when(F.col("_flat"), F.lit(float("inf"))).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("_r") * F.col("_r")))).alias("fit_rms_ratio"))


def refine(pixels: DataFrame, candidates: DataFrame, templates: Sequence[np.ndarray],
           cfg: MatchedFilter = MatchedFilter()) -> DataFrame:
    """Fit the winning template around each candidate (y, x, scale, snr) and drop
    poor fits and windows that leave the image."""
    spark = pixels.sparkSession
    rows = fit_windows(templates, cfg.fit_window_scale)
    windows = spark.createDataFrame(rows, "scale int, dy int, dx int, t double")  # as large as the templates; Spark sees its size
    sizes = windows.groupBy("scale").agg(F.count("*").alias("_need"))
    wanted = candidates.join(windows, "scale").select(
        F.col("y").alias("cy"), F.col("x").alias("cx"), "scale", "snr",
        (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "t")
    samples = wanted.join(pixels.select("y", "x", F.col("v").alias("d")), ["y", "x"])
    fits = local_fit(samples, ["cy", "cx", "scale", "snr"]).join(sizes, "scale")
    good = (F.col("n") == F.col("_need")) & (F.col("fit_corr") >= cfg.min_fit_corr) & (
        F.col("fit_rms_ratio") <= cfg.max_fit_rms_ratio) & F.col("fit_amp").isNotNull()
    return fits.where(good).select(F.col("cy").alias("y"), F.col("cx").alias("x"), "snr",
                                   "fit_amp", "fit_corr", "fit_rms_ratio")


def find_matches(pixels: DataFrame, template: np.ndarray, height: int, width: int,
                 cfg: MatchedFilter = MatchedFilter()) -> DataFrame:
    """Whole search: (id, x, y, snr, fit_amp, fit_corr, fit_rms_ratio) with
    1-based positions, numbered by falling snr."""
    templates = template_set(template, cfg.scale_min, cfg.scale_max, cfg.scale_steps)
    filled = fill_missing(pixels)
    level = median(filled, "v")
    image = cut_lineage(filled.select("y", "x", (F.col("v") - level).alias("v")), "image")
    response = cut_lineage(filter_response(image, templates), "response")
    _, sigma = robust_sigma(response, "response")
    snr = response.select("y", "x", "scale", (F.col("response") / sigma).alias("snr"))
    peaks = local_maxima(snr, cfg.threshold_sigma, height, width, "snr")
    kept = suppress_close(peaks, cfg.min_separation, "snr")
    found = refine(image, kept, templates, cfg)
    ordered = with_row_number(found, "id", [F.col("snr").desc(), F.col("y"), F.col("x")])
    return ordered.select("id", (F.col("x") + 1.0).alias("x"), (F.col("y") + 1.0).alias("y"),
                          "snr", "fit_amp", "fit_corr", "fit_rms_ratio")
