"""Bilinear resizing of pixel tables, smoothed first along an axis that shrinks.

Both steps are linear and separable, so an axis is a short table (i, o, w): input
index i adds w times its value to output index o. Each axis is one equi-join with
that table and one sum that combines on the map side; a task never holds an image.

Missing pixels count as zero. Indexes beyond an edge are mirrored at the outermost
sample. An axis of one sample is repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import finite
from .stats import unit_range

#: Half-width of the smoothing kernel in standard deviations.
TRUNCATE = 4.0


def _mirrored(index: np.ndarray, n: int) -> np.ndarray:
    period = max(1, 2 * (n - 1))
    index = np.mod(index, period)
    return np.where(index < n, index, period - index) if n > 1 else np.zeros_like(index)


def axis_weights(n_in: int, n_out: int, anti_aliasing: bool = True) -> list[tuple[int, int, float]]:
    """(i, o, w) of one axis; the weights of an output index add up to one."""
    if n_in < 1 or n_out < 1:
        raise ValueError("an axis has at least one sample")
    sigma = max(0.0, (n_in / n_out - 1.0) / 2.0) if anti_aliasing else 0.0
    reach = int(TRUNCATE * sigma + 0.5)
    steps = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (steps / sigma) ** 2) if reach else np.ones(1)
    kernel /= kernel.sum()
    place = _mirrored((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, n_in)
    low = np.floor(place).astype(int)
    part = place - low
    taps = np.stack([low, low + 1], axis=1)[:, :, None] + steps
    weight = np.stack([1.0 - part, part], axis=1)[:, :, None] * kernel
    out = np.broadcast_to(np.arange(n_out)[:, None, None], taps.shape)
    source = _mirrored(taps, n_in)
    keys, at = np.unique(np.stack([source.ravel(), out.ravel()], axis=1), axis=0, return_inverse=True)
    sums = np.bincount(at.ravel(), weight.ravel())
    return [(int(i), int(o), float(w)) for (i, o), w in zip(keys, sums, strict=True) if w != 0.0]


def _along(spark: SparkSession, rows: DataFrame, axis: str, other: list[str], n_in: int, n_out: int, anti_aliasing: bool) -> DataFrame:
    weights = spark.createDataFrame(axis_weights(n_in, n_out, anti_aliasing), f"{axis} int, _o int, _w double")
    return rows.join(weights, axis).groupBy(*other, F.col("_o").alias(axis)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def resized(pixels: DataFrame, shape: tuple[int, int], source: tuple[int, int] | None = None,
            image: list[str] | None = None, anti_aliasing: bool = True) -> DataFrame:
    """(image columns, y, x, v) on a grid of ``shape`` = (rows, columns). ``source`` is
    the shape of the input, by default up to its largest y and x; images told apart
    by the ``image`` columns share it. Every image has all pixels of the new grid."""
    spark, image = pixels.sparkSession, list(image or [])
    if source is None:
        last = pixels.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
        source = (1 + (last["y"] or 0), 1 + (last["x"] or 0))
    rows = pixels.select(*image, F.col("y").cast("int"), F.col("x").cast("int"), F.coalesce(finite("v"), F.lit(0.0)).alias("v"))
    # The axis that shrinks more goes first and leaves fewer rows to the other.
    order = sorted(zip("yx", source, shape, strict=True), key=lambda a: a[2] / a[1])
    done = rows
    for axis, n_in, n_out in order:
        done = _along(spark, done, axis, [*image, "x" if axis == "y" else "y"], n_in, n_out, anti_aliasing)
    cell = F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))).alias("y")
    grid = rows.select(*image).distinct() if image else rows.agg(F.count("*").alias("_n")).where("_n > 0").drop("_n")
    grid = grid.select(*image, cell).select(*image, "y", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))).alias("x"))
    return grid.join(done, [*image, "y", "x"], "left").select(*image, "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def normalized(pixels: DataFrame, size: int = 128, source: tuple[int, int] | None = None) -> DataFrame:
    """Missing and strongly negative values to 0, resized to size x size, then min-max scaled."""
    held = finite("v")
    clean = pixels.withColumn("v", F.when(held < -10.0, 0.0).otherwise(held))
    return unit_range(resized(clean, (size, size), source))
