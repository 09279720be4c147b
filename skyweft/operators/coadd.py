"""Pixel-table coaddition: weighted means, clipped means, detection stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Coadd
from ..plans.lineage import cut_lineage
from ..plans.skew import salted_join
from .stats import exact_quantiles

PIXEL = ("y", "x")
STACK_ROWS = 10_000  # largest per-pixel stack gathered as one array


def is_finite(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def sanitize_weights(samples: DataFrame, cfg: Coadd = Coadd()) -> DataFrame:
    """Zero the weight of samples that must not contribute."""
    bad = F.lit(False)
    if cfg.weight_floor > 0:
        bad = bad | (F.col("wht") < cfg.weight_floor)
    if not cfg.allow_nonpositive_weight:
        bad = bad | (F.col("wht") <= 0.0)
    if cfg.mask_nonfinite:
        bad = bad | ~is_finite("sci") | ~is_finite("wht")
    return samples.withColumn("wht", F.when(F.coalesce(bad, F.lit(True)), 0.0).otherwise(F.col("wht")))


def error_from_weight(weight: Column, mode: str = "from-wht") -> Column:
    if mode != "from-wht":
        return F.lit({"nan": float("nan"), "inf": float("inf"), "zero": 0.0}[mode])
    return F.sqrt(F.try_divide(F.lit(1.0), F.when(weight > 0.0, weight)))


def _finish(sums: DataFrame, by: Sequence[str], cfg: Coadd) -> DataFrame:
    empty = F.lit(0.0) if cfg.empty == "zero" else F.lit(None).cast("double")
    mean = F.coalesce(F.try_divide(F.col("_wx"), F.when(F.col("_w") > 0.0, F.col("_w"))), empty)
    kind = "float" if cfg.output_type == "float32" else "double"
    return sums.select(
        *by,
        mean.cast(kind).alias("sci"),
        error_from_weight(F.col("_w"), cfg.err_mode).cast(kind).alias("err"),
        F.col("_w").cast(kind).alias("wht"),
    )


def weighted_coadd(
    samples: DataFrame, cfg: Coadd = Coadd(), by: Sequence[str] = PIXEL, propagate_nonfinite: bool = False
) -> DataFrame:
    """Sum w and sum w x / sum w per pixel; map-side partial sums absorb hot pixels.

    Sums are doubles; the cast to the output type comes last. A sample with
    zero weight adds nothing unless ``propagate_nonfinite`` asks for the raw
    product (a NaN sample then makes its pixel NaN).
    """
    clean = sanitize_weights(samples, cfg)
    product = F.col("sci") * F.col("wht")
    if not propagate_nonfinite:
        product = F.when(F.col("wht") == 0.0, 0.0).otherwise(product)
    sums = clean.groupBy(*by).agg(F.sum("wht").alias("_w"), F.sum(product).alias("_wx"))
    return _finish(sums, by, cfg)


def clip_array(sigma: float, iters: int) -> Column:
    """Iterated median +- sigma clip of the sorted array ``s`` of (x, w)."""
    n = "size(acc)"
    # Half way from the lower to the upper middle value, as the quantiles blend.
    low, high = f"get(acc, int(({n} - 1) div 2)).x", f"get(acc, int({n} div 2)).x"
    center = f"({low} + 0.5D * ({high} - {low}))"
    mean = f"(aggregate(acc, 0D, (t, e) -> t + e.x) / {n})"
    return F.expr(f"""
      aggregate(sequence(1, {int(iters)}), s, (acc, i) ->
        if({n} = 0, acc,
          get(transform(array(named_struct('c', {center}, 'm', {mean})), b ->
            get(transform(array({float(sigma)}D * sqrt(aggregate(acc, 0D, (t, e) -> t + (e.x - b.m) * (e.x - b.m)) / {n})), h ->
              filter(acc, e -> e.x >= b.c - h and e.x <= b.c + h)), 0)), 0)))
    """)


def clipped_coadd(
    samples: DataFrame, cfg: Coadd = Coadd(sigma=3.0), by: Sequence[str] = PIXEL, stack_rows: int = STACK_ROWS
) -> DataFrame:
    """Sigma-clip the finite samples of each pixel, then the weighted mean.

    Pixels with at most ``stack_rows`` samples are clipped as arrays inside the
    JVM. Deeper pixels take the distributed way: exact medians by histograms
    and one aggregate per iteration.
    """
    by = list(by)
    weighed = sanitize_weights(samples, cfg).select(*by, "sci", "wht")
    usable = is_finite("sci") & is_finite("wht")
    deep = cut_lineage(
        weighed.groupBy(*by).agg(F.count_if(usable).alias("_n")).where(F.col("_n") > stack_rows).select(*by), "deep")
    has_deep = not deep.isEmpty()
    shallow = salted_join(weighed, deep, by, "left_anti") if has_deep else weighed
    # Unusable samples add no element, so a pixel without any keeps an empty stack.
    element = F.when(usable, F.struct(F.col("sci").alias("x"), F.col("wht").alias("w")))
    stacks = shallow.groupBy(*by).agg(F.sort_array(F.collect_list(element)).alias("s"))
    kept = stacks.select(*by, clip_array(cfg.sigma, cfg.max_iters).alias("k"))
    zero = F.lit(0.0)
    sums = kept.select(
        *by,
        F.aggregate("k", zero, lambda t, e: t + e["w"]).alias("_w"),
        F.aggregate("k", zero, lambda t, e: t + e["w"] * e["x"]).alias("_wx"),
    )
    if has_deep:
        sums = sums.unionByName(_clip_deep(salted_join(weighed.where(usable), deep, by, "left_semi"), cfg, by))
    return _finish(sums, by, cfg)


def _clip_deep(samples: DataFrame, cfg: Coadd, by: list[str]) -> DataFrame:
    current = cut_lineage(samples, "deep")
    for _ in range(cfg.max_iters):
        spread = current.groupBy(*by).agg(F.stddev_pop("sci").alias("_sd"))
        limits = exact_quantiles(current, "sci", [0.5], ["_med"], by).join(spread, by)
        half = F.lit(cfg.sigma) * F.col("_sd")
        bounds = limits.select(*by, (F.col("_med") - half).alias("_lo"), (F.col("_med") + half).alias("_hi"))
        before = current.count()
        inside = F.col("sci").between(F.col("_lo"), F.col("_hi"))
        current = cut_lineage(salted_join(current, bounds, by, "inner", inside).drop("_lo", "_hi"), "deep", supersedes=current)
        if current.count() == before:
            break
    return current.groupBy(*by).agg(
        F.sum("wht").alias("_w"), F.sum(F.col("wht") * F.col("sci")).alias("_wx")
    )


def detection_stack(samples: DataFrame, image: str = "exposure", by: Sequence[str] = PIXEL) -> DataFrame:
    """Unweighted mean of finite samples per pixel, 0 where there is none. Inputs
    without any finite sample do not count; fewer than two usable inputs give
    an empty result, and the caller detects on the measurement image instead."""
    usable = samples.where(is_finite("sci")).agg(F.count_distinct(image).alias("n")).first()["n"]
    value = F.when(is_finite("sci"), F.col("sci").cast("double"))
    out = samples.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("v"))
    return out if usable >= 2 else out.limit(0)


def error_map(pixels: DataFrame, err: str | None = "err", wht: str | None = "wht") -> DataFrame:
    """ERR plane, or 1 / sqrt(WHT) where the weight is finite and positive."""
    if err and err in pixels.columns:
        return pixels.withColumn("err", F.col(err))
    if wht and wht in pixels.columns:
        good = is_finite(wht) & (F.col(wht) > 0.0)
        return pixels.withColumn("err", F.try_divide(F.lit(1.0), F.sqrt(F.when(good, F.col(wht)))))
    return pixels.withColumn("err", F.lit(None).cast("double"))


def check_same_shape(pixels: DataFrame, image: str = "exposure") -> None:
    """Raise unless all inputs cover the same pixel range. One row of distinct
    extents reaches the driver, never one row per image."""
    extent = pixels.groupBy(image).agg(F.max("y").alias("y"), F.max("x").alias("x"))
    n = extent.select("y", "x").distinct().limit(2).count()
    if n > 1:
        raise ValueError("inputs differ in shape")
