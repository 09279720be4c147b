"""Catalog cleaning: quality flags, counters, staged cuts, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KronCutout, QualityCuts, StarRadius
from ..functions import photometry as ph
from ..functions.sky import ARCSEC, finite
from .xmatch import exclude_near_stars


def nulls_for_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column; Spark orders
    NaN above all numbers, so it must not survive ingestion."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(c).cast(df.schema[c].dataType) for c in floats})


def flags_bad(cfg: QualityCuts = QualityCuts(), flags: str = "flags") -> Column:
    if cfg.flags_max < 0:
        return F.lit(False)
    return F.coalesce(F.col(flags) > cfg.flags_max, F.lit(False))


def point_votes(cfg: QualityCuts = QualityCuts()) -> tuple[Column, Column]:
    """(criteria available, criteria met); a criterion whose inputs are missing
    or out of domain is not available."""
    fwhm_ratio = ph.positive("fwhm_world") * ARCSEC / ph.positive("prediq")
    criteria = [
        F.col("mag_apauto") - F.col("mag_auto") < cfg.point_delta_mag_max,
        fwhm_ratio < cfg.point_fwhm_ratio_max,
        F.col("b_world") / ph.positive("a_world") > cfg.point_axis_ratio_min,
        ph.positive("kron_radius") <= cfg.point_kron_max,
    ]
    available = sum((c.isNotNull().cast("int") for c in criteria), F.lit(0))
    votes = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in criteria), F.lit(0))
    return available, votes


def point_like(cfg: QualityCuts = QualityCuts()) -> Column:
    if cfg.disable_point:
        return F.lit(False)
    available, votes = point_votes(cfg)
    return (available >= cfg.point_min_criteria) & (votes >= cfg.point_min_criteria)


def faint_bad(cfg: QualityCuts = QualityCuts()) -> Column:
    if cfg.disable_faint:
        return F.lit(False)
    tests = [
        F.col("mag_cog") > F.col("predmaglim") - cfg.faint_margin_mag,
        F.col("magerr_cog") > cfg.faint_magerr_cog_max,
        F.col("magerr_auto") > cfg.faint_magerr_auto_max,
    ]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def with_quality(df: DataFrame, cfg: QualityCuts = QualityCuts()) -> DataFrame:
    return df.withColumns(
        {"flags_bad": flags_bad(cfg), "point_like": point_like(cfg), "faint_bad": faint_bad(cfg)}
    )


def keep_good(df: DataFrame, cfg: QualityCuts = QualityCuts()) -> DataFrame:
    return df.where(~(flags_bad(cfg) | point_like(cfg) | faint_bad(cfg)))


def quality_counters(df: DataFrame, cfg: QualityCuts = QualityCuts()) -> DataFrame:
    """One row; the reasons overlap, so they need not add up to the total."""
    bad = F.col("flags_bad") | F.col("point_like") | F.col("faint_bad")
    return with_quality(df, cfg).agg(
        F.count("*").alias("rows_input"),
        F.count_if(bad).alias("rows_removed_total"),
        F.count_if("flags_bad").alias("rows_removed_flags"),
        F.count_if("point_like").alias("rows_removed_point_like"),
        F.count_if("faint_bad").alias("rows_removed_faint"),
        F.count_if(~bad).alias("rows_written"),
    )


def with_surface_brightness(df: DataFrame) -> DataFrame:
    return df.withColumns(ph.surface_brightness())


def clean_catalog(
    catalog: DataFrame,
    stars: DataFrame,
    radius: StarRadius = StarRadius(),
    quality: QualityCuts = QualityCuts(),
    row_key: tuple[str, ...] = (),
) -> DataFrame:
    """Star exclusion, quality cuts and surface-brightness columns in one lazy plan.

    The quality predicates read only the row itself and commute with the star
    match, so they run first and the join sees fewer rows.
    """
    return with_surface_brightness(exclude_near_stars(keep_good(catalog, quality), stars, radius, row_key=row_key))


def with_kron_pixels(df: DataFrame, pixel_scale: float | None) -> DataFrame:
    """Add kron_radius_pix; an existing column wins and an unusable scale is a no-op."""
    if "kron_radius_pix" in df.columns or not pixel_scale or not pixel_scale > 0:
        return df
    if not {"kron_radius", "a_world"} <= set(df.columns):
        return df
    return df.withColumn("kron_radius_pix", ph.kron_pixels_plain("kron_radius", "a_world", pixel_scale))


CUT_COLUMNS = ("snr_sb_cog", "snr_sb_2arc", "kron_radius_pix")


def _cuts(df: DataFrame, minima: dict[str, float | None]) -> list[tuple[str, Column | None]]:
    out = []
    for name in CUT_COLUMNS:
        limit = minima.get(name)
        if limit is not None and name not in df.columns:
            raise ValueError(f"catalog has no {name} column required by the cut")
        out.append((name, None if limit is None else F.col(name) >= float(limit)))
    return out


def staged_cuts(df: DataFrame, **minima: float | None) -> DataFrame:
    """Keep rows at or above every given minimum; a NULL fails."""
    for _, cut in _cuts(df, minima):
        if cut is not None:
            df = df.where(cut)
    return df


def staged_cut_counters(df: DataFrame, **minima: float | None) -> DataFrame:
    """Survivors after each stage, in one pass."""
    passed, counters = F.lit(True), [F.count("*").alias("rows_input")]
    for name, cut in _cuts(df, minima):
        passed = passed if cut is None else passed & F.coalesce(cut, F.lit(False))
        counters.append(F.count_if(passed).alias(f"rows_after_{name}"))
    return df.agg(*counters)


def cutout_sources(df: DataFrame, cfg: KronCutout = KronCutout()) -> DataFrame:
    """Rows usable for cutouts: a centre, a Kron radius (default when missing or
    not positive) and, when asked, a signal-to-noise minimum."""
    if cfg.min_snr is not None and "snr_sb_cog" not in df.columns:
        raise ValueError("catalog has no snr_sb_cog column required by the cut")
    kron = F.coalesce(ph.positive("kron_radius"), F.lit(cfg.default_kron_radius))
    out = df.where(F.col("x_image").isNotNull() & F.col("y_image").isNotNull()).withColumn("kron_radius", kron)
    return out if cfg.min_snr is None else out.where(F.col("snr_sb_cog") >= cfg.min_snr)


def cutout_source_counters(df: DataFrame, cfg: KronCutout = KronCutout()) -> DataFrame:
    placed = F.col("x_image").isNotNull() & F.col("y_image").isNotNull()
    low = F.lit(False) if cfg.min_snr is None else ~F.coalesce(F.col("snr_sb_cog") >= cfg.min_snr, F.lit(False))
    return df.agg(
        F.count("*").alias("rows_data"),
        F.count_if(placed & low).alias("rows_snr_rejected"),
        F.count_if(placed & ~low).alias("rows_usable"),
    )
