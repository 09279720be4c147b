"""Catalog selections: morphology cuts, paging, observation tables, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Morphology
from ..functions import photometry as ph
from ..functions.sky import finite
from ..functions.text import first_nonempty
from ..plans.ranking import with_row_number
from ..plans.skew import salted_join

REQUIRED = ("object_id", "ra", "dec_", "fwhm", "flux_vis_psf", "fluxerr_vis_psf", "extended_prob")


def simple_predicates(df: DataFrame, ra: tuple[float | None, float | None] = (None, None),
                      dec: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """NOT NULL, positivity and an optional coordinate box; all of them are plain
    comparisons, so they reach the scan."""
    out = df
    for c in REQUIRED:
        out = out.where(F.col(c).isNotNull())
    for c in ("flux_vis_psf", "fluxerr_vis_psf", "fwhm"):
        out = out.where(F.col(c) > 0.0)
    for name, (lo, hi) in (("ra", ra), ("dec_", dec)):
        if lo is not None:
            out = out.where(F.col(name) >= lo)
        if hi is not None:
            out = out.where(F.col(name) <= hi)
    return out


def morphology_cuts(df: DataFrame, cfg: Morphology = Morphology()) -> DataFrame:
    out = df.withColumn("snr_vis", F.col("flux_vis_psf") / ph.positive("fluxerr_vis_psf"))
    out = out.where(
        (F.col("snr_vis") >= cfg.snr_min)
        & (F.col("extended_prob") >= cfg.extended_prob_min)
        & (F.col("fwhm") >= cfg.fwhm_min)
    )
    if "point_like_prob" in df.columns:
        limit = F.col("point_like_prob") <= cfg.point_like_prob_max
        out = out.where(F.col("point_like_prob").isNull() | limit)
    return out


def morphology_targets(df: DataFrame, cfg: Morphology = Morphology(), tie: Sequence[str] = ("object_id",)) -> DataFrame:
    """Brightest ``top_fetch`` rows, then the cuts, then the best ``top_save`` by
    signal-to-noise. The first limit is part of the meaning: the cuts must not
    move below it. Both sorts are top-k plans, not full sorts."""
    ties = [F.col(c) for c in tie]
    fetched = simple_predicates(df).orderBy(F.col("flux_vis_psf").desc(), *ties).limit(cfg.top_fetch)
    passed = morphology_cuts(fetched, cfg).withColumn("size", ph.stamp_size_arcsec("fwhm", cfg))
    return passed.orderBy(F.col("snr_vis").desc(), *ties).limit(cfg.top_save)


def free_select(df: DataFrame, columns: Sequence[str] | str = "*", where: str = "", order_by: str = "",
                offset: int = 0, limit: int | None = None) -> DataFrame:
    """User-given column list, predicate, order and page."""
    out = df.where(where) if where.strip() else df
    out = out.selectExpr(*([columns] if isinstance(columns, str) else columns))
    if order_by.strip():
        out = out.orderBy(*[F.expr(c) for c in order_by.split(",")])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def with_page(df: DataFrame, order: Sequence[Column | str], page_rows: int) -> DataFrame:
    """Page number and position of every row under one total order; replaces a
    loop of OFFSET queries, each of which would sort everything again."""
    n = F.col("_n") - 1
    out = with_row_number(df, "_n", order)
    pos = F.pmod(n, F.lit(page_rows))
    return out.withColumns({"page": ((n - pos) / page_rows).cast("bigint"), "page_pos": pos}).drop("_n")


# -- observation tables -----------------------------------------------------------

def in_collection(name: str = "JWST", *keys: str) -> Column:
    return F.upper(F.trim(first_nonempty(*(keys or ("obs_collection",))))) == name


def sort_observations(df: DataFrame, keys: Sequence[str] = ("distance", "t_min"), tie: Sequence[str] = ()) -> DataFrame:
    """Ascending with missing and non-finite values last."""
    return df.orderBy(*[finite(F.col(k).try_cast("double")).asc_nulls_last() for k in keys], *tie)


def distinct_nonempty(*keys: str) -> Column:
    return F.count_distinct(F.nullif(F.trim(first_nonempty(*keys)), F.lit("")))


def observation_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        distinct_nonempty("obsid").alias("unique_observations"),
        distinct_nonempty("proposal_id").alias("unique_proposals"),
    )


def preview(df: DataFrame, limit: int = 20, keys: Sequence[str] = ("distance", "t_min"), tie: Sequence[str] = ()) -> DataFrame:
    return sort_observations(df, keys, tie).limit(max(0, limit))


# -- versions and status ----------------------------------------------------------

def version_key(name: Column | str) -> Column:
    """Sort key that orders digit runs by number (as ``sort -V`` does): a run is
    led by its length without leading zeros, the text between runs stays."""
    c = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))

    def keyed(p: Column) -> Column:
        run = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(run).cast("string"), 10, "0"), run)).otherwise(p)

    return F.array_join(F.transform(parts, keyed), "")


def latest_version(df: DataFrame, group: Sequence[str], version: str) -> DataFrame:
    """Newest row per group; a map-side maximum, no window."""
    rest = [c for c in df.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(version_key(version), F.col(version))).alias("_b")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"_b.{c}").alias(c) for c in rest])


def pending(runs: DataFrame, existing: DataFrame, key: Sequence[str], force: bool = False) -> DataFrame:
    """Runs without an output yet."""
    return runs if force else salted_join(runs, existing.select(*key).distinct(), key, "left_anti")


def plan_runs(fields: DataFrame, listing: DataFrame, outputs: DataFrame, image_filter: str = "F444W", folder_prefix: str = "mosaic_",
              output_prefix: str = "catalog_", force: bool = False) -> DataFrame:
    """(field, folder, input, output, status): what to do for every field.

    ``listing`` has a row (field, folder, file_name) per file, with a null file_name
    for an empty folder; ``outputs`` has (folder, file_name, size) of what is there.
    Of the folders named after their field the newest version counts, in it the first
    image of the wanted filter by name. A field without such a folder or image gets
    the step that failed as its status, one whose output is there and not empty is
    ``skipped`` unless forced, all others are to ``run``. Repeated fields are one;
    files and folders of unknown fields are ignored."""
    named = listing.where(F.startswith("folder", F.concat(F.lit(folder_prefix), "field")))
    wanted = F.when(F.contains("file_name", F.lit(image_filter)) & F.endswith("file_name", F.lit("fits"))
                    & (F.instr("file_name", image_filter) + len(image_filter) <= F.length("file_name") - 3), F.col("file_name"))
    folders = named.groupBy("field", "folder").agg(F.min(wanted).alias("input"))
    newest = latest_version(folders, ["field"], "folder")
    output = F.concat(F.lit(output_prefix), F.regexp_replace("folder", f"^{folder_prefix}", ""), F.lit(".csv"))
    done = outputs.where("size > 0").select("folder", F.col("file_name").alias("output"), F.lit(True).alias("done")).distinct()
    planned = fields.select("field").distinct().join(newest, "field", "left").withColumn("output", F.when(F.col("input").isNotNull(), output))
    planned = salted_join(planned, done, ["folder", "output"], "left", hot_side="left")
    there = F.coalesce(F.col("done"), F.lit(False)) & F.lit(not force)
    return planned.select("field", "folder", "input", "output", F.when(F.col("folder").isNull(), "no_mosaic_dir").when(
        F.col("input").isNull(), f"no_{image_filter.lower()}").when(there, "skipped").otherwise("run").alias("status"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def choose_access_row(df: DataFrame, group: Sequence[str], url: str, image_format: str, in_band: Column, seq: str) -> DataFrame:
    """Preferred access row per group: FITS before other formats, then the target
    band before others, then document order."""
    is_fits = F.lower(F.coalesce(F.col(image_format), F.lit(""))).contains("fits") | F.lower(url).endswith(".fits.bz2")
    rank = F.struct((~is_fits).cast("int"), (~in_band).cast("int"), F.col(seq))
    return df.groupBy(*group).agg(F.min_by(F.col(url), rank).alias(url))


def choose_fits_url(urls: Column, endpoint: str) -> Column:
    """First URL that looks like a FITS file and is not the service itself; else
    the first URL."""
    base = endpoint.lower().split("?", 1)[0]

    def usable(u: Column) -> Column:
        low = F.lower(u)
        return (F.split_part(low, F.lit("?"), F.lit(1)) != base) & ~low.contains("getsiap?") & low.contains("fits")

    return F.coalesce(F.get(F.filter(urls, usable), 0), F.get(urls, 0))
