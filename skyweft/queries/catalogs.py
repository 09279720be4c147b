"""Catalog cleaning, cuts, selections, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KronCutout, Morphology, QualityCuts
from ..fixtures import fixture
from ..operators import catalog as cat, selection as sel, xmatch
from ..sinks import text as out
from . import query
from .sqltext import (
    BRIGHT_COLUMNS, BRIGHTNESS, CATALOG, MORPHO, NOT_NEAR_STAR, OBSERVATIONS, QUALITY, STARS, rounded,
)


def _bright(df):
    return [F.round(c, 6).alias(c) for c in BRIGHT_COLUMNS]


_QUALITY = f"(select c.*, {QUALITY} from {CATALOG} c)"
_CLEAN = f"(select q.* from {_QUALITY} q where not (flags_bad or point_like or faint_bad))"


@query(f"""with c as {_CLEAN} select source_number, ra, dec_, {rounded(BRIGHT_COLUMNS)}
  from (select *, {BRIGHTNESS} from c where {NOT_NEAR_STAR})""")
def clean_catalog(spark, sf):
    clean = cat.clean_catalog(fixture(spark, sf, "catalog"), fixture(spark, sf, "stars"), row_key=("source_number",))
    return clean.select("source_number", "ra", "dec_", *_bright(clean))


@query(f"select source_number, flags_bad, point_like, faint_bad from {_QUALITY}")
def quality_flags(spark, sf):
    return cat.with_quality(fixture(spark, sf, "catalog")).select(
        "source_number", "flags_bad", "point_like", "faint_bad")


@query(f"""with c as {CATALOG}, k as (select * from c where {NOT_NEAR_STAR}), q as (select k.*, {QUALITY} from k)
  select count(*) as rows_input, count_if(flags_bad or point_like or faint_bad)::bigint as rows_removed_total,
   count_if(flags_bad)::bigint as rows_removed_flags, count_if(point_like)::bigint as rows_removed_point_like,
   count_if(faint_bad)::bigint as rows_removed_faint,
   count_if(not (flags_bad or point_like or faint_bad))::bigint as rows_written from q""")
def quality_counters(spark, sf):
    kept = xmatch.exclude_near_stars(fixture(spark, sf, "catalog"), fixture(spark, sf, "stars"),
                                     row_key=("source_number",))
    return cat.quality_counters(kept)


@query(f"select source_number, ra, dec_, mag_auto from {CATALOG} where coalesce(flags <= 3e0, true)")
def flag_cut(spark, sf):
    df = fixture(spark, sf, "catalog")
    return df.where(~cat.flags_bad(QualityCuts(), "flags")).select("source_number", "ra", "dec_", "mag_auto")


_WIDE = f"(select *, {BRIGHTNESS}, kron_radius*(a_world*3600e0/0.187e0) as kron_radius_pix from {CATALOG})"


@query(f"""select source_number, round(snr_sb_cog, 6) as snr_sb_cog, round(snr_sb_2arc, 6) as snr_sb_2arc,
   round(kron_radius_pix, 6) as kron_radius_pix from {_WIDE}
   where snr_sb_cog >= 6e0 and snr_sb_2arc >= 5e0 and kron_radius_pix >= 12e0""")
def staged_cuts(spark, sf):
    wide = cat.with_kron_pixels(cat.with_surface_brightness(fixture(spark, sf, "catalog")), 0.187)
    kept = cat.staged_cuts(wide, snr_sb_cog=6.0, snr_sb_2arc=5.0, kron_radius_pix=12.0)
    return kept.select("source_number", *[F.round(c, 6).alias(c) for c in cat.CUT_COLUMNS])


@query(f"""select count(*) as rows_input, count_if(snr_sb_cog >= 6e0)::bigint as rows_after_snr_sb_cog,
   count_if(snr_sb_cog >= 6e0 and snr_sb_2arc >= 5e0)::bigint as rows_after_snr_sb_2arc,
   count_if(snr_sb_cog >= 6e0 and snr_sb_2arc >= 5e0 and kron_radius_pix >= 12e0)::bigint as rows_after_kron_radius_pix
  from {_WIDE}""")
def staged_cut_counters(spark, sf):
    wide = cat.with_kron_pixels(cat.with_surface_brightness(fixture(spark, sf, "catalog")), 0.187)
    return cat.staged_cut_counters(wide, snr_sb_cog=6.0, snr_sb_2arc=5.0, kron_radius_pix=12.0)


@query(f"""select count(*) as rows_data, count_if(not snr_sb_cog >= 8e0)::bigint as rows_snr_rejected,
   count_if(snr_sb_cog >= 8e0)::bigint as rows_usable from {_WIDE}""")
def cutout_source_counters(spark, sf):
    wide = cat.with_surface_brightness(fixture(spark, sf, "catalog"))
    return cat.cutout_source_counters(wide, KronCutout(min_snr=8.0))


_ELLIPSE = f"""(select source_number, ra, dec_,
   greatest(a_world*3600e0*kron_radius, 0.1e0) as a_arcsec, greatest(b_world*3600e0*kron_radius, 0.1e0) as b_arcsec,
   coalesce((((270e0 - theta_j2000) % 360e0 + 360e0) % 360e0) - 180e0, 0e0) as theta from {CATALOG})"""


@query(f"""select source_number, round(a_arcsec, 6) as a_arcsec, round(b_arcsec, 6) as b_arcsec, round(theta, 6) as theta,
   concat('ellipse(', printf('%.8f', ra), ',', printf('%.8f', dec_), ',', printf('%.3f', a_arcsec), '",',
     printf('%.3f', b_arcsec), '",', printf('%.2f', theta), ')') as line from {_ELLIPSE}""")
def region_ellipses(spark, sf):
    lines = out.catalog_ellipses(fixture(spark, sf, "catalog"))
    return lines.select("source_number", *[F.round(c, 6).alias(c) for c in ("a_arcsec", "b_arcsec", "theta")], "line")


@query(f"""with c as {_CLEAN} select source_number, concat('src ', cast(source_number as varchar), ' ', printf('%.6f', area_kron_arcsec2), ' ',
   printf('%.6f', mu_2arc), ' ', printf('%.6f', snr_sb_2arc), ' ', printf('%.6f', mu_cog_kron), ' ', printf('%.6f', snr_sb_cog)) as line
  from (select *, {BRIGHTNESS} from c)""")
def pass_through_lines(spark, sf):
    kept = cat.with_surface_brightness(cat.keep_good(fixture(spark, sf, "catalog")))
    lined = kept.withColumns({"seq": F.col("source_number"),
                              "line": F.concat(F.lit("src "), F.col("source_number").cast("string"), F.lit("\n"))})
    return out.clean_lines(lined).withColumnRenamed("seq", "source_number")


@query(f"""select source_id, ra, dec_, p_star from {STARS} where p_star >= 0.8e0 and p_star > p_galaxy and p_star > p_quasar
   and phot_g_mean_mag <= 19e0""")
def point_like_stars(spark, sf):
    return xmatch.point_like_stars(fixture(spark, sf, "stars"), 0.8, 19.0).select("source_id", "ra", "dec_", "p_star")


_SIMPLE = f"""(select * from {MORPHO} where object_id is not null and ra is not null and dec_ is not null and fwhm is not null
   and flux_vis_psf is not null and fluxerr_vis_psf is not null and extended_prob is not null
   and flux_vis_psf > 0e0 and fluxerr_vis_psf > 0e0 and fwhm > 0e0)"""
_SHAPED = """flux_vis_psf/fluxerr_vis_psf >= 30e0 and extended_prob >= 0.9e0 and fwhm >= 0.25e0
   and (point_like_prob is null or point_like_prob <= 0.1e0)"""


@query(f"""with f as (select * from {_SIMPLE} order by flux_vis_psf desc, object_id, part_no, tie limit 5000),
  p as (select *, flux_vis_psf/fluxerr_vis_psf as snr_vis from f where {_SHAPED})
  select object_id, part_no, tie, ra, dec_, round(snr_vis, 6) as snr_vis, round(least(greatest(6e0*fwhm, 3e0), 15e0), 6) as size
  from p order by snr_vis desc, object_id, part_no, tie limit 100""")
def morphology_targets(spark, sf):
    top = sel.morphology_targets(fixture(spark, sf, "morpho"), Morphology(), ("object_id", "part_no", "tie"))
    return top.select("object_id", "part_no", "tie", "ra", "dec_", F.round("snr_vis", 6).alias("snr_vis"),
                      F.round("size", 6).alias("size"))


@query(f"""select object_id, part_no, tie, round(flux_vis_psf/fluxerr_vis_psf, 6) as snr_vis from {_SIMPLE}
   where ra >= 152e0 and ra <= 158e0 and dec_ >= -10e0 and dec_ <= 10e0 and {_SHAPED}""")
def morphology_box(spark, sf):
    boxed = sel.simple_predicates(fixture(spark, sf, "morpho"), (152.0, 158.0), (-10.0, 10.0))
    return sel.morphology_cuts(boxed).select("object_id", "part_no", "tie", F.round("snr_vis", 6).alias("snr_vis"))


@query(f"""select object_id, part_no, tie, ra, dec_ from {MORPHO} where flux_vis_psf > 20000e0 and fwhm < 0.6e0
   order by object_id, part_no, tie offset 100 limit 500""")
def free_select_page(spark, sf):
    return sel.free_select(fixture(spark, sf, "morpho"), ["object_id", "part_no", "tie", "ra", "dec_"],
                           "flux_vis_psf > 20000e0 and fwhm < 0.6e0", "object_id, part_no, tie", 100, 500)


@query("""select o_orderkey, cast((row_number() over (order by o_totalprice, o_orderkey) - 1)//1000 as bigint) as page,
   cast((row_number() over (order by o_totalprice, o_orderkey) - 1) % 1000 as bigint) as page_pos from orders""")
def numbered_pages(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    return sel.with_page(orders, ["o_totalprice", "o_orderkey"], 1000).drop("o_totalprice")


_JWST = f"(select * from {OBSERVATIONS} where upper(trim(obs_collection)) = 'JWST')"


@query(f"select obsid, proposal_id, distance, t_min from {_JWST}")
def collection_filter(spark, sf):
    return fixture(spark, sf, "observations").where(sel.in_collection()).select(
        "obsid", "proposal_id", "distance", "t_min")


@query(f"""select obsid, distance, t_min from {_JWST} order by distance nulls last, t_min nulls last, obsid limit 200""")
def observation_preview(spark, sf):
    return sel.preview(fixture(spark, sf, "observations").where(sel.in_collection()), 200, tie=("obsid",)).select(
        "obsid", "distance", "t_min")


@query(f"""select count(*) as n_rows, count(distinct obsid) as unique_observations,
   count(distinct nullif(trim(proposal_id), '')) as unique_proposals from {_JWST}""")
def observation_summary(spark, sf):
    return sel.observation_summary(fixture(spark, sf, "observations").where(sel.in_collection()))


_RUNS = """(select p_brand as field, concat('mosaic_', p_brand, 'v', cast(p_size as varchar(20)), '_', cast(p_partkey as varchar(20))) as version,
   p_partkey as run_key, p_size as v from part)"""


@query(f"""select field, version, run_key from (select *, row_number() over (partition by field order by v desc, run_key desc) as rn from {_RUNS})
   where rn = 1""")
def latest_version(spark, sf):
    runs = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_brand as field", "concat('mosaic_', p_brand, 'v', cast(p_size as varchar(20)), '_', cast(p_partkey as varchar(20))) as version",
        "p_partkey as run_key")
    return sel.latest_version(runs, ["field"], "version")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def pending_runs(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    done = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'").selectExpr("o_custkey as c_custkey")
    return sel.pending(customers, done, ["c_custkey"])


# Folders of brands by size; some are not named after their brand, most lack the filter.
_LISTED = ["p_brand as field", "concat(case when p_size % 7 = 0 then 'old_' else 'mosaic_' end, p_brand, 'v', cast(p_size as varchar(20))) as folder",
           "concat(case when p_partkey % 40 = 0 then 'F444W_' else 'F200W_' end, cast(p_partkey as varchar(20)), '.fits') as file_name", "p_size"]
_OUTPUTS = "concat('catalog_', p_brand, 'v', cast(p_size as varchar(20)), '.csv')"


@query(f"""with l as (select {', '.join(_LISTED)} from part), d as (select field, folder, p_size, min(case when file_name like 'F444W%' then file_name end) as input
    from l where starts_with(folder, 'mosaic_') group by all),
  b as (select * from d qualify row_number() over (partition by field order by p_size desc) = 1),
  f as (select distinct p_brand as field from part union select n_name from nation)
  select f.field, b.folder, b.input, case when b.input is not null then 'catalog_' || substr(b.folder, 8) || '.csv' end as output,
    case when b.folder is null then 'no_mosaic_dir' when b.input is null then 'no_f444w' when b.p_size % 4 > 0 then 'skipped' else 'run' end as status
  from f left join b using (field)""")
def planned_runs(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    fields = part.selectExpr("p_brand as field").unionByName(spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_name as field"))
    listing = part.selectExpr(*_LISTED)
    outputs = part.selectExpr("concat('mosaic_', p_brand, 'v', cast(p_size as varchar(20))) as folder", f"{_OUTPUTS} as file_name", "p_size % 4 as size")
    return sel.plan_runs(fields, listing, outputs)


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counts(spark, sf):
    return sel.status_counts(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus").withColumnRenamed(
        "o_orderstatus", "status")


_ACCESS = """(select l_suppkey, l_orderkey*10 + l_linenumber as seq, l_partkey,
   concat('http://h/', cast(l_orderkey as varchar(20)), case when l_partkey % 3 = 0 then '.fits.bz2' else '.jpg' end) as url,
   case when l_partkey % 5 = 0 then 'image/FITS' else 'image/jpeg' end as image_format, l_returnflag as band from lineitem)"""


@query(f"""select l_suppkey, url from (select *, row_number() over (partition by l_suppkey order by
   case when lower(image_format) like '%fits%' or lower(url) like '%.fits.bz2' then 0 else 1 end,
   case when band = 'R' then 0 else 1 end, seq, l_partkey, url) as rn from {_ACCESS}) where rn = 1""")
def preferred_access_row(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_suppkey", "struct(l_orderkey*10 + l_linenumber as a, l_partkey as b) as seq",
        "concat('http://h/', cast(l_orderkey as varchar(20)), case when l_partkey % 3 = 0 then '.fits.bz2' else '.jpg' end) as url",
        "case when l_partkey % 5 = 0 then 'image/FITS' else 'image/jpeg' end as image_format", "l_returnflag as band")
    return sel.choose_access_row(rows, ["l_suppkey"], "url", "image_format", F.col("band") == "R", "seq")


@query("""select 'c' as kind, c_custkey as key, c_acctbal as acctbal, c_mktsegment as segment from customer
  union all select 's', s_suppkey, s_acctbal, null from supplier""")
def union_of_columns(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "'c' as kind", "c_custkey as key", "c_acctbal as acctbal", "c_mktsegment as segment")
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("'s' as kind", "s_suppkey as key", "s_acctbal as acctbal")
    return out.union_of_columns([c, s], ["key"])
