"""Scalar families: geometry, sizing, text, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import StarMask, StarRadius
from ..fixtures import fixture
from ..functions import kernels, photometry as ph, sky, stamps, text
from ..operators import cutouts, detect, tiles
from ..sources import tables
from . import query
from .sqltext import (
    CATALOG, LABELS, MOSAICS, RADIUS, SKY, STARS, TARGETS, TILE_X, TILE_Y, mod_floor, sep_arcsec,
)


def r(c, digits: int = 6):
    return F.round(c, digits)


@query(f"""select source_id, round({RADIUS}, 6) as r_pivot,
  round(case when phot_g_mean_mag is null then 8e0
        else least(greatest(8e0*pow(10e0, -0.2e0*(phot_g_mean_mag - 15e0)), 1e0), 40e0) end, 6) as r_default,
  round(case when phot_g_mean_mag is not null
        then least(greatest(8e0*pow(10e0, -0.2e0*(phot_g_mean_mag - 15e0)), 1e0), 40e0) end, 6) as r_null
  from {STARS}""")
def star_radius(spark, sf):
    m = F.col("phot_g_mean_mag")
    return fixture(spark, sf, "stars").select(
        "source_id",
        r(sky.star_radius_arcsec(m)).alias("r_pivot"),
        r(sky.star_radius_arcsec(m, StarRadius(null_mag="r0"))).alias("r_default"),
        r(sky.star_radius_arcsec(m, StarRadius(null_mag="null"))).alias("r_null"))


@query(f"""select id, tile_x, tile_y, printf('%03d.%03d', tile_x, tile_y) as tile_id,
  printf('CFIS_LSB.%03d.%03d.r.fits', tile_x, tile_y) as file_name
  from (select id, {TILE_X} as tile_x, {TILE_Y} as tile_y from {SKY})""")
def sky_tile_of_position(spark, sf):
    return tiles.with_tile(fixture(spark, sf, "whole_sky")).select(
        "id", "tile_x", "tile_y", text.tile_id("tile_x", "tile_y").alias("tile_id"),
        text.tile_file_name("tile_x", "tile_y").alias("file_name"))


_TILES = f"(select distinct {TILE_X} as tile_x, {TILE_Y} as tile_y from {SKY})"
_COS = "cos(radians(tile_y/2e0 - 90e0))"


@query(f"""select tile_x, tile_y, round(case when abs({_COS}) >= 1e-9
    then {mod_floor(f'tile_x/(2e0*{_COS})', '360e0')} end, 6) as center_ra,
  tile_y/2e0 - 90e0 as center_dec from {_TILES}""")
def tile_centers(spark, sf):
    return tiles.tile_centers(tiles.unique_tiles(fixture(spark, sf, "whole_sky"))).withColumn(
        "center_ra", r("center_ra"))


_BOX = f"""(select tile_x, tile_y, {mod_floor(f'tile_x/(2e0*{_COS})', '360e0')} as ra, 0.25e0/abs({_COS}) as half,
   greatest(tile_y/2e0 - 90.25e0, -90e0) as dec_min, least(tile_y/2e0 - 89.75e0, 90e0) as dec_max
   from {_TILES} where abs({_COS}) >= 1e-6)"""


@query(f"""with b as {_BOX}, s as (
  select *, case when ra - half < 0e0 then ra - half + 360e0 else ra - half end as lo,
    case when ra - half < 0e0 then 360e0 when ra + half >= 360e0 then 360e0 else ra + half end as hi from b
  union all select *, 0e0, case when ra - half < 0e0 then ra + half else ra + half - 360e0 end
    from b where ra - half < 0e0 or ra + half >= 360e0)
  select tile_x, tile_y, round(90 + (360e0 - hi)/360e0*1670, 4) as x, round(70 + (90e0 - dec_max)/180e0*840, 4) as y,
    round((hi - lo)/360e0*1670, 4) as w, round((dec_max - dec_min)/180e0*840, 4) as h
  from s where hi > lo and dec_max > dec_min""")
def footprint_boxes(spark, sf):
    boxes = tiles.footprint_boxes(tiles.unique_tiles(fixture(spark, sf, "whole_sky")))
    return boxes.select("tile_x", "tile_y", *[r(c, 4).alias(c) for c in "xywh"])


@query(f"""select source_number, round({sep_arcsec('ra', 'dec_', '150.5e0', '2.5e0')}, 6) as sep,
  round({mod_floor('270e0 - theta_j2000', '360e0')} - 180e0, 6) as region_angle,
  round({mod_floor('theta_j2000 + 90e0', '180e0')}, 6) as half_turn,
  round({mod_floor('ra*7e0 - 1300e0', '360e0')}, 6) as wrapped from {CATALOG}""")
def separation_and_angles(spark, sf):
    return fixture(spark, sf, "catalog").select(
        "source_number",
        r(sky.separation_arcsec("ra", "dec_", F.lit(150.5), F.lit(2.5))).alias("sep"),
        r(sky.region_angle("theta_j2000")).alias("region_angle"),
        r(sky.region_angle_half_turn("theta_j2000")).alias("half_turn"),
        r(sky.wrap360(F.col("ra") * 7.0 - 1300.0)).alias("wrapped"))


_PLAN = """(select s_suppkey, cast((s_suppkey*53.7e0) % 360e0 as double) as center_ra,
   -60e0 + (s_suppkey % 120)*1e0 as center_dec, 0.1e0 + (s_nationkey % 7)*0.1e0 as size_deg,
   0.2e0 + (s_nationkey % 3)*0.062e0 as pixscale from supplier)"""


@query(f"""with p as (select *, cast(ceil(size_deg*3600e0/pixscale) as integer) as total from {_PLAN}),
  g as (select *, greatest(1, cast(ceil(total/3000e0) as integer)) as n_grid from p),
  c as (select *, cast(ceil(total/cast(n_grid as double)) as integer) as cell_pix from g),
  k as (select c.*, yy.v as iy, xx.v as ix from c, range(0, 20) yy(v), range(0, 20) xx(v) where yy.v < n_grid and xx.v < n_grid),
  d as (select *, cell_pix*pixscale/3600e0 as step, (n_grid - 1)/2e0 as mid from k),
  e as (select *, center_dec + (iy - mid)*step as cell_dec from d)
  select s_suppkey, n_grid, cell_pix, cast(ix as integer) as ix, cast(iy as integer) as iy, round(cell_dec, 6) as cell_dec,
   round({mod_floor('center_ra + (ix - mid)*step/greatest(abs(cos(radians(cell_dec))), 1e-6)', '360e0')}, 6) as cell_ra from e""")
def area_cutout_grid(spark, sf):
    plan = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "s_suppkey", "cast((s_suppkey*53.7e0) % 360e0 as double) as center_ra",
        "-60e0 + (s_suppkey % 120)*1e0 as center_dec", "0.1e0 + (s_nationkey % 7)*0.1e0 as size_deg",
        "0.2e0 + (s_nationkey % 3)*0.062e0 as pixscale")
    cells = tiles.area_grid(plan, "center_ra", "center_dec", "size_deg", "pixscale", 3000)
    return cells.select("s_suppkey", "n_grid", "cell_pix", "ix", "iy", r("cell_dec").alias("cell_dec"),
                        r("cell_ra").alias("cell_ra"))


_SIZES = "(select p_partkey, 500 + p_size*37 as width, cast(300 + (p_partkey % 83)*11 as integer) as height from part)"


@query(f"""with im as {_SIZES}, d as (select r, cast(12/r as integer) as c from (values (1),(2),(3),(4),(6),(12)) t(r)),
  scored as (select im.*, r as nrows, c as ncols, row_number() over (partition by p_partkey
     order by round(abs(ln((cast(width as double)/c)/(cast(height as double)/r))), 12), r) as rn from im, d),
  g as (select * from scored where rn = 1),
  t as (select g.*, cast(a.v as integer) as tile_row, cast(b.v as integer) as tile_col
        from g, range(0, 12) a(v), range(0, 12) b(v) where a.v < nrows and b.v < ncols),
  k as (select *, tile_col*(width//ncols) + least(tile_col, width % ncols) as core_x0,
     (tile_col + 1)*(width//ncols) + least(tile_col + 1, width % ncols) as core_x1,
     tile_row*(height//nrows) + least(tile_row, height % nrows) as core_y0,
     (tile_row + 1)*(height//nrows) + least(tile_row + 1, height % nrows) as core_y1 from t)
  select p_partkey, nrows, ncols, tile_row, tile_col, core_x0, core_x1, core_y0, core_y1,
    greatest(0, core_x0 - 20) as x0, least(width, core_x1 + 20) as x1,
    greatest(0, core_y0 - 20) as y0, least(height, core_y1 + 20) as y1 from k""")
def halo_tile_grid(spark, sf):
    sizes = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey", "500 + p_size*37 as width", "cast(300 + (p_partkey % 83)*11 as integer) as height")
    names = ["nrows", "ncols", "tile_row", "tile_col", "core_x0", "core_x1", "core_y0", "core_y1", "x0", "x1", "y0", "y1"]
    return tiles.halo_tiles(sizes, "width", "height", 12, 20).select("p_partkey", *names)


# One tilted tangent plane per mosaic: 0.1 arcsec pixels, rotated by its id.
_CD = ("1e-4*cos(mosaic_id*0.1e0)/3.6e0", "1e-4*sin(mosaic_id*0.1e0)/3.6e0")
_XI = "radians(-cd*(px + 1e0 - 1000.5e0) + sd*(py + 1e0 - 800.5e0))"
_ETA = "radians(sd*(px + 1e0 - 1000.5e0) + cd*(py + 1e0 - 800.5e0))"


@query(f"""with m as (select mosaic_id, ra0, dec0, {_CD[0]} as cd, {_CD[1]} as sd, (mosaic_id % 90)*20e0 as px,
     (mosaic_id % 70)*20e0 as py from {MOSAICS}),
  t as (select *, {_XI} as xi, {_ETA} as eta from m),
  w as (select *, cos(radians(dec0)) - eta*sin(radians(dec0)) as den from t)
  select mosaic_id, round({mod_floor('ra0 + degrees(atan2(xi, den))', '360e0')}, 8) as ra,
   round(degrees(atan2(sin(radians(dec0)) + eta*cos(radians(dec0)), sqrt(xi*xi + den*den))), 8) as dec_,
   round(px, 5) as x_back, round(py, 5) as y_back, round(sqrt(cd*cd + sd*sd)*3600e0, 8) as pixscale from w""")
def tangent_plane_round_trip(spark, sf):
    m = fixture(spark, sf, "mosaics").selectExpr(
        "mosaic_id", "ra0", "dec0", f"{_CD[0]} as cd", f"{_CD[1]} as sd", "(mosaic_id % 90)*20e0 as px",
        "(mosaic_id % 70)*20e0 as py")
    c = F.col
    wcs = sky.TangentPlane(1000.5, 800.5, "ra0", "dec0", -c("cd"), c("sd"), c("sd"), c("cd"))
    ra, dec = wcs.world("px", "py")
    placed = m.withColumns({"ra": ra, "dec_": dec})
    x, y = wcs.pixel("ra", "dec_")
    return placed.select("mosaic_id", r("ra", 8).alias("ra"), r("dec_", 8).alias("dec_"), r(x, 5).alias("x_back"),
                         r(y, 5).alias("y_back"), r(wcs.pixel_scale_arcsec(), 8).alias("pixscale"))


@query(f"""with s as (select source_id, (case when phot_g_mean_mag is null then 8e0 else
     least(greatest(8e0*pow(10e0, -0.2e0*(phot_g_mean_mag - 15e0)), 1e0), 40e0) end)*1.1e0/0.5e0 as rad from {STARS}),
  n as (select *, rad/(rad + 18e0) as b, pow(1e0 - rad/(rad + 18e0), 1.35e0) as f from s),
  e as (select *, 1e0 + f*1.45e0 as core_s, 1e0 + f*0.95e0 as rad_s, 0.98e0 + pow(b, 1.2e0)*0.27e0 as arm_s from n),
  g as (select *, rad*rad_s as eff, greatest(1e0, 0.45e0*rad*rad_s*core_s) as core from e)
  select source_id, round(rad, 6) as radius_pix, round(core_s, 6) as core_scale, round(rad_s, 6) as radius_scale,
   round(arm_s, 6) as arm_scale, round(rad, 6) as circle,
   round(greatest(rad, core + 1.1e0*eff*arm_s + greatest(3.2e0, 0.1e0*eff)), 6) as star12,
   round(greatest(rad, 1.2e0*rad + greatest(2e0, 0.12e0*rad)), 6) as jwst from g""")
def star_mask_scales(spark, sf):
    radius = F.col("radius")
    s = stamps.nonlinear_scales(radius)
    extents = [r(stamps.extent_pix(radius, StarMask(shape=n))).alias(n) for n in ("circle", "star12", "jwst")]
    return fixture(spark, sf, "stars").withColumn(
        "radius", stamps.mask_radius_pix("phot_g_mean_mag", 0.5, StarMask())).select(
        "source_id", r("radius").alias("radius_pix"), r(s["core"]).alias("core_scale"),
        r(s["radius"]).alias("radius_scale"), r(s["arm"]).alias("arm_scale"), *extents)


_BRIGHT = ("area_kron_arcsec2", "mu_2arc", "snr_sb_2arc", "mu_cog_kron", "snr_sb_cog")


@query(f"""select source_number,
  round(pi()*(a_world*3600e0*kron_radius)*(b_world*3600e0*kron_radius), 6) as area_kron_arcsec2,
  round(mag_2arc + 2.5e0*log10(pi()), 6) as mu_2arc, round(1.0857362047581296e0/magerr_2arc, 6) as snr_sb_2arc,
  round(mag_cog + 2.5e0*log10(pi()*(a_world*3600e0*kron_radius)*(b_world*3600e0*kron_radius)), 6) as mu_cog_kron,
  round(1.0857362047581296e0/magerr_cog, 6) as snr_sb_cog,
  round(kron_radius*(a_world*3600e0/0.187e0), 6) as kron_pix from {CATALOG}""")
def surface_brightness(spark, sf):
    out = fixture(spark, sf, "catalog").withColumns(ph.surface_brightness())
    return out.select("source_number", *[r(c).alias(c) for c in _BRIGHT],
                      r(ph.kron_pixels("kron_radius", "a_world", 0.187)).alias("kron_pix"))


@query(f"""with k as (select source_number, kron_radius, x_image, y_image, a_world,
    greatest(least(2e0*kron_radius*(a_world*36000e0), 512e0), 64e0) as half from {CATALOG})
  select source_number, least(1024, greatest(12, cast(ceil(12e0*kron_radius) as integer))) as half_size,
   2*least(1024, greatest(12, cast(ceil(12e0*kron_radius) as integer))) + 1 as side,
   round(x_image - 1e0, 6) as cx, round(y_image - 1e0, 6) as cy,
   round(half, 6) as cutout_half_pix, greatest(2, cast(ceil(2e0*half) as integer)) as cutout_size_pix from k""")
def cutout_sizes(spark, sf):
    planned = cutouts.plan_kron_cutouts(fixture(spark, sf, "catalog"), 0.187)
    sized = cutouts.plan_source_cutouts(planned.withColumns(
        {"kron": F.col("kron_radius"), "sma": F.col("a_world") * 36000.0}))
    return sized.select("source_number", "half_size", "side", r("cx").alias("cx"), r("cy").alias("cy"),
                        r("cutout_half_pix").alias("cutout_half_pix"), "cutout_size_pix")


@query(f"""select id, round(size/2e0/3600e0, 10) as radius_arcsec, round(size/60e0, 10) as radius_arcmin,
  least(greatest(6e0*size/10e0, 3e0), 15e0) as stamp from {TARGETS}""")
def stamp_radius(spark, sf):
    return fixture(spark, sf, "targets").select(
        "id", r(ph.size_to_radius_deg("size"), 10).alias("radius_arcsec"),
        r(ph.size_to_radius_deg("size", "arcmin", "radius"), 10).alias("radius_arcmin"),
        ph.stamp_size_arcsec(F.col("size") / 10.0).alias("stamp"))


_RAW_ID = """case p_partkey % 5 when 0 then concat(cast(p_partkey as varchar(20)), '.0')
  when 1 then concat(' ', p_name, '/', cast(p_partkey as varchar(20)), ' ')
  when 2 then cast(p_partkey*1000 as varchar(20)) when 3 then concat(cast(p_partkey as varchar(20)), '.25') else '  ' end"""


@query(f"""with t as (select p_partkey, trim({_RAW_ID}) as raw from part), n as (select *, try_cast(raw as double) as d from t)
  select p_partkey, case when abs(d - round_even(d, 0)) < 1e-6 then cast(cast(round_even(d, 0) as bigint) as varchar)
    when regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g') = '' then 'unknown'
    else regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g') end as source_id from n""")
def source_identifier(spark, sf):
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{_RAW_ID} as raw")
    return raw.select("p_partkey", text.source_id("raw").alias("source_id"))


_TILE_LINE = """case p_partkey % 4 when 0 then concat('vos:/x/cfis_lsb.', substr(cast(1000 + p_partkey % 700 as varchar(20)), 2, 3), '.',
    substr(cast(1000 + p_size as varchar(20)), 2, 3), '.r.fits')
  when 1 then concat('  ', substr(cast(1000 + p_partkey % 700 as varchar(20)), 2, 3), '.', substr(cast(1000 + p_size as varchar(20)), 2, 3))
  when 2 then p_name else '' end"""


@query(f"""with t as (select {_TILE_LINE} as line from part), m as (select
   case when regexp_matches(line, '(?i)CFIS_LSB\\.(\\d{{3}})\\.(\\d{{3}})\\.r\\.') then regexp_extract(line, '(?i)CFIS_LSB\\.(\\d{{3}})\\.(\\d{{3}})\\.r\\.', 1)
     else nullif(regexp_extract(line, '\\b(\\d{{3}})\\.(\\d{{3}})\\b', 1), '') end as a,
   case when regexp_matches(line, '(?i)CFIS_LSB\\.(\\d{{3}})\\.(\\d{{3}})\\.r\\.') then regexp_extract(line, '(?i)CFIS_LSB\\.(\\d{{3}})\\.(\\d{{3}})\\.r\\.', 2)
     else nullif(regexp_extract(line, '\\b(\\d{{3}})\\.(\\d{{3}})\\b', 2), '') end as b from t)
  select distinct cast(a as integer) as tile_x, cast(b as integer) as tile_y from m where a is not null""")
def tile_list_lines(spark, sf):
    lines = spark.read.parquet(f"{sf}/part.parquet").selectExpr(f"{_TILE_LINE} as line")
    t = text.parse_tile("line")
    return lines.select(t["tile_x"].alias("tile_x"), t["tile_y"].alias("tile_y")).where("tile_x is not null").distinct()


_FILE = """concat('m', cast(p_size as varchar(20)), case when p_partkey % 7 = 0 then '-' else '--' end,
  case p_partkey % 4 when 0 then 'F444W' when 1 then 'f150w2' when 2 then 'G800L' else 'F1000' end,
  '-', case p_partkey % 3 when 0 then '0a' else 'B12' end, case when p_size % 2 = 0 then concat('v', cast(p_size as varchar(20))) else '' end,
  '_i2d.fits', case when p_partkey % 5 = 0 then '.gz' else '' end)"""


@query(f"""with t as (select p_partkey, {_FILE} as name from part),
  s as (select *, string_split(string_split(regexp_replace(name, '\\.fits(\\.gz)?$', ''), '_')[1], '-') as raw from t),
  l as (select *, list_filter(raw, lambda e: e <> '') as toks from s),
  f as (select *, list_position(list_transform(toks, lambda e: regexp_full_match(e, '(?i)F\\d{{3,4}}[A-Z0-9]*')), true) as spot from l)
  select p_partkey, name, upper(toks[spot]) as filter_name, nullif(upper(regexp_replace(toks[spot + 1], '(?i)v\\d+$', '')), '') as field,
   case when name like '%.fits.gz' then replace(name, '.fits.gz', '') else replace(name, '.fits', '') end as stem,
   case when name like '%.fits.gz' then replace(name, '.fits.gz', '.masked.fits.gz') else replace(name, '.fits', '.masked.fits') end as masked
  from f""")
def image_name_parts(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{_FILE} as name")
    t = text.filter_and_field("name")
    return names.select("p_partkey", "name", t["filter"].alias("filter_name"), t["field"].alias("field"),
                        text.file_stem("name").alias("stem"), text.masked_name("name").alias("masked"))


@query(f"""with t as (select p_partkey, cast(floor(p_partkey/50e0) as integer) as dir, {_FILE} as name from part),
  s as (select *, concat('/d', dir, '/', name, '#', p_partkey) as path,
    list_filter(string_split(string_split(regexp_replace(name, '\\.fits(\\.gz)?$', ''), '_')[1], '-'), lambda e: e <> '') as toks from t),
  f as (select *, list_position(list_transform(toks, lambda e: regexp_full_match(e, '(?i)F\\d{{3,4}}[A-Z0-9]*')), true) as spot from s),
  k as (select path, dir, case when spot > 0 then nullif(upper(regexp_replace(toks[spot + 1], '(?i)v\\d+$', '')), '') end as field from f)
  select a.path, 1 + count(b.path) as n_members, concat_ws(',', a.path, string_agg(b.path, ',' order by b.path)) as members
  from k a left join k b on a.dir = b.dir and a.field = b.field and a.path <> b.path group by a.path""")
def sibling_images(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "cast(floor(p_partkey/50e0) as integer) as dir", f"{_FILE} as file_name")
    files = names.select("file_name", F.concat(F.lit("/d"), "dir", F.lit("/"), "file_name", F.lit("#"), "p_partkey").alias("path"))
    lists = tables.sibling_lists(files)
    return lists.select("path", F.size("siblings").cast("bigint").alias("n_members"), F.array_join("siblings", ",").alias("members"))


@query(r"""with t as (select page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
     '&#39;', ''''), '&amp;', '&') as h from pages),
  u as (select page_id, unnest(list_distinct(regexp_extract_all(h, 'https?://[^\s"''<>]+'))) as url from t)
  select page_id, url from u union all select page_id, url from pages""")
def urls_in_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = pages.select("page_id", F.explode(text.urls_in("html")).alias("url"))
    return found.unionAll(pages.select("page_id", "url"))


_URL = """case p_partkey % 4 when 0 then concat('http://h/frame-', substr('ugriz', cast(1 + p_size % 5 as integer), 1), '-00', p_type)
  when 1 then concat('http://h/get?Band=', substr('ugrizy', cast(1 + p_size % 6 as integer), 1))
  when 2 then concat('http://h/get?a=1&filter=', substr('ugriz', cast(1 + p_size % 5 as integer), 1), '&x=2') else 'http://h/none' end"""


@query(f"""select p_partkey, coalesce(nullif(regexp_extract(lower(u), 'frame-([ugriz])-', 1), ''),
   regexp_extract(lower(u), '[?&](?:band|bands|filter)=([ugriz])(?:[&$])?', 1)) as band
  from (select p_partkey, {_URL} as u from part)""")
def band_of_url(spark, sf):
    urls = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{_URL} as u")
    return urls.select("p_partkey", text.url_band("u").alias("band"))


@query(f"""select id, concat('https://h/cut?ra=', printf('%.8f', ra), '&dec=', printf('%.8f', dec_),
   '&width=256&height=', cast(cast(size as integer) as varchar), '&pixscale=', printf('%.6f', size/16e0), '&layer=ls-dr10-south&bands=r') as cutout_url,
  concat('https://h/siap?POS=', printf('%.8f', ra), '%2C', printf('%.8f', dec_), '&SIZE=', printf('%.6f', size/3600e0),
   '&FORMAT=image%2Ffits&bandpass=g') as search_url from {TARGETS}""")
def service_urls(spark, sf):
    t = fixture(spark, sf, "targets")
    return t.select(
        "id",
        text.cutout_url("https://h/cut", "ra", "dec_", F.lit(256), F.col("size").cast("int"), F.col("size") / 16.0,
                        "ls-dr10-south", "r").alias("cutout_url"),
        text.image_search_url("https://h/siap", "ra", "dec_", F.col("size") / 3600.0, "g").alias("search_url"))


@query("""select l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_quantity/8e0) as ties, printf('%.3f', l_extendedprice*l_tax - 100e0) as p3,
  printf('%.8f', l_extendedprice/(1e0 + l_quantity)) as p8, printf('%.0f', l_extendedprice/2e0) as p0 from lineitem""")
def fixed_point_text(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    c = F.col
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.fixed_point(c("l_quantity") / 8.0, 2).alias("ties"),
                     text.fixed_point(c("l_extendedprice") * c("l_tax") - 100.0, 3).alias("p3"),
                     text.fixed_point(c("l_extendedprice") / (1.0 + c("l_quantity")), 8).alias("p8"),
                     text.fixed_point(c("l_extendedprice") / 2.0, 0).alias("p0"))


_XY = "case when label % 6 = 0 then concat(cast(x as varchar(20)), ', ') when label % 6 = 1 then 'a,b' else concat(' ', cast(x as varchar(20)), ' , ', cast(y as varchar(20)), '.5') end"


@query(f"""with t as (select label, x, y, {_XY} as s from {LABELS}),
  p as (select *, list_filter(list_transform(string_split(s, ','), lambda e: trim(e)), lambda e: e <> '') as q from t)
  select label, x, y, case when len(q) = 2 and try_cast(q[2] as double) is not null then try_cast(q[1] as double) end as px,
   case when len(q) = 2 and try_cast(q[1] as double) is not null then try_cast(q[2] as double) end as py from p""")
def center_text(spark, sf):
    t = fixture(spark, sf, "labels").selectExpr("label", "x", "y", f"{_XY} as s")
    p = text.parse_xy("s")
    return t.select("label", "x", "y", p["x"].alias("px"), p["y"].alias("py"))


@query("""select vec_id, round(cast(list_max(embedding) as double), 6) as top from embeddings""")
def vector_nanmax(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", r(cutouts.array_nanmax(F.col("embedding")).cast("double")).alias("top"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as double) as k from events""")
def json_property(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", props["k"].cast("double").alias("k"))


@query("""with n as (select s_suppkey, 0.6e0 + (s_suppkey % 50)*0.03e0 as sigma from supplier),
  k as (select s_suppkey, cast(a.v as integer) as dy, cast(b.v as integer) as dx,
     exp(-(a.v*a.v + b.v*b.v)/(2e0*sigma*sigma)) as e from n, range(-4, 5) a(v), range(-4, 5) b(v))
  select s_suppkey, dy, dx, round(e/sum(e) over (partition by s_suppkey), 9) as weight from k""")
def gaussian_kernels(spark, sf):
    n = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey", "0.6e0 + (s_suppkey % 50)*0.03e0 as sigma")
    return kernels.kernel_table(n, "sigma", 9).select("s_suppkey", "dy", "dx", r("weight", 9).alias("weight"))


_HALO = """(select o_orderkey, cast(o_orderkey % 7 as integer)*100 - least(20, cast(o_orderkey % 7 as integer)*100) as x0,
   cast(o_custkey % 5 as integer)*80 - least(20, cast(o_custkey % 5 as integer)*80) as y0,
   cast(o_orderkey % 7 as integer)*100 as core_x0, cast(o_orderkey % 7 as integer)*100 + 100 as core_x1,
   cast(o_custkey % 5 as integer)*80 as core_y0, cast(o_custkey % 5 as integer)*80 + 80 as core_y1,
   (o_totalprice % 140e0) as x, (o_totalprice*1.7e0) % 120e0 as y from orders)"""


@query(f"""select o_orderkey, round(x + x0, 6) as x, round(y + y0, 6) as y from {_HALO}
   where x >= core_x0 - x0 and x < core_x1 - x0 and y >= core_y0 - y0 and y < core_y1 - y0""")
def core_of_halo_tiles(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("_halo_orders")
    found = spark.sql(_HALO[1:-1].replace("from orders", "from _halo_orders"))
    return detect.core_sources(found).select("o_orderkey", r("x").alias("x"), r("y").alias("y"))
