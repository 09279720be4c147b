"""Sky joins, coverage joins, catalog merges, footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture
from ..operators import cutouts, detect, tiles, xmatch
from . import query
from .sqltext import (
    CATALOG, CORNER_COLUMNS, CORNER_NAMES, LABELS, MOSAICS, NOT_NEAR_STAR, RADIUS, SKY, STARS, TARGETS, TILE_X, TILE_Y,
    cross, dot, inside, sep_arcsec, unit, with_vectors,
)


@query(f"select source_number, ra, dec_ from {CATALOG} c where {NOT_NEAR_STAR}")
def exclude_near_stars(spark, sf):
    return xmatch.exclude_near_stars(fixture(spark, sf, "catalog"), fixture(spark, sf, "stars"),
                                     row_key=("source_number",)).select(
        "source_number", "ra", "dec_")


@query(f"""select source_id, round({RADIUS}, 6) as radius_arcsec from {STARS} s where exists (select 1 from {CATALOG} c
   where {sep_arcsec('c.ra', 'c.dec_', 's.ra', 's.dec_')} <= {RADIUS})""")
def stars_with_match(spark, sf):
    return xmatch.stars_with_match(fixture(spark, sf, "catalog"), fixture(spark, sf, "stars")).select(
        "source_id", F.round("radius_arcsec", 6).alias("radius_arcsec"))


@query(f"""select s.source_id, ra, dec_, o_orderkey from {STARS} s join orders on s.source_id = o_custkey
   where p_star >= 0.6e0 and p_star > p_galaxy and p_star > p_quasar""")
def join_parameters(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey as source_id", "o_orderkey")
    stars = xmatch.point_like_stars(fixture(spark, sf, "stars"), 0.6)
    return xmatch.join_parameters(stars, orders).select("source_id", "ra", "dec_", "o_orderkey")


_X, _Y, _Z = unit("ra", "dec_")


@query(f"""with m as (select avg({_X}) as x, avg({_Y}) as y, avg({_Z}) as z from {CATALOG}),
  c as (select ((degrees(atan2(y, x)) % 360e0) + 360e0) % 360e0 as ra0, degrees(atan2(z, sqrt(x*x + y*y))) as dec0 from m)
  select round(ra0, 6) as center_ra, round(dec0, 6) as center_dec,
   round((select max({sep_arcsec('k.ra', 'k.dec_', 'c.ra0', 'c.dec0')})/3600e0 from {CATALOG} k) + 0.05e0, 6) as radius_deg from c""")
def footprint_cone(spark, sf):
    cone = xmatch.footprint_cone(fixture(spark, sf, "catalog"), guard=True)
    return cone.select(*[F.round(c, 6).alias(c) for c in ("center_ra", "center_dec", "radius_deg")])


@query(f"""select source_id, ra, dec_ from {STARS} where {sep_arcsec('ra', 'dec_', '150.5e0', '2.5e0')} <= 0.3e0*3600e0""")
def cone_search(spark, sf):
    return xmatch.in_cone(fixture(spark, sf, "stars"), 150.5, 2.5, 0.3).select("source_id", "ra", "dec_")


_POLY = with_vectors(f"(select *, {', '.join(CORNER_COLUMNS)} from {MOSAICS})", CORNER_NAMES, "v")
_PX = unit("ra", "dec_")


@query(f"""with p as (select *, {_PX[0]} as qx, {_PX[1]} as qy, {_PX[2]} as qz from {STARS}), m as {_POLY}
  select source_id, mosaic_id from p, m where {inside('v', 'q')}
   and (v1x + v2x + v3x + v4x)*qx + (v1y + v2y + v3y + v4y)*qy + (v1z + v2z + v3z + v4z)*qz > 0e0""")
def stars_in_footprints(spark, sf):
    polygons = fixture(spark, sf, "mosaics").selectExpr("mosaic_id", *CORNER_COLUMNS)
    hits = xmatch.points_in_polygons(fixture(spark, sf, "stars").select("source_id", "ra", "dec_"), polygons,
                                     CORNER_NAMES, xmatch.polygon_radius_bound(0.07))
    return hits.select("source_id", "mosaic_id")


_EDGES = []
for _a, _b in ((1, 2), (2, 3), (3, 4), (4, 1)):
    _n = cross(f"v{_a}", f"v{_b}")
    _norm = f"sqrt({_n[0]}*{_n[0]} + {_n[1]}*{_n[1]} + {_n[2]}*{_n[2]})"
    _na = f"(({_n[1]}*v{_a}z - {_n[2]}*v{_a}y)*qx + ({_n[2]}*v{_a}x - {_n[0]}*v{_a}z)*qy + ({_n[0]}*v{_a}y - {_n[1]}*v{_a}x)*qz)"
    _nb = f"(({_n[1]}*v{_b}z - {_n[2]}*v{_b}y)*qx + ({_n[2]}*v{_b}x - {_n[0]}*v{_b}z)*qy + ({_n[0]}*v{_b}y - {_n[1]}*v{_b}x)*qz)"
    _EDGES.append(f"(abs({dot(_n, 'q')}) <= sin(radians(rad))*{_norm} and {_na} >= 0e0 and {_nb} <= 0e0)")
    _EDGES.append(f"(v{_a}x*qx + v{_a}y*qy + v{_a}z*qz >= cos(radians(rad)))")


@query(f"""with p as (select *, size/2e0/3600e0 as rad, {_PX[0]} as qx, {_PX[1]} as qy, {_PX[2]} as qz from {TARGETS}), m as {_POLY},
  h as (select p.id, p.ra, p.dec_, m.file_name, m.creation_date from p left join m on instrument_name = 'VIS'
    and ({inside('v', 'q')} or {' or '.join(_EDGES)})),
  r as (select *, row_number() over (partition by id order by creation_date desc nulls last, file_name desc nulls last) as rn from h)
  select id, file_name, creation_date from r where rn = 1""")
def newest_covering_mosaic(spark, sf):
    mosaics = fixture(spark, sf, "mosaics").where("instrument_name = 'VIS'").selectExpr(
        "file_name", "creation_date", *CORNER_COLUMNS)
    targets = fixture(spark, sf, "targets").withColumn("radius_deg", F.col("size") / 2.0 / 3600.0)
    best = xmatch.newest_covering_mosaic(targets, mosaics, CORNER_NAMES, "radius_deg", 8.0 / 3600.0,
                                         xmatch.polygon_radius_bound(0.07))
    return best.select("id", "file_name", "creation_date")


@query(f"select distinct {TILE_X} as tile_x, {TILE_Y} as tile_y from {SKY}")
def unique_tiles(spark, sf):
    return tiles.unique_tiles(fixture(spark, sf, "whole_sky"))


@query(f"select source_number, ra, dec_ from {CATALOG} where {TILE_X} = 301 and {TILE_Y} = 185")
def rows_in_tile(spark, sf):
    return tiles.in_tile(fixture(spark, sf, "catalog"), 301, 185).select("source_number", "ra", "dec_")


_COVER = f"""(select distinct {TILE_X} as tile_x, {TILE_Y} as tile_y from
   (select (c_custkey*91.7313e0) % 360e0 as ra, -89.9e0 + ((c_custkey*33.1771e0) % 1798e0)/10e0 as dec_ from customer))"""


@query(f"""with g as (select id, {TILE_X} as tile_x, {TILE_Y} as tile_y from {SKY})
  select id, printf('%03d.%03d', tile_x, tile_y) as tile_id,
   exists (select 1 from {_COVER} t where t.tile_x = g.tile_x and t.tile_y = g.tile_y) as in_footprint from g""")
def footprint_coverage(spark, sf):
    covered = tiles.unique_tiles(spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "(c_custkey*91.7313e0) % 360e0 as ra", "-89.9e0 + ((c_custkey*33.1771e0) % 1798e0)/10e0 as dec_"))
    return tiles.mark_coverage(fixture(spark, sf, "whole_sky"), covered).select("id", "tile_id", "in_footprint")


@query(f"""with b as (select label, count(*) as npix, avg(x) as xcentroid_pix from {LABELS} group by label),
  e as (select try_cast(label as integer) as lab, area, flux, row_number() over (partition by try_cast(label as integer) order by seq desc) as rn
    from (select case when s_suppkey % 9 = 0 then 'x' else cast(s_suppkey % 60 as varchar(20)) end as label,
      s_suppkey as seq, s_nationkey as area, s_acctbal as flux from supplier) t)
  select b.label, npix, round(xcentroid_pix, 6) as xcentroid_pix, e.area as sc_area, e.flux as sc_flux
  from b left join (select * from e where rn = 1 and lab is not null) e on e.lab = b.label""")
def merge_label_catalogs(spark, sf):
    basic = detect.basic_catalog(fixture(spark, sf, "labels")).select(
        "label", "npix", F.round("xcentroid_pix", 6).alias("xcentroid_pix"))
    extended = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "case when s_suppkey % 9 = 0 then 'x' else cast(s_suppkey % 60 as varchar(20)) end as label",
        "s_suppkey as seq", "s_nationkey as area", "s_acctbal as flux")
    return detect.merge_catalogs(basic, extended, "seq")


@query("""select o_orderkey as source_id, o_totalprice as total, l_linenumber, l_extendedprice as total_cat from orders
  left join lineitem on l_orderkey = o_orderkey where o_orderkey in (select c_custkey from customer)""")
def attach_catalog(spark, sf):
    metrics = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as source_id", "o_totalprice as total")
    listed = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as source_id")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey as source_id", "l_linenumber", "l_extendedprice as total")
    return cutouts.attach_catalog(cutouts.keep_listed(metrics, listed), rows)


@query(f"select round(min({RADIUS}), 6) as radius_min, round(max({RADIUS}), 6) as radius_max from {STARS}")
def exclusion_radius_range(spark, sf):
    return xmatch.radius_range(fixture(spark, sf, "stars")).select(
        F.round("radius_min", 6).alias("radius_min"), F.round("radius_max", 6).alias("radius_max"))
