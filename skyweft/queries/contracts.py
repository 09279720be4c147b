"""Queries for the corners of the contracts: late headers and files of different
columns, non-finite values, missing positions, extraction rows, star tables,
paged responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Detection, SourceCutout
from ..functions import sky
from ..operators import cutouts, detect, stats, tiles, xmatch
from ..plans.lineage import checkpoint_root
from ..sinks.text import key_union
from ..sources import ascii as ascii_source
from ..sources import remote
from . import query
from .sqltext import TILE_X, TILE_Y, mod_floor


@query("""select p_partkey as number, p_size*1e0 as ra, (p_partkey % 90)*1e0 as dec_, p_size + 0.5e0 as mag_auto from part""")
def late_header_catalog(spark, sf):
    """Four catalog files with their columns in two orders; the last header line
    stands at the end of each file."""
    part = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey % 4 as bucket", "p_partkey", "cast(p_size as string) as ra", "cast(p_partkey % 90 as string) as dec_",
        "concat(p_size, '.5') as mag")
    even = F.col("bucket") % 2 == 0
    body = part.select("bucket", F.col("p_partkey").alias("seq"), F.concat_ws(
        " ", "p_partkey", F.when(even, F.col("ra")).otherwise(F.col("mag")),
        F.when(even, F.col("mag")).otherwise(F.col("ra")), "dec_").alias("line"))
    heads = [(b, -9, "# 1 NUMBER") for b in range(4)] + [(b, 1 << 40, "# 4 DELTA_J2000") for b in range(4)]
    heads += [(b, -8, "# 2 RA" if b % 2 == 0 else "# 2 MAG_AUTO") for b in range(4)]
    heads += [(b, -7, "# 3 MAG_AUTO" if b % 2 == 0 else "# 3 RA") for b in range(4)]
    lines = spark.createDataFrame(heads, "bucket bigint, seq bigint, line string").unionByName(body)
    path = f"{checkpoint_root(spark)}/catalog-{uuid.uuid4().hex}"
    lines.repartition("bucket").sortWithinPartitions("bucket", "seq").select("bucket", "line").write.partitionBy("bucket").text(path)
    read = ascii_source.read_catalog(spark, path)
    number = F.split("line", " ")[0].cast("bigint")
    return read.select(number.alias("number"), "ra", "dec_", "mag_auto")


_ODD = """case when l_orderkey % 97 = 0 then cast('NaN' as double) when l_orderkey % 89 = 0 then cast('Infinity' as double)
   when l_orderkey % 83 = 0 then cast('-Infinity' as double) else l_extendedprice end"""


@query(f"""select l_returnflag, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as q2,
   true as same_by_rank from (select l_returnflag, {_ODD} as v from lineitem) where isfinite(v) group by l_returnflag""")
def quantiles_with_nonfinite(spark, sf):
    """Both ways to a quantile over values with NaN and infinities, bit for bit."""
    values = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_returnflag", f"{_ODD} as v")
    direct = stats.exact_quantiles(values, "v", [0.25, 0.5], ["q1", "q2"], ["l_returnflag"])
    ranked = stats.exact_quantiles(values, "v", [0.25, 0.5], ["r1", "r2"], ["l_returnflag"], direct=0)
    same = (F.col("q1") == F.col("r1")) & (F.col("q2") == F.col("r2"))
    return direct.join(ranked, "l_returnflag").select(
        "l_returnflag", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("q2"), same.alias("same_by_rank"))


_HOLES = """case when o_orderkey % 7 = 0 then cast('NaN' as double) when o_orderkey % 11 = 0 then null
   else (o_orderkey*137.50776405e0) % 360e0 end"""


@query(f"""select {TILE_X} as tile_x, {TILE_Y} as tile_y, count(*) as n from
   (select {_HOLES} as ra, -89.9e0 + ((o_orderkey*7.391e0) % 1798e0)/10e0 as dec_ from orders)
   where ra is not null and not isnan(ra) group by 1, 2""")
def tiles_with_missing_positions(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        f"{_HOLES} as ra", "-89.9e0 + ((o_orderkey*7.391e0) % 1798e0)/10e0 as dec_")
    return tiles.with_tile(rows).where("tile_y is not null").groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


_SMA = "case when p_partkey % 13 = 0 then cast('NaN' as double) else 1e0 + (p_partkey % 40)*0.5e0 end"
_XI, _ETA = "radians(-0.1e0/3600e0*(x + 1e0 - 500.5e0))", "radians(0.1e0/3600e0*(y + 1e0 - 400.5e0))"


@query(f"""with s as (select p_partkey as id, (p_partkey % 1000)*1e0 as x, (p_partkey % 800)*1e0 as y, {_SMA} as a, 2e0 + p_size*0.02e0 as kron from part),
  t as (select *, case when isnan(a) then null else a end as sma, {_XI} as xi, {_ETA} as eta from s),
  w as (select *, cos(radians(2e0)) - eta*sin(radians(2e0)) as den from t)
  select id, round({mod_floor('150e0 + degrees(atan2(xi, den))', '360e0')}, 8) as ra,
   round(degrees(atan2(sin(radians(2e0)) + eta*cos(radians(2e0)), sqrt(xi*xi + den*den))), 8) as dec_,
   round(kron*sma, 6) as kron_radius, 0.1e0 as pixscale_arcsec, sma is null as shape_missing from w""")
def extraction_rows(spark, sf):
    found = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey as id", "(p_partkey % 1000)*1e0 as x", "(p_partkey % 800)*1e0 as y", f"{_SMA} as sma", "1e0 as smi",
        "2e0 + p_size*0.02e0 as kron")
    scale = 0.1 / 3600.0
    rows = cutouts.catalog_rows(found, SourceCutout(), wcs=sky.TangentPlane(500.5, 400.5, F.lit(150.0), F.lit(2.0), *map(F.lit, (-scale, 0.0, 0.0, scale))))
    return rows.select("id", F.round("ra", 8).alias("ra"), F.round("dec_", 8).alias("dec_"), F.round("kron_radius", 6).alias("kron_radius"),
                       F.round("pixscale_arcsec", 9).alias("pixscale_arcsec"), "shape_missing")


@query("""select c_custkey as id, (c_custkey % 500)*1e0 - 1e0 as x, c_nationkey*1e0 - 1e0 as y from customer
   where c_custkey % 3 = 0 and c_custkey % 10 <> 0""")
def detector_positions(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey as id", "case when c_custkey % 10 = 0 then cast('NaN' as double) else (c_custkey % 500)*1e0 end as X_IMAGE",
        "c_nationkey*1e0 as Y_IMAGE", "cast(c_custkey % 3 as int) as IMAFLAGS_ISO")
    return detect.detector_rows(rows).select("id", "x", "y")


@query("""select c_custkey*1e0 as ra, c_nationkey*1e0 as dec_, 12e0 + (c_custkey % 80)*0.1e0 as phot_g_mean_mag from customer
   where c_custkey % 6 <> 0 and c_custkey % 9 <> 0 and 12e0 + (c_custkey % 80)*0.1e0 <= 18e0""")
def sanitized_stars(spark, sf):
    """Text columns with holes: 'x' and 'NaN' are no positions, '' is no magnitude."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "case when c_custkey % 6 = 0 then 'x' else cast(c_custkey as string) end as RA", "cast(c_nationkey as string) as Dec",
        "case when c_custkey % 9 = 0 then '' else cast(12e0 + (c_custkey % 80)*0.1e0 as string) end as phot_g_mean_mag")
    return xmatch.sanitize_stars(rows, mag_limit=18.0)


_SHORT = "(select conv_id, min(turn) as last from conversations where turn % 3 = 2 group by conv_id)"


@query(f"""select c.conv_id, c.turn as page from conversations c left join {_SHORT} s on s.conv_id = c.conv_id
   where s.last is null or c.turn <= s.last""")
def paged_responses(spark, sf):
    """Each conversation is one request; every third page is shorter than the page
    size and ends its loop."""
    pages = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id", "turn as page", "case when turn % 3 = 2 then '{\"data\": [{\"a\": 1}]}' else '{\"data\": [{\"a\": 1}, {\"b\": 2}]}' end as payload")
    return remote.accepted_pages(pages, 2, request=["conv_id"]).select("conv_id", "page")


@query("""select o_orderkey as id, case when o_orderkey % 2 = 0 then o_orderstatus end as even_status,
   case when o_orderkey % 3 = 0 then cast(o_custkey as varchar) end as third_customer from orders""")
def spread_properties(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as id", """map_filter(map(
        'even_status', case when o_orderkey % 2 = 0 then o_orderstatus end,
        'third_customer', case when o_orderkey % 3 = 0 then cast(o_custkey as string) end), (k, v) -> v is not null) as props""")
    return key_union(rows, "props")


_EXPOSURES = """(select cast(l_linenumber as integer) as exposure, cast(l_orderkey % 120 as integer) as y, cast(l_partkey % 100 as integer) as x,
   avg(l_extendedprice/997e0 + case when l_extendedprice > 90000e0 then 300e0 else 0e0 end) as v from lineitem group by 1, 2, 3)"""
_CLIPPED = ["k0 as (select exposure, v from px)"] + [
    f"""b{i} as (select exposure, quantile_cont(v, 0.5) as c, stddev_pop(v)*3e0 as h from k{i} group by exposure),
    k{i + 1} as (select k.exposure, k.v from k{i} k join b{i} b on b.exposure = k.exposure where k.v between c - h and c + h)""" for i in range(5)]


@query(f"""with recursive px as materialized {_EXPOSURES}, {', '.join(_CLIPPED)},
  t as materialized (select exposure, quantile_cont(v, 0.5) + 3e0*stddev_pop(v) as limit_ from k5 group by exposure),
  a as materialized (select p.exposure, cast(y as bigint)*4294967296 + x as id, y, x, v from px p join t on t.exposure = p.exposure where v > limit_),
  e as materialized (select p.exposure, p.id as u, q.id as w from a p join a q on q.exposure = p.exposure
     and q.y between p.y - 1 and p.y + 1 and q.x between p.x - 1 and p.x + 1 and p.id <> q.id),
  r(exposure, u, w) as (select exposure, id, id from a union select r.exposure, r.u, e.w from r join e on e.u = r.w and e.exposure = r.exposure),
  c as (select exposure, u as id, min(w) as root from r group by 1, 2),
  s as (select exposure, root, count(*) as n, row_number() over (partition by exposure order by root) as label from c group by 1, 2 having count(*) >= 2)
  select a.exposure, s.label, count(*) as npix, round(avg(a.x), 6) as xcentroid_pix, round(avg(a.y), 6) as ycentroid_pix, round(sum(a.v), 4) as flux
  from a join c on c.id = a.id and c.exposure = a.exposure join s on s.root = c.root and s.exposure = a.exposure group by 1, 2""")
def detected_sources_per_image(spark, sf):
    """Every exposure is an image with its own clipped threshold and labels."""
    pixels = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "cast(l_linenumber as int) as exposure", "cast(l_orderkey % 120 as int) as y", "cast(l_partkey % 100 as int) as x",
        "l_extendedprice/997e0 + case when l_extendedprice > 90000e0 then 300e0 else 0e0 end as v",
    ).groupBy("exposure", "y", "x").agg(F.avg("v").alias("v"))
    found, _ = detect.detect_sources(pixels, Detection(threshold_sigma=3.0, npixels=2, smooth_fwhm=0.0), ["exposure"])
    sums = found.groupBy("exposure", "label").agg(F.round(F.sum("v"), 4).alias("flux"))
    rows = detect.basic_catalog(found, ["exposure", "label"]).join(sums, ["exposure", "label"])
    return rows.select("exposure", "label", "npix", F.round("xcentroid_pix", 6).alias("xcentroid_pix"),
                       F.round("ycentroid_pix", 6).alias("ycentroid_pix"), "flux")
