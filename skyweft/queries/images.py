"""Pixel-table queries: masks, smoothing, background, segmentation, peaks, cutouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import Detection, KronCutout, MatchedFilter, StarMask
from ..fixtures import IMAGE_WIDTH, fixture
from ..functions.kernels import gaussian_kernel, gaussian_psf, template_set
from ..functions.sky import TangentPlane
from ..functions import stamps
from ..operators import apertures, cutouts, deblend, detect, mask, match, resize
from . import query
from .sqltext import CATALOG, IMAGE, STARS

MASK_RADIUS = """(case when phot_g_mean_mag is null then 8e0 else
   least(greatest(8e0*pow(10e0, -0.2e0*(phot_g_mean_mag - 15e0)), 1e0), 40e0) end)*1.1e0/8e0"""
# Star centres on the test image grid: every tenth of a pixel, growing with the table.
_CENTERS = f"""(select source_id, (source_id*7.3e0) % 120e0 as cx, (source_id*0.0833e0*13e0) as cy, {MASK_RADIUS} as rad from {STARS})"""


def _placed(spark, sf):
    stars = fixture(spark, sf, "stars").selectExpr(
        "source_id", "(source_id*7.3e0) % 120e0 as cx", "(source_id*0.0833e0*13e0) as cy", "phot_g_mean_mag")
    return stars.withColumn("radius", stamps.mask_radius_pix("phot_g_mean_mag", 8.0, StarMask())).select("cx", "cy", "radius")


def _arm_sql(angle: float, start: str, length: str, width: str) -> str:
    ca, sa = float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))
    along, across = f"(dx*({ca!r}) + dy*({sa!r}))", f"(dy*({ca!r}) - dx*({sa!r}))"
    end = f"({start} + {length})"
    return f"""(({along} >= {start} and {along} <= {end} and abs({across}) <= {width})
      or ({along} - {end})*({along} - {end}) + {across}*{across} <= {width}*{width})"""


def _shape_sql(shape: str) -> str:
    if shape == "circle":
        return "dx*dx + dy*dy <= rad*rad"
    if shape == "jwst":
        sector, half = "(pi()/3e0)", "(pi()/6e0)"
        turned = "(atan2(dy, dx) + pi())"
        theta = f"({turned} - floor({turned}/{sector})*{sector} - {half})"
        arms = [_arm_sql(60.0 * k, "0e0", "1.2e0*rad", "greatest(2e0, 0.12e0*rad)") for k in range(6)]
        return " or ".join([f"sqrt(dx*dx + dy*dy) <= 0.72e0*rad*cos({half})/cos({theta})", *arms])
    arms = []
    for angle in stamps.ARM_ANGLES[shape]:
        diagonal = shape == "star8" and angle % 90.0 != 0.0
        length = f"({0.8 if diagonal else 1.1}e0*unit*{stamps.ARM_LENGTH_SCALE.get(angle, 1.0)}e0)"
        arms.append(_arm_sql(angle, "core", length, "(hw*0.75e0)" if diagonal else "hw"))
    return " or ".join(["dx*dx + dy*dy <= core*core", *arms])


def _mask_sql(shape: str) -> str:
    return f"""with s as (select *, rad/(rad + 18e0) as b, pow(1e0 - rad/(rad + 18e0), 1.35e0) as f from {_CENTERS}),
      g as (select *, rad*(1e0 + f*0.95e0) as eff from s),
      h as (select *, greatest(1e0, 0.45e0*eff*(1e0 + f*1.45e0)) as core, greatest(3.2e0, 0.1e0*eff) as hw,
        eff*(0.98e0 + pow(b, 1.2e0)*0.27e0) as unit from g),
      p as (select i.y, i.x, i.x - h.cx as dx, i.y - h.cy as dy, rad, core, hw, unit from {IMAGE} i join h
        on abs(i.x - h.cx) <= 60e0 and abs(i.y - h.cy) <= 60e0)
      select distinct y, x from p where {_shape_sql(shape)}"""


def _masked(spark, sf, shape):
    return mask.masked_pixels(fixture(spark, sf, "image").select("y", "x"), _placed(spark, sf), StarMask(shape=shape))


@query(_mask_sql("circle"))
def star_mask_circle(spark, sf):
    return _masked(spark, sf, "circle")


@query(_mask_sql("star8"))
def star_mask_star8(spark, sf):
    return _masked(spark, sf, "star8")


@query(_mask_sql("star12"))
def star_mask_star12(spark, sf):
    return _masked(spark, sf, "star12")


@query(_mask_sql("jwst"))
def star_mask_jwst(spark, sf):
    return _masked(spark, sf, "jwst")


@query(f"""with m as ({_mask_sql('star4')}) select i.y, i.x, case when m.y is null then round(v, 6) end as v
   from {IMAGE} i left join m on m.y = i.y and m.x = i.x""")
def masked_image(spark, sf):
    out = mask.apply_mask(fixture(spark, sf, "image"), _placed(spark, sf), StarMask(shape="star4"))
    return out.select("y", "x", F.round("v", 6).alias("v"))


@query(f"""with m as ({_mask_sql('star12')}) select (select count(*) from m) as masked_pixels,
   round((select count(*) from m)/(select count(*) from {IMAGE})::double, 9) as masked_fraction""")
def mask_summary(spark, sf):
    out = mask.mask_summary(fixture(spark, sf, "image").select("y", "x"), _placed(spark, sf))
    return out.select("masked_pixels", F.round("masked_fraction", 9).alias("masked_fraction"))


def _kernel_sql(kernel: np.ndarray) -> str:
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    rows = [f"({dy - ry}, {dx - rx}, {float(kernel[dy, dx])!r}::double)"
            for dy in range(kernel.shape[0]) for dx in range(kernel.shape[1])]
    return f"(select * from (values {', '.join(rows)}) t(dy, dx, k))"


def _correlate_sql(kernel: np.ndarray, table: str = IMAGE) -> str:
    return f"""(select i.y, i.x, sum(k*n.v) as v from {table} i, {_kernel_sql(kernel)} w join {table} n
      on n.y = i.y + dy and n.x = i.x + dx group by i.y, i.x)"""


_KERNEL = gaussian_kernel(2.0 / 2.355)
_SMOOTH = f"""(select n.y - dy as y, n.x - dx as x, sum(k*n.v) as v from {IMAGE} n, {_kernel_sql(_KERNEL)} w
   where n.y - dy between 0 and (select max(y) from {IMAGE}) and n.x - dx between 0 and {IMAGE_WIDTH - 1} group by 1, 2)"""
_ON_IMAGE = f"semi join {IMAGE} i on i.y = s.y and i.x = s.x"


@query(f"select y, x, round(v, 6) as v from {_SMOOTH} s {_ON_IMAGE}")
def smoothed_image(spark, sf):
    return detect.smooth(fixture(spark, sf, "image"), 2.0).select("y", "x", F.round("v", 6).alias("v"))


def _mesh_sql(box: int, iters: int) -> str:
    steps = [f"k0 as (select cast(floor(y/{box}e0) as integer) as by_, cast(floor(x/{box}e0) as integer) as bx, v from {IMAGE})"]
    for i in range(iters):
        steps.append(f"""b{i} as (select by_, bx, quantile_cont(v, 0.5) as c, stddev_pop(v)*3e0 as h from k{i} group by by_, bx),
          k{i + 1} as (select k{i}.* from k{i} join b{i} using (by_, bx) where v between c - h and c + h)""")
    return f"""with {', '.join(steps)}, mesh as (select by_, bx, quantile_cont(v, 0.5) as level, stddev_pop(v) as rms from k{iters} group by by_, bx),
      mf as (select a.by_, a.bx, quantile_cont(b.level, 0.5) as level, quantile_cont(b.rms, 0.5) as rms from mesh a join mesh b
        on abs(a.by_ - b.by_) <= 1 and abs(a.bx - b.bx) <= 1 group by a.by_, a.bx)"""


@query(f"""{_mesh_sql(16, 5)} select by_ as "by", bx, round(level, 6) as level, round(rms, 6) as rms from mf""")
def background_mesh(spark, sf):
    mesh = detect.median_filter_mesh(detect.background_mesh(fixture(spark, sf, "image"), 16))
    return mesh.select("by", "bx", F.round("level", 6).alias("level"), F.round("rms", 6).alias("rms"))


@query(f"""{_mesh_sql(16, 5)}, t as (select y, x, v, (y + 0.5e0)/16e0 - 0.5e0 as ty, (x + 0.5e0)/16e0 - 0.5e0 as tx from {IMAGE}),
  u as (select *, floor(ty) as fy, floor(tx) as fx from t),
  w as (select u.y, u.x, u.v, m.level, m.rms,
     (case when m.by_ = fy then 1e0 - (ty - fy) else ty - fy end)*(case when m.bx = fx then 1e0 - (tx - fx) else tx - fx end) as k
     from u join mf m on m.by_ in (fy, fy + 1) and m.bx in (fx, fx + 1))
  select y, x, round(any_value(v) - sum(k*level)/sum(k), 6) as v, round(sum(k*rms)/sum(k), 6) as rms from w group by y, x""")
def background_subtracted(spark, sf):
    pixels = fixture(spark, sf, "image")
    mesh = detect.median_filter_mesh(detect.background_mesh(pixels, 16))
    out = detect.with_background(pixels, mesh, 16)
    return out.select("y", "x", F.round(F.col("v") - F.col("level"), 6).alias("v"), F.round("rms", 6).alias("rms"))


# Connected components by reachability; isolated bright pixels keep them small.
_ABOVE = f"(select cast(y as bigint)*4294967296 + x as id, y, x, v from {IMAGE} where v > 88e0)"
_REACH = f"""with recursive a as materialized {_ABOVE}, e as materialized (select p.id as u, q.id as w from a p join a q on q.y between p.y - 1 and p.y + 1
     and q.x between p.x - 1 and p.x + 1 and p.id <> q.id),
  r(u, w) as (select id, id from a union select r.u, e.w from r join e on e.u = r.w),
  c as (select u as id, min(w) as root from r group by u),
  s as (select root, count(*) as n, row_number() over (order by root) as label from c group by root having count(*) >= 3)"""


@query(f"""{_REACH} select a.y, a.x, s.label from a join c on c.id = a.id join s on s.root = c.root""")
def segmentation(spark, sf):
    return detect.segment(fixture(spark, sf, "image"), 88.0, 3, tile=64).select("y", "x", "label")


@query(f"""{_REACH} select s.label, count(*) as npix, round(avg(a.x), 6) as xcentroid_pix, round(avg(a.y), 6) as ycentroid_pix,
   min(a.x) as xmin_pix, max(a.x) as xmax_pix, min(a.y) as ymin_pix, max(a.y) as ymax_pix
  from a join c on c.id = a.id join s on s.root = c.root group by s.label""")
def segment_catalog(spark, sf):
    found = detect.segment(fixture(spark, sf, "image"), 88.0, 3, tile=64)
    return detect.basic_catalog(found).withColumns(
        {c: F.round(c, 6) for c in ("xcentroid_pix", "ycentroid_pix")})


# Component tree by reachability at every level; brighter pixels make larger levels.
_TREE = _REACH.replace("v > 88e0", "v > 70e0") + """,
  g as materialized (select a.id, a.y, a.x, a.v, s.label from a join c on c.id = a.id join s on s.root = c.root),
  h as (select label, min(v) as low, max(v) as high, sum(v) as total from g group by label),
  k as materialized (select id, y, x, v, label, total, unnest(range(0, case when high > low then least(floor(ln(v/low)/ln(high/low)*7e0), 6e0) else 0e0 end::integer + 1)) as k
    from g join h using (label)),
  ke as materialized (select p.k, p.id as u, q.id as w from k p join k q on q.k = p.k and q.label = p.label and q.y between p.y - 1 and p.y + 1
    and q.x between p.x - 1 and p.x + 1 and p.id <> q.id),
  kr(k, u, w) as (select k, id, id from k union select r.k, r.u, e.w from kr r join ke e on e.k = r.k and e.u = r.w),
  kc as materialized (select k, u as id, min(w) as root from kr group by k, u),
  n as (select k, root, label, min(struct_pack(v := -v, y := y, x := x, id := id)) as peak from kc join k using (k, id) group by k, root, label, total
    having k = 0 or (count(*) >= 3 and sum(v) >= 0.05e0*total)),
  held as (select distinct p.k, p.root from kc p join kc q on q.id = p.id and q.k = p.k + 1 join n on n.k = q.k and n.root = q.root),
  core as (select *, row_number() over (order by label, root, k) as part from n anti join held using (k, root)),
  inner_node as (select kc.id, max(struct_pack(k := kc.k, root := kc.root)) as node from kc join n using (k, root) group by kc.id),
  inside as (select kc.k, kc.root, peak, part from core join kc on kc.id = core.peak.id and kc.k <= core.k)"""


@query(f"""{_TREE} select g.y, g.x, g.label as parent, min(struct_pack(d := (peak.y - g.y)*(peak.y - g.y) + (peak.x - g.x)*(peak.x - g.x),
   y := peak.y, x := peak.x, part := part)).part as label
  from g join inner_node i using (id) join inside on inside.k = i.node.k and inside.root = i.node.root group by g.y, g.x, g.label""")
def deblended_sources(spark, sf):
    found = detect.segment(fixture(spark, sf, "image"), 70.0, 3, tile=64)
    return deblend.deblend(found, 3, 6, 0.05, tile=64).select("y", "x", "parent", "label")


_ELLIPSES = f"""{_REACH}, o as materialized (select a.y, a.x, s.label from a join c on c.id = a.id join s on s.root = c.root),
  el as materialized (select label, avg(x) as cx, avg(y) as cy, 0.8e0 + count(*)*0.2e0 as sa, 0.5e0 + count(*)*0.1e0 as sb, radians((label*37e0) % 180e0) as t from o group by label)"""


def _around_sql(table: str, scale: str) -> str:
    """Unmasked pixels within the circle around each ellipse."""
    dx, dy = "(i.x - cx)", "(i.y - cy)"
    u, w = f"(({dx}*cos(t) + {dy}*sin(t))/sa)", f"(({dy}*cos(t) - {dx}*sin(t))/sb)"
    return f"""(select e.label, v, sqrt({dx}*{dx} + {dy}*{dy}) as r, sqrt({u}*{u} + {w}*{w}) as re from {table} e join {IMAGE} i
      on abs({dx}) <= {scale}*sa and abs({dy}) <= {scale}*sa and {dx}*{dx} + {dy}*{dy} <= ({scale}*sa)*({scale}*sa)
      left join o on o.y = i.y and o.x = i.x where o.label is null or o.label = e.label)"""


@query(f"""{_ELLIPSES}, k as (select e.*, greatest(case when f > 0 and fr > 0 then fr/f end, 1.4e0) as kron from el e left join
    (select label, sum(v - 40e0) as f, sum((v - 40e0)*re) as fr from {_around_sql("el", "6e0")} where re <= 6e0 group by label) using (label)),
  p as (select q.label, v - 40e0 as v, floor(r/0.5e0) as ring, re <= 2.5e0*kron as within from {_around_sql("k", "(2.5e0*kron)")} q join k using (label)),
  g as (select label, ring, sum(v) as f, sum(case when within then v end) as fi, count(case when within then 1 end) as n from p group by label, ring),
  w as (select *, sum(f) over (partition by label order by ring) as cum, sum(fi) over (partition by label)/2e0 as half from g),
  h as (select label, arg_min((ring + (half - (cum - f))/f)*0.5e0, ring) as r50 from w where half > 0 and cum >= half group by label)
  select k.label, round(kron, 6) as kron_radius, round(sum(fi), 6) as kron_flux, sum(n)::bigint as kron_area, round(any_value(r50), 6) as r50
  from k left join g using (label) left join h using (label) group by k.label, kron""")
def kron_apertures(spark, sf):
    pixels = fixture(spark, sf, "image")
    found = detect.segment(pixels, 88.0, 3, tile=64)
    n = F.count("*")
    shapes = found.groupBy("label").agg(
        F.avg("x").alias("xcentroid"), F.avg("y").alias("ycentroid"), (0.8 + n * 0.2).alias("semimajor_sigma"), (0.5 + n * 0.1).alias("semiminor_sigma"))
    shapes = shapes.withColumn("orientation", (F.col("label") * 37.0) % 180.0)
    out = apertures.kron_apertures(pixels.withColumn("v", F.col("v") - 40.0), found, shapes)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("kron_radius", "kron_flux", "r50")], "kron_area")


@query()
def detected_sources(spark, sf):
    found, _ = detect.detect_sources(fixture(spark, sf, "image"), Detection(threshold_sigma=2.0))
    return detect.merge_catalogs(detect.basic_catalog(found), detect.extended_catalog(found).withColumn("seq", F.lit(0)), "seq")


_PEAK = f"""with recursive lim as (select max(y) as ymax from {IMAGE}),
  p as (select y, x, v, max(v) over (partition by y order by x range between 1 preceding and 1 following) as m1 from {IMAGE}),
  q as (select *, max(m1) over (partition by x order by y range between 1 preceding and 1 following) as m2 from p),
  pk as (select y, x, v from q, lim where v >= 60e0 and v >= m2 and y between 1 and ymax - 1 and x between 1 and {IMAGE_WIDTH - 2})"""


@query(f"{_PEAK} select y, x, round(v, 6) as v from pk")
def local_maxima(spark, sf):
    height = spark.read.parquet(f"{sf}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // IMAGE_WIDTH + 1
    out = match.local_maxima(fixture(spark, sf, "image"), 60.0, height, IMAGE_WIDTH, block=64)
    return out.select("y", "x", F.round("v", 6).alias("v"))


def _greedy_sql(rounds: int, sep: float) -> str:
    """Rounds of greedy suppression: a point that beats all open neighbours stays."""
    near = f"(a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x) < {sep * sep}e0"
    beats = "(b.v > a.v or (b.v = a.v and (b.y < a.y or (b.y = a.y and b.x < a.x))))"
    steps, kept = ["o0 as materialized (select * from pk)"], []
    for i in range(rounds):
        steps.append(f"w{i} as materialized (select * from o{i} a where not exists (select 1 from o{i} b where {near} and {beats}))")
        steps.append(f"o{i + 1} as materialized (select * from o{i} a where not exists (select 1 from w{i} b where {near}))")
        kept.append(f"select * from w{i}")
    return f"{_PEAK}, {', '.join(steps)}, k as ({' union all '.join(kept)}) select y, x, round(v, 6) as v from k"


@query(_greedy_sql(10, 5.0))
def separated_maxima(spark, sf):
    height = spark.read.parquet(f"{sf}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // IMAGE_WIDTH + 1
    peaks = match.local_maxima(fixture(spark, sf, "image"), 60.0, height, IMAGE_WIDTH, block=64)
    return match.suppress_close(peaks, 5.0, "v").select("y", "x", F.round("v", 6).alias("v"))


_TEMPLATES = template_set(gaussian_psf(9, 3.0).astype(float), 0.85, 1.15, 3)


def _response_sql(k: int, t: np.ndarray) -> str:
    # The template may have an even side; its reference pixel is then the lower middle.
    ry, rx = t.shape[0] - 1 - (t.shape[0] - 1) // 2, t.shape[1] - 1 - (t.shape[1] - 1) // 2
    rows = [f"({dy - ry}, {dx - rx}, {float(t[dy, dx])!r}::double)" for dy in range(t.shape[0]) for dx in range(t.shape[1])]
    return f"""select n.y - dy as y, n.x - dx as x, {k} as scale, sum(k*n.v) as v from {IMAGE} n,
      (values {', '.join(rows)}) t(dy, dx, k) group by 1, 2"""


@query(f"""with s as ({' union all '.join(_response_sql(k, t) for k, t in enumerate(_TEMPLATES))}), b as (select y, x, max(v) as v from s group by y, x)
  select s.y, s.x, round(v, 5) as response from b s {_ON_IMAGE}""")
def filter_response(spark, sf):
    out = match.filter_response(fixture(spark, sf, "image"), _TEMPLATES)
    return out.select("y", "x", F.round("response", 5).alias("response"))


@query()
def matched_sources(spark, sf):
    height = spark.read.parquet(f"{sf}/orders.parquet").agg(F.max("o_orderkey")).first()[0] // IMAGE_WIDTH + 1
    return match.find_matches(fixture(spark, sf, "image"), gaussian_psf(9, 3.0).astype(float), height, IMAGE_WIDTH,
                              MatchedFilter(threshold_sigma=3.0))


_WINDOWS = f"""(select source_number, cast(ceil(cx - side/2e0) as integer) as wx0, cast(ceil(cy - side/2e0) as integer) as wy0, side from
   (select source_number, 2*(2 + source_number % 3) + 1 as side, (source_number*3.7e0) % 125e0 - 2e0 as cx, (source_number*0.0083e0) - 1e0 as cy
    from {CATALOG}))"""


def _windows(spark, sf):
    sources = fixture(spark, sf, "catalog").selectExpr(
        "source_number", "cast(2*(2 + source_number % 3) + 1 as int) as side", "(source_number*3.7e0) % 125e0 - 2e0 as cx",
        "(source_number*0.0083e0) - 1e0 as cy")
    return cutouts.with_windows(sources)


@query(f"""select source_number, count(*) as n_pixels, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, round(sum(v), 5) as total
  from {_WINDOWS} w join {IMAGE} i on y >= wy0 and y < wy0 + side and x >= wx0 and x < wx0 + side group by source_number""")
def trimmed_cutouts(spark, sf):
    out = cutouts.trimmed_summary(fixture(spark, sf, "image"), _windows(spark, sf), "source_number")
    return out.withColumn("total", F.round("total", 5))


@query(f"""select source_number, cast(side*side as bigint) as n_pixels, round(coalesce(sum(v), 0e0), 5) as total,
   cast(side*side - count(v) as bigint) as n_filled
  from {_WINDOWS} w left join {IMAGE} i on y >= wy0 and y < wy0 + side and x >= wx0 and x < wx0 + side group by source_number, side""")
def partial_cutouts(spark, sf):
    out = cutouts.partial_cutouts(fixture(spark, sf, "image").withColumn("v", F.col("v") + 1000.0), _windows(spark, sf), "source_number")
    return out.groupBy("source_number").agg(
        F.count("*").alias("n_pixels"), F.round(F.sum(F.when(F.col("v") > 0.0, F.col("v") - 1000.0).otherwise(0.0)), 5).alias("total"),
        F.count_if(F.col("v") == 0.0).alias("n_filled"))


# Two planes with one centre: the reference is turned by 10 degrees and 1.25 times coarser.
_COS10, _SIN10 = 1.25e-4 * float(np.cos(np.radians(10.0))), 1.25e-4 * float(np.sin(np.radians(10.0)))
_XI = f"radians({-_COS10!r}*(x - 59.5e0) + {_SIN10!r}*(y - 59.5e0))"
_ETA = f"radians({_SIN10!r}*(x - 59.5e0) + {_COS10!r}*(y - 59.5e0))"


@query(f"""with t as (select y, x, {_XI} as xi, {_ETA} as eta from {IMAGE}),
  s as (select y, x, -degrees(xi)/1e-4 + 59.5e0 as sx, degrees(eta)/1e-4 + 59.5e0 as sy from t),
  c as (select y, x, cast(floor(sx) as integer) + b as nx, cast(floor(sy) as integer) + a as ny,
    (case when b = 1 then sx - floor(sx) else 1e0 - (sx - floor(sx)) end)*(case when a = 1 then sy - floor(sy) else 1e0 - (sy - floor(sy)) end) as w
    from s, (values (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b)),
  j as (select c.y, c.x, c.w, i.v from c left join {IMAGE} i on i.y = c.ny and i.x = c.nx)
  select y, x, round(case when count(v) = count(*) then sum(w*v) end, 4) as v from j group by y, x""")
def reprojected_image(spark, sf):
    image = fixture(spark, sf, "image")
    source = TangentPlane(60.5, 60.5, 150.0, 2.0, -1e-4, 0.0, 0.0, 1e-4)
    reference = TangentPlane(60.5, 60.5, 150.0, 2.0, -_COS10, _SIN10, _SIN10, _COS10)
    out = cutouts.reproject(image, source, image.select("y", "x"), reference)
    return out.select("y", "x", F.round("v", 4).alias("v"))


@query(f"""select source_number, row_number() over (order by y_image, x_image, source_number) as id from {CATALOG}""")
def numbered_catalog(spark, sf):
    rows = fixture(spark, sf, "catalog").select("source_number", "y_image", "x_image")
    return cutouts.numbered(rows, ["y_image", "x_image", "source_number"]).select("source_number", "id")


@query(f"""select source_number, round(kron_pix, 6) as kron_pix, half_size from (select source_number, kron_radius*(a_world*3600e0/0.187e0) as kron_pix,
   least(1024, greatest(12, cast(ceil(12e0*kron_radius) as integer))) as half_size from {CATALOG}) where kron_pix > 12e0 order by source_number limit 2000""")
def limited_cutout_plan(spark, sf):
    plan = cutouts.plan_kron_cutouts(fixture(spark, sf, "catalog"), 0.187, KronCutout(min_kron_pix=12.0, max_sources=2000))
    return plan.select("source_number", F.round("kron_pix", 6).alias("kron_pix"), "half_size")


@query(f"""select source_number, 1e0 as ok, round(avg(v), 5) as mean, round(max(v), 5) as top
  from {_WINDOWS} w join {IMAGE} i on y >= wy0 and y < wy0 + side and x >= wx0 and x < wx0 + side group by source_number""")
def stamp_metrics(spark, sf):
    stamped = cutouts.window_stamps(fixture(spark, sf, "image"), _windows(spark, sf), "source_number")
    measured = cutouts.measure_stamps(stamped, "source_number",
                                      lambda a: {"P_mean": float(a.mean()), "S_top": float(a.max()), "_hidden": 1.0})
    out = cutouts.spread_metrics(measured, ["mean", "top"])
    return out.select("source_number", "ok", F.round("mean", 5).alias("mean"), F.round("top", 5).alias("top"))


def _axis_sql(axis: str, n_out: int) -> str:
    """(i, o, w): bilinear taps of a smoothed axis, mirrored at the edges."""
    n = f"(select max({axis}) + 1 from {IMAGE})"

    def mirror(e: str) -> str:
        m = f"((({e}) % (2*(n - 1)) + 2*(n - 1)) % (2*(n - 1)))"
        return f"(case when {m} < n then {m} else 2*(n - 1) - {m} end)"

    return f"""(with d as (select n, sigma, cast(floor(4e0*sigma + 0.5e0) as integer) as reach from
      (select n, greatest(0e0, (n/{n_out}e0 - 1e0)/2e0) as sigma from (select {n} as n))),
    g as (select k, g/sum(g) over () as g from (select k, case when reach = 0 then 1e0 else exp(-0.5e0*k*k/(sigma*sigma)) end as g
      from d, range(-1000, 1001) r(k) where abs(k) <= reach)),
    p as (select o, n, {mirror(f"(o + 0.5e0)*n/{n_out}e0 - 0.5e0")} as place from d, range({n_out}) r(o)),
    t as (select o, n, cast(floor(place) as integer) as tap, 1e0 - (place - floor(place)) as w from p
      union all select o, n, cast(floor(place) as integer) + 1, place - floor(place) from p)
    select i, o, sum(w) as w from (select o, {mirror("tap + k")} as i, w*g as w from t, g) group by i, o)"""


@query(f"""select cast(wy.o as integer) as y, cast(wx.o as integer) as x, round(sum(p.v*wy.w*wx.w), 6) as v
  from {IMAGE} p join {_axis_sql('y', 30)} wy on wy.i = p.y join {_axis_sql('x', 150)} wx on wx.i = p.x group by all""")
def resized_image(spark, sf):
    out = resize.resized(fixture(spark, sf, "image"), (30, 150))
    return out.select("y", "x", F.round("v", 6).alias("v"))
