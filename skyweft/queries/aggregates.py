"""Coadds, grouped catalogs, exact quantiles, clipped statistics, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Coadd
from ..fixtures import fixture
from ..operators import coadd, detect, match, stats
from . import query
from .sqltext import IMAGE, LABELS, SAMPLES


def r(c, digits: int = 6):
    return F.round(c, digits)


_W = "case when wht <= 0e0 then 0e0 else wht end"


@query(f"""select y, x, round(case when sum({_W}) > 0e0 then sum(sci*{_W})/sum({_W}) end, 6) as sci,
   round(case when sum({_W}) > 0e0 then sqrt(1e0/sum({_W})) end, 6) as err, round(sum({_W}), 6) as wht
  from {SAMPLES} group by y, x""")
def weighted_coadd(spark, sf):
    out = coadd.weighted_coadd(fixture(spark, sf, "samples"), Coadd(output_type="float64"))
    return out.select("y", "x", *[r(c).alias(c) for c in ("sci", "err", "wht")])


def _clip_sql(sigma: float, iters: int) -> str:
    steps = [f"k0 as (select y, x, sci, {_W} as w from {SAMPLES})"]
    for i in range(iters):
        steps.append(f"""b{i} as (select y, x, quantile_cont(sci, 0.5) as c, stddev_pop(sci)*{sigma}e0 as h from k{i} group by y, x),
          k{i + 1} as (select k{i}.* from k{i} join b{i} using (y, x) where sci >= c - h and sci <= c + h)""")
    return f"""with {', '.join(steps)}, p as (select distinct y, x from {SAMPLES}),
      s as (select y, x, sum(w) as w, sum(w*sci) as wx from k{iters} group by y, x)
      select y, x, round(case when w > 0e0 then wx/w end, 6) as sci, round(case when w > 0e0 then sqrt(1e0/w) end, 6) as err,
        round(coalesce(w, 0e0), 6) as wht from p left join s using (y, x)"""


@query(_clip_sql(1.5, 5))
def clipped_coadd(spark, sf):
    out = coadd.clipped_coadd(fixture(spark, sf, "samples"), Coadd(sigma=1.5, output_type="float64"))
    return out.select("y", "x", *[r(c).alias(c) for c in ("sci", "err", "wht")])


@query(f"select y, x, round(coalesce(avg(sci), 0e0), 6) as v from {SAMPLES} group by y, x")
def detection_stack(spark, sf):
    return coadd.detection_stack(fixture(spark, sf, "samples")).select("y", "x", r("v").alias("v"))


@query(f"""select exposure, y, x, sci, case when wht < 5e0 or wht <= 0e0 then 0e0 else wht end as wht,
   round(case when wht >= 5e0 then 1e0/sqrt(wht) end, 9) as err from {SAMPLES}""")
def sanitized_weights(spark, sf):
    clean = coadd.sanitize_weights(fixture(spark, sf, "samples"), Coadd(weight_floor=5.0))
    return coadd.error_map(clean).select("exposure", "y", "x", "sci", "wht", r("err", 9).alias("err"))


@query(f"""select label, count(*) as npix, round(avg(x), 6) as xcentroid_pix, round(avg(y), 6) as ycentroid_pix,
   min(x) as xmin_pix, max(x) as xmax_pix, min(y) as ymin_pix, max(y) as ymax_pix from {LABELS} where label > 0 group by label""")
def label_catalog(spark, sf):
    out = detect.basic_catalog(fixture(spark, sf, "labels"))
    return out.withColumns({c: r(c) for c in ("xcentroid_pix", "ycentroid_pix")})


_S = """select label, count(*) as area, sum(v) as segment_flux, sum(v*x)/sum(v) as cx, sum(v*y)/sum(v) as cy,
   sum(v*x*x)/sum(v) as xx, sum(v*y*y)/sum(v) as yy, sum(v*x*y)/sum(v) as xy from {t} group by label"""


@query(f"""with s as ({_S.format(t=LABELS)}), c as (select *, xx - cx*cx as a, yy - cy*cy as b, xy - cx*cy as c from s),
  d as (select label, area, segment_flux, cx, cy, c, case when a*b - c*c < 1e0/144e0 then a + 1e0/12e0 else a end as a,
    case when a*b - c*c < 1e0/144e0 then b + 1e0/12e0 else b end as b from c),
  e as (select *, (a + b)/2e0 as m, sqrt((a - b)*(a - b)/4e0 + c*c) as q from d)
  select label, area, round(segment_flux, 4) as segment_flux, round(cx, 5) as xcentroid, round(cy, 5) as ycentroid,
   round(sqrt(m + q), 5) as semimajor_sigma, round(sqrt(greatest(m - q, 0e0)), 5) as semiminor_sigma,
   round(degrees(0.5e0*atan2(2e0*c, a - b)), 4) as orientation, round(sqrt(m + q)/sqrt(m - q), 5) as elongation,
   round(sqrt(area/pi()), 6) as equivalent_radius from e""")
def label_moments(spark, sf):
    m = detect.moments(fixture(spark, sf, "labels"))
    return m.select("label", "area", r("segment_flux", 4).alias("segment_flux"),
                    *[r(c, 5).alias(c) for c in ("xcentroid", "ycentroid", "semimajor_sigma", "semiminor_sigma")],
                    r("orientation", 4).alias("orientation"), r("elongation", 5).alias("elongation"),
                    r("equivalent_radius").alias("equivalent_radius"))


@query("""select round(quantile_cont(l_extendedprice, 0.01), 6) as p01, round(quantile_cont(l_extendedprice, 0.5), 6) as p50,
   round(quantile_cont(l_extendedprice, 0.997), 6) as p997 from lineitem""")
def whole_table_quantiles(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = stats.exact_quantiles(li, "l_extendedprice", [0.01, 0.5, 0.997], ["p01", "p50", "p997"])
    return out.select(*[r(c).alias(c) for c in ("p01", "p50", "p997")])


@query("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.75), 6) as q3
   from lineitem group by l_returnflag""")
def grouped_quantiles(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = stats.exact_quantiles(li, "l_extendedprice", [0.25, 0.75], ["q1", "q3"], ["l_returnflag"])
    return out.select("l_returnflag", r("q1").alias("q1"), r("q3").alias("q3"))


@query("""with m as (select quantile_cont(l_extendedprice, 0.5) as med from lineitem),
  d as (select quantile_cont(abs(l_extendedprice - med), 0.5) as mad from lineitem, m)
  select round(med, 6) as median, round(1.4826e0*mad, 6) as sigma from m, d""")
def robust_sigma(spark, sf):
    med, sigma = stats.robust_sigma(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")
    return spark.range(1).select(r(F.lit(med)).alias("median"), r(F.lit(sigma)).alias("sigma"))


def _clipped_stats_sql(table: str, sigma: int, iters: int) -> str:
    steps = [f"k0 as (select v from {table})"]
    for i in range(iters):
        steps.append(f"""b{i} as (select quantile_cont(v, 0.5) as c, stddev_pop(v)*{sigma}e0 as h from k{i}),
          k{i + 1} as (select v from k{i}, b{i} where v between c - h and c + h)""")
    return f"""with {', '.join(steps)} select count(*) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as median,
      round(stddev_pop(v), 6) as std from k{iters}"""


@query(_clipped_stats_sql(IMAGE, 3, 5))
def clipped_statistics(spark, sf):
    s = stats.clipped_stats(fixture(spark, sf, "image"), "v", 3.0, 5)
    return spark.range(1).select(F.lit(s["n"]).cast("bigint").alias("n"), *[r(F.lit(s[k])).alias(k) for k in ("mean", "median", "std")])


_RGB = """(select o_orderkey as id, v as r, sqrt(v) as g, v*v/500e0 as b from (select o_orderkey,
   (o_totalprice % 1000e0)/10e0 + case when o_totalprice > 440000e0 then 400e0 else 0e0 end as v from orders))"""


def _stretch_sql(c: str, gain: str) -> str:
    norm = f"least(greatest(({c} - {c}lo)/({c}hi - {c}lo), 0e0), 1e0)"
    return f"pow(least({gain}*asinh(20e0*{norm})/asinh(20e0), 1e0), 0.6e0)"


_LIMITS = ", ".join(f"quantile_cont({c}, 0.042) as {c}lo, quantile_cont({c}, 0.9999) as {c}hi" for c in "rgb")
_RGB_OUT = f"""(select id, {_stretch_sql('r', '0.36e0')} as r, {_stretch_sql('g', '0.46e0')} as g, {_stretch_sql('b', '0.36e0')} as b
   from {_RGB}, (select {_LIMITS} from {_RGB}))"""


def _channels(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey as id", "(o_totalprice % 1000e0)/10e0 + case when o_totalprice > 440000e0 then 400e0 else 0e0 end as v"
    ).selectExpr("id", "v as r", "sqrt(v) as g", "v*v/500e0 as b")


@query(f"select id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from {_RGB_OUT}")
def rgb_composite(spark, sf):
    return stats.rgb_composite(_channels(spark, sf)).select("id", *[r(c).alias(c) for c in "rgb"])


@query(f"""select round(avg(case when r >= 0.995e0 and g >= 0.995e0 and b >= 0.995e0 then 1e0 else 0e0 end), 6) as sat_frac,
   round(avg(case when (r + g + b)/3e0 < 0.03e0 then 1e0 else 0e0 end), 6) as near_black_frac from {_RGB_OUT}""")
def rgb_fractions(spark, sf):
    out = stats.rgb_fractions(stats.rgb_composite(_channels(spark, sf)))
    return out.select(r("sat_frac").alias("sat_frac"), r("near_black_frac").alias("near_black_frac"))


@query(f"""with m as (select min(v) as lo, max(v) as hi from {IMAGE}) select y, x, round((v - lo)/(hi - lo), 9) as v from {IMAGE}, m""")
def unit_range(spark, sf):
    return stats.unit_range(fixture(spark, sf, "image")).select("y", "x", r("v", 9).alias("v"))


@query("""with f as (select l_suppkey, count(*) as n, regr_slope(l_extendedprice, l_quantity) as fit_amp, corr(l_extendedprice, l_quantity) as c
   from lineitem group by l_suppkey) select l_suppkey, n, round(fit_amp, 6) as fit_amp, round(c, 6) as fit_corr,
   round(sqrt(greatest(0e0, 1e0 - c*c)), 6) as fit_rms_ratio from f""")
def local_fit(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey", "l_extendedprice as d", "l_quantity as t")
    fits = match.local_fit(li, ["l_suppkey"])
    return fits.select("l_suppkey", "n", *[r(c).alias(c) for c in ("fit_amp", "fit_corr", "fit_rms_ratio")])


@query(f"""select y, x, exposure as scale, sci as response from (select *, row_number() over (partition by y, x order by sci desc, exposure) as rn
   from {SAMPLES}) where rn = 1""")
def best_scale(spark, sf):
    samples = fixture(spark, sf, "samples").selectExpr("y", "x", "exposure as scale", "sci as response")
    return match.best_scale(samples)
