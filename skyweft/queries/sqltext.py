"""SQL fragments shared by the comparison queries."""

from __future__ import annotations

from ..fixtures import fixture_sql

CATALOG, STARS, SAMPLES = fixture_sql("catalog"), fixture_sql("stars"), fixture_sql("samples")
MORPHO, OBSERVATIONS, LABELS = fixture_sql("morpho"), fixture_sql("observations"), fixture_sql("labels")
IMAGE, SKY, TARGETS, MOSAICS = (fixture_sql(n) for n in ("image", "whole_sky", "targets", "mosaics"))


def sep_arcsec(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    sd = f"sin((radians({dec2}) - radians({dec1}))*0.5e0)"
    sr = f"sin((radians({ra2}) - radians({ra1}))*0.5e0)"
    a = f"({sd}*{sd} + cos(radians({dec1}))*cos(radians({dec2}))*{sr}*{sr})"
    return f"(degrees(2e0*asin(least(1e0, sqrt({a}))))*3600e0)"


def mod_floor(x: str, m: str) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


RADIUS = "least(greatest(8e0*pow(10e0, -0.2e0*(coalesce(phot_g_mean_mag, 15e0) - 15e0)), 1e0), 40e0)"
TILE_Y = "cast(round_even((dec_ + 90e0)*2e0, 0) as integer)"
TILE_X = f"cast(round_even(ra*2e0*cos(({TILE_Y}/2e0 - 90e0)*pi()/180e0), 0) as integer)"

QUALITY = """
  coalesce(flags > 3e0, false) as flags_bad,
  ((case when mag_apauto - mag_auto < 0.3e0 then 1 else 0 end)
   + (case when fwhm_world > 0e0 and prediq > 0e0 and fwhm_world*3600e0/prediq < 1.35e0 then 1 else 0 end)
   + (case when a_world > 0e0 and b_world/a_world > 0.75e0 then 1 else 0 end)
   + (case when kron_radius > 0e0 and kron_radius <= 3.8e0 then 1 else 0 end)) >= 3 as point_like,
  (coalesce(mag_cog > predmaglim - 0.5e0, false) or coalesce(magerr_cog > 0.2e0, false)
   or coalesce(magerr_auto > 0.2e0, false)) as faint_bad"""
NOT_NEAR_STAR = f"""not exists (select 1 from {STARS} s
   where {sep_arcsec('c.ra', 'c.dec_', 's.ra', 's.dec_')} <= {RADIUS})"""
AREA = "(pi()*(a_world*3600e0*kron_radius)*(b_world*3600e0*kron_radius))"
BRIGHTNESS = f"""
  {AREA} as area_kron_arcsec2, mag_2arc + 2.5e0*log10(pi()) as mu_2arc,
  1.0857362047581296e0/magerr_2arc as snr_sb_2arc, mag_cog + 2.5e0*log10({AREA}) as mu_cog_kron,
  1.0857362047581296e0/magerr_cog as snr_sb_cog"""
BRIGHT_COLUMNS = ("area_kron_arcsec2", "mu_2arc", "snr_sb_2arc", "mu_cog_kron", "snr_sb_cog")


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def corners(half: str = "half", ra: str = "ra0", dec: str = "dec0") -> list[tuple[str, str, str]]:
    """(name, ra, dec) of a square footprint's corners."""
    return [("1", f"{ra} - {half}", f"{dec} - {half}"), ("2", f"{ra} - {half}", f"{dec} + {half}"),
            ("3", f"{ra} + {half}", f"{dec} + {half}"), ("4", f"{ra} + {half}", f"{dec} - {half}")]


CORNER_COLUMNS = [e for n, ra, dec in corners() for e in (f"{ra} as ra{n}", f"{dec} as dec{n}")]
CORNER_NAMES = [(f"ra{n}", f"dec{n}") for n in "1234"]


def unit(ra: str, dec: str) -> tuple[str, str, str]:
    return (f"cos(radians({dec}))*cos(radians({ra}))", f"cos(radians({dec}))*sin(radians({ra}))", f"sin(radians({dec}))")


def with_vectors(name: str, pairs: list[tuple[str, str]], prefix: str) -> str:
    parts = []
    for i, (ra, dec) in enumerate(pairs, 1):
        parts += [f"{e} as {prefix}{i}{axis}" for e, axis in zip(unit(ra, dec), "xyz")]
    return f"(select *, {', '.join(parts)} from {name})"


def cross(a: str, b: str) -> tuple[str, str, str]:
    return (f"({a}y*{b}z - {a}z*{b}y)", f"({a}z*{b}x - {a}x*{b}z)", f"({a}x*{b}y - {a}y*{b}x)")


def dot(v: tuple[str, str, str], p: str) -> str:
    return f"({v[0]}*{p}x + {v[1]}*{p}y + {v[2]}*{p}z)"


def inside(poly: str, p: str) -> str:
    names = [f"{poly}{i}" for i in range(1, 5)]
    sides = [dot(cross(a, b), p) for a, b in zip(names, names[1:] + names[:1])]
    ccw, cw = " and ".join(f"{s} >= 0e0" for s in sides), " and ".join(f"{s} <= 0e0" for s in sides)
    return f"(({ccw}) or ({cw}))"
