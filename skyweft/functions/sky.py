"""Spherical geometry as Column expressions. Angles are degrees unless named
otherwise. Every function returns NULL when an input is NULL."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import StarRadius

ARCSEC = 3600.0
HALF_TILE_DEG = 0.25


def col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (greatest/least skip NULLs)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def separation_rad(ra1, dec1, ra2, dec2) -> Column:
    """Haversine separation; sin**2 makes the RA wrap implicit."""
    ra1, dec1, ra2, dec2 = (F.radians(col(c)) for c in (ra1, dec1, ra2, dec2))
    sdec, sra = F.sin((dec2 - dec1) * 0.5), F.sin((ra2 - ra1) * 0.5)
    a = sdec * sdec + F.cos(dec1) * F.cos(dec2) * sra * sra
    return 2.0 * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def separation_arcsec(ra1, dec1, ra2, dec2) -> Column:
    return F.degrees(separation_rad(ra1, dec1, ra2, dec2)) * ARCSEC


def star_radius_arcsec(mag: Column | str, cfg: StarRadius = StarRadius()) -> Column:
    m = col(mag)
    if cfg.null_mag == "mag0":
        m = F.coalesce(m, F.lit(cfg.mag0))
    r = clamp(F.lit(cfg.r0) * F.pow(F.lit(10.0), -0.2 * (m - cfg.mag0)), cfg.min_radius, cfg.max_radius)
    return F.coalesce(r, F.lit(cfg.r0)) if cfg.null_mag == "r0" else r


def wrap360(deg: Column | str) -> Column:
    return F.pmod(col(deg), F.lit(360.0))


def region_angle(theta: Column | str) -> Column:
    """East-of-north angle to the +X convention, in [-180, 180)."""
    return F.pmod(F.lit(270.0) - col(theta), F.lit(360.0)) - 180.0


def region_angle_half_turn(pa: Column | str) -> Column:
    return F.pmod(col(pa) + 90.0, F.lit(180.0))


# -- sky tiles: 0.5 degree grid, row by Dec, column scaled by cos(Dec) ---------

def tile_row(dec: Column | str) -> Column:
    return F.rint((col(dec) + 90.0) * 2.0).cast("int")  # half to even


def tile_column(ra: Column | str, row: Column) -> Column:
    cosd = F.cos((row / F.lit(2.0) - 90.0) * F.lit(math.pi) / 180.0)
    return F.rint(col(ra) * 2.0 * cosd).cast("int")


def sky_tile(ra: Column | str, dec: Column | str) -> Column:
    """struct(tile_x, tile_y); both are NULL where a coordinate is missing or not finite"""
    both = finite(ra).isNotNull() & finite(dec).isNotNull()
    row = F.when(both, tile_row(finite(dec)))
    return F.struct(F.when(both, tile_column(finite(ra), row)).alias("tile_x"), row.alias("tile_y"))


def tile_center_dec(tile_y: Column | str) -> Column:
    return col(tile_y) / F.lit(2.0) - 90.0


def tile_center_ra(tile_x: Column | str, tile_y: Column | str, min_cos: float = 1e-9) -> Column:
    """NULL next to the poles, where the RA scale diverges."""
    cosd = F.cos(F.radians(tile_center_dec(tile_y)))
    return F.when(F.abs(cosd) >= min_cos, F.pmod(F.try_divide(col(tile_x), 2.0 * cosd), F.lit(360.0)))


def wrap_segments(ra_min: Column, ra_max: Column) -> Column:
    """Split an RA interval at 0/360 into one or two structs (ra_min, ra_max)."""

    def seg(a: Column, b: Column) -> Column:
        return F.struct(a.alias("ra_min"), b.alias("ra_max"))

    return (
        F.when(ra_min < 0.0, F.array(seg(ra_min + 360.0, F.lit(360.0)), seg(F.lit(0.0), ra_max)))
        .when(ra_max >= 360.0, F.array(seg(ra_min, F.lit(360.0)), seg(F.lit(0.0), ra_max - 360.0)))
        .otherwise(F.array(seg(ra_min, ra_max)))
    )


def unit_vector(ra: Column | str, dec: Column | str) -> tuple[Column, Column, Column]:
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


AXES = "xyz"


def vector_columns(name: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{name}{a}") for a in AXES)


def _named(name: str, vector) -> dict[str, Column]:
    return {f"{name}{a}": c for a, c in zip(AXES, vector)}


def with_point_vector(df, ra: str = "ra", dec: str = "dec_"):
    return df.withColumns(_named("_p", unit_vector(ra, dec)))


def with_polygon_edges(df, corners: list[tuple[str, str]]):
    """Add the shape of a convex footprint as columns: its unit centre ``_c``,
    ``_cosr`` and ``_capr`` (the centre-to-corner radius) and ``_edges``, one struct
    per edge with start corner v, normal n of length l, and the two vectors f, g
    that tell whether a point lies between the edge's ends. Join conditions then
    need only dot products."""
    n = len(corners)

    def struct_of(prefix: str, vector) -> list[Column]:
        return [c.alias(f"{prefix}{a}") for a, c in zip(AXES, vector)]

    def edge(a: Column, i: Column) -> Column:
        """Edge from corner i to the next; lambdas name the intermediate vectors."""
        va = _field(a, "v")

        def with_next(b: Column) -> Column:
            vb = _field(b, "v")

            def with_normal(e: Column) -> Column:
                normal = _field(e, "n")
                return F.struct(*struct_of("v", va), *struct_of("n", normal), *struct_of("f", cross(normal, va)),
                                *struct_of("g", cross(normal, vb)), F.sqrt(dot(normal, normal)).alias("l"))

            return bind(F.struct(*struct_of("n", cross(va, vb))), with_normal)

        return bind(F.get("_vs", (i + 1) % n), with_next)

    places = F.array(*[F.struct(F.col(r).alias("ra"), F.col(d).alias("dec")) for r, d in corners])
    df = df.withColumn("_vs", F.transform(places, lambda c: F.struct(*struct_of("v", unit_vector(c["ra"], c["dec"])))))
    df = df.withColumns({f"_t{a}": F.aggregate("_vs", F.lit(0.0), lambda t, v: t + v[f"v{a}"]) for a in AXES})
    length = F.sqrt(dot(vector_columns("_t"), vector_columns("_t")))
    df = df.withColumns({f"_c{a}": F.col(f"_t{a}") / length for a in AXES})
    nearest = F.array_min(F.transform("_vs", lambda v: dot(_field(v, "v"), vector_columns("_c"))))
    df = df.withColumns({"_cosr": nearest - 1e-12, "_edges": F.transform("_vs", edge)})
    return df.withColumn("_capr", F.acos("_cosr")).drop("_vs", "_tx", "_ty", "_tz")


def bind(value: Column, body) -> Column:
    """Let-binding: a one-element transform computes ``value`` once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


POLYGON_COLUMNS = ["_cx", "_cy", "_cz", "_cosr", "_capr", "_edges", "_px", "_py", "_pz"]


def polygon_center() -> tuple[Column, Column]:
    x, y, z = vector_columns("_c")
    return wrap360(F.degrees(F.atan2(y, x))), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def in_bounding_cap() -> Column:
    return dot(vector_columns("_c"), vector_columns("_p")) >= F.col("_cosr")


def _field(e: Column, name: str) -> tuple[Column, Column, Column]:
    return tuple(e[f"{name}{a}"] for a in AXES)


def in_convex_polygon() -> Column:
    """The point is on one side of all edges, whatever the winding. Use together
    with ``in_bounding_cap``, which rules out the antipodal polygon."""
    p = vector_columns("_p")
    return F.forall("_edges", lambda e: dot(_field(e, "n"), p) >= 0.0) | F.forall(
        "_edges", lambda e: dot(_field(e, "n"), p) <= 0.0)


def with_edge_normals(df, corners: int):
    """``_edges`` as plain columns ``_n0x``.. of the normals: join conditions on them
    are compiled, which functions of arrays are not."""
    normals = {f"_n{i}{a}": F.get("_edges", F.lit(i))[f"n{a}"] for i in range(corners) for a in AXES}
    return df.withColumns(normals).drop("_edges")


def normal_columns(corners: int) -> list[str]:
    return [f"_n{i}{a}" for i in range(corners) for a in AXES]


def inside_normals(corners: int) -> Column:
    """``in_convex_polygon`` on the columns of ``with_edge_normals``."""
    sides = [dot(vector_columns(f"_n{i}"), vector_columns("_p")) for i in range(corners)]
    return reduce(and_, [s >= 0.0 for s in sides]) | reduce(and_, [s <= 0.0 for s in sides])


def polygon_covers_cell(height: float) -> Column:
    """The convex footprint surely holds every point of its row's cell (``_zone``,
    ``_cell``): its edges are further from the cell's centre than the cell's corners."""
    n = _cells_in_zone(F.col("_zone"), height)
    low = F.col("_zone") * F.lit(height) - 90.0
    high = F.least(low + height, F.lit(90.0))
    dec, half = (low + high) / 2.0, F.lit(180.0) / n
    ra = F.col("_cell") * 360.0 / n + half
    reach = F.greatest(*[separation_rad(ra, dec, ra + half, d) for d in (low, high)]) + 1e-10
    center = unit_vector(ra, dec)

    def clear(reach: Column) -> Column:
        away = F.sin(reach)
        held = F.forall("_edges", lambda e: dot(_field(e, "n"), center) >= away * e["l"]) | F.forall(
            "_edges", lambda e: dot(_field(e, "n"), center) <= -away * e["l"])
        return held & (reach < 0.5)

    return (dot(vector_columns("_c"), center) >= F.col("_cosr")) & bind(reach, clear)


def circle_meets_polygon(radius_deg: str) -> Column:
    """Circle and convex polygon overlap: centre inside, a corner in reach, or an
    edge (great-circle segment) in reach."""
    p = vector_columns("_p")
    sin_r, cos_r = F.sin(F.radians(radius_deg)), F.cos(F.radians(radius_deg))

    def reached(e: Column) -> Column:
        near = F.abs(dot(_field(e, "n"), p)) <= sin_r * e["l"]
        between = (dot(_field(e, "f"), p) >= 0.0) & (dot(_field(e, "g"), p) <= 0.0)
        return (dot(_field(e, "v"), p) >= cos_r) | (near & between)

    return (in_bounding_cap() & in_convex_polygon()) | F.exists("_edges", reached)


# -- equal-height cells for range joins ---------------------------------------

def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90.0) / F.lit(height)).cast("int")


def _cells_in_zone(zone: Column, height: float) -> Column:
    """How many RA cells a zone holds; each is at least ``height`` wide."""
    low = zone * F.lit(height) - 90.0
    edge = F.least(F.greatest(F.abs(low), F.abs(low + height)), F.lit(90.0))
    n = F.floor(360.0 * F.cos(F.radians(edge)) / F.lit(height))
    return F.greatest(n, F.lit(1)).cast("bigint")


def point_cell(ra: Column | str, dec: Column | str, height: float) -> Column:
    """struct(zone, cell) holding a point; NULL fields for coordinates that are
    NULL or not finite."""
    zone = _zone(col(dec), height)
    n = _cells_in_zone(zone, height)
    cell = F.least(F.floor(wrap360(ra) * n / 360.0).cast("bigint"), n - 1)
    known = finite(ra).isNotNull() & finite(dec).isNotNull()
    return F.struct(F.when(known, zone).alias("zone"), F.when(known, cell).alias("cell"))


def circle_cells(ra: Column | str, dec: Column | str, radius_deg: Column, height: float) -> Column:
    """Array of the cells a circle can touch; NULL for a circle that is NULL or
    not finite in any part."""
    ra, dec = col(ra), col(dec)
    reach = radius_deg + 1e-9
    polar = F.abs(dec) + reach >= 90.0
    half = F.degrees(F.asin(F.when(polar, 0.0).otherwise(
        F.try_divide(F.sin(F.radians(reach)), F.cos(F.radians(dec)))))) + 1e-9

    def in_zone(zone: Column) -> Column:
        n = _cells_in_zone(zone, height)
        first = F.floor((ra - half) * n / 360.0).cast("bigint")
        last = F.floor((ra + half) * n / 360.0).cast("bigint")
        whole = polar | (last - first + 1 >= n)
        span = F.when(whole, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.sequence(first, last))
        return F.transform(span, lambda c: F.struct(zone.alias("zone"), F.pmod(c, n).alias("cell")))

    zones = F.sequence(_zone(F.greatest(dec - reach, F.lit(-90.0)), height),
                       _zone(F.least(dec + reach, F.lit(90.0)), height))
    known = finite(ra).isNotNull() & finite(dec).isNotNull() & finite(radius_deg).isNotNull()
    return F.when(known, F.flatten(F.transform(zones, in_zone)))


# -- tangent-plane world coordinates -------------------------------------------

class TangentPlane:
    """Gnomonic projection from header cards; every card may be a number or a
    Column, so one instance can serve a table of images. Pixels are 0-based."""

    def __init__(self, crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22):
        cards = (crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22)
        (self.crpix1, self.crpix2, self.crval1, self.crval2,
         self.cd11, self.cd12, self.cd21, self.cd22) = (col(c) for c in cards)

    @classmethod
    def from_header(cls, cards: dict) -> TangentPlane:
        if "CD1_1" in cards:
            cd = [float(cards.get(k, 0.0)) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
        else:
            d1, d2 = float(cards.get("CDELT1", 1.0)), float(cards.get("CDELT2", 1.0))
            pc = [float(cards.get(k, dflt)) for k, dflt in
                  (("PC1_1", 1.0), ("PC1_2", 0.0), ("PC2_1", 0.0), ("PC2_2", 1.0))]
            cd = [d1 * pc[0], d1 * pc[1], d2 * pc[2], d2 * pc[3]]
        ref = [float(cards.get(k, 0.0)) for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2")]
        return cls(*ref, *cd)

    def world(self, x, y) -> tuple[Column, Column]:
        dx, dy = col(x) + 1.0 - self.crpix1, col(y) + 1.0 - self.crpix2
        xi = F.radians(self.cd11 * dx + self.cd12 * dy)
        eta = F.radians(self.cd21 * dx + self.cd22 * dy)
        d0 = F.radians(self.crval2)
        denom = F.cos(d0) - eta * F.sin(d0)
        ra = wrap360(self.crval1 + F.degrees(F.atan2(xi, denom)))
        dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + denom * denom)))
        return ra, dec

    def pixel(self, ra, dec) -> tuple[Column, Column]:
        """NULL for points on the far hemisphere."""
        d, d0 = F.radians(col(dec)), F.radians(self.crval2)
        da = F.radians(col(ra) - self.crval1)
        cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
        seen = F.when(cosc > 0.0, cosc)
        xi = F.degrees(F.cos(d) * F.sin(da) / seen)
        eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / seen)
        det = self.cd11 * self.cd22 - self.cd12 * self.cd21
        x = F.try_divide(self.cd22 * xi - self.cd12 * eta, det) + self.crpix1 - 1.0
        y = F.try_divide(self.cd11 * eta - self.cd21 * xi, det) + self.crpix2 - 1.0
        return x, y

    def axis_scales_arcsec(self) -> tuple[Column, Column]:
        s1 = F.sqrt(self.cd11 * self.cd11 + self.cd21 * self.cd21)
        s2 = F.sqrt(self.cd12 * self.cd12 + self.cd22 * self.cd22)
        return s1 * ARCSEC, s2 * ARCSEC

    def pixel_scale_arcsec(self) -> Column:
        s1, s2 = self.axis_scales_arcsec()
        return (s1 + s2) / 2.0

    def center(self, width, height) -> tuple[Column, Column]:
        return self.world(0.5 * (col(width) - 1.0), 0.5 * (col(height) - 1.0))

    def corners(self, width, height) -> list[tuple[Column, Column]]:
        w, h = col(width) - 1.0, col(height) - 1.0
        zero = F.lit(0.0)
        return [self.world(zero, zero), self.world(zero, h), self.world(w, h), self.world(w, zero)]
