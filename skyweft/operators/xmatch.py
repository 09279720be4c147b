"""Sky range joins rewritten as equi-joins on equal-height cells.

A raw angular-distance join plans as a nested loop. Here every point gets one
cell, every circle the few cells it touches, and the haversine test runs only
inside a cell. Cells are a small multiple of the largest radius, so the pairs
tested per cell are bounded by the local density; cells that still hold very
many rows are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FootprintCone, StarRadius
from ..functions import sky
from ..plans.lineage import cut_lineage
from ..plans.skew import HOT_ROWS, salted_join

CELL = ["_zone", "_cell"]
MAX_CELLS_PER_CIRCLE = 6  # two zones, three RA cells, when height >= 2 radii
MIN_CELL_DEG = 60.0 / 3600.0


def cell_height(max_radius_deg: float) -> float:
    return max(2.0 * max_radius_deg, MIN_CELL_DEG)


def with_point_cell(df: DataFrame, height: float, ra: str = "ra", dec: str = "dec_") -> DataFrame:
    c = sky.point_cell(ra, dec, height)
    return df.withColumns({"_zone": c["zone"], "_cell": c["cell"]})


def explode_circle_cells(
    df: DataFrame, height: float, radius_deg: Column, ra: str = "ra", dec: str = "dec_"
) -> DataFrame:
    return (
        df.withColumn("_c", F.explode(sky.circle_cells(ra, dec, radius_deg, height)))
        .withColumns({"_zone": F.col("_c.zone"), "_cell": F.col("_c.cell")})
        .drop("_c")
    )


def _star_circles(stars: DataFrame, cfg: StarRadius, ra: str, dec: str, mag: str) -> DataFrame:
    """One circle per distinct position: copies of a star collapse to the widest."""
    radius = sky.star_radius_arcsec(F.col(mag), cfg)
    return (
        stars.select(F.col(ra).alias("_ra"), F.col(dec).alias("_dec"), radius.alias("_radius"))
        .groupBy("_ra", "_dec")
        .agg(F.max("_radius").alias("_radius"))
    )


def exclude_near_stars(
    catalog: DataFrame,
    stars: DataFrame,
    cfg: StarRadius = StarRadius(),
    ra: str = "ra",
    dec: str = "dec_",
    mag: str = "phot_g_mean_mag",
    hot_rows: int = HOT_ROWS,
    row_key: tuple[str, ...] = (),
) -> DataFrame:
    """Anti-join: drop catalog rows within the magnitude-dependent radius of any
    star. Rows without coordinates stay. ``row_key`` names the catalog's unique
    columns, used only to spread very dense cells."""
    height = cell_height(cfg.max_radius / sky.ARCSEC)
    circles = explode_circle_cells(
        _star_circles(stars, cfg, ra, dec, mag), height, F.col("_radius") / sky.ARCSEC, "_ra", "_dec"
    )
    near = sky.separation_arcsec(F.col(ra), F.col(dec), F.col("_ra"), F.col("_dec")) <= F.col("_radius")
    return salted_join(
        with_point_cell(catalog, height, ra, dec), circles, CELL, "left_anti", near,
        hot_rows=hot_rows, growth=MAX_CELLS_PER_CIRCLE, spread_by=row_key,
    ).drop(*CELL)


def stars_with_match(
    catalog: DataFrame,
    stars: DataFrame,
    key: str = "source_id",
    cfg: StarRadius = StarRadius(),
    ra: str = "ra",
    dec: str = "dec_",
    mag: str = "phot_g_mean_mag",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Semi-join the other way round: stars that excluded at least one row, with
    the radius used."""
    height = cell_height(cfg.max_radius / sky.ARCSEC)
    with_radius = stars.withColumn("radius_arcsec", sky.star_radius_arcsec(F.col(mag), cfg))
    circles = explode_circle_cells(with_radius, height, F.col("radius_arcsec") / sky.ARCSEC, ra, dec)
    positions = catalog.select(F.col(ra).alias("_ra"), F.col(dec).alias("_dec")).distinct()
    points = with_point_cell(positions, height, "_ra", "_dec")
    near = sky.separation_arcsec(F.col(ra), F.col(dec), F.col("_ra"), F.col("_dec")) <= F.col("radius_arcsec")
    hits = salted_join(circles, points, CELL, "left_semi", near, hot_side="right", hot_rows=hot_rows,
                       growth=MAX_CELLS_PER_CIRCLE)
    return hits.drop(*CELL).dropDuplicates([key])


def radius_range(stars: DataFrame, cfg: StarRadius = StarRadius(), mag: str = "phot_g_mean_mag") -> DataFrame:
    r = sky.star_radius_arcsec(F.col(mag), cfg)
    return stars.agg(F.min(r).alias("radius_min"), F.max(r).alias("radius_max"))


def footprint_center(df: DataFrame, ra: str = "ra", dec: str = "dec_") -> DataFrame:
    """One row: direction of the mean unit vector of all rows with finite coordinates."""
    x, y, z = sky.unit_vector("_ra", "_dec")
    both = F.col("_ra").isNotNull() & F.col("_dec").isNotNull()
    mean = df.select(sky.finite(ra).alias("_ra"), sky.finite(dec).alias("_dec")).where(both).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    return mean.select(
        sky.wrap360(F.degrees(F.atan2("y", "x"))).alias("center_ra"),
        F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("center_dec"),
    )


def footprint_cone(
    df: DataFrame, cfg: FootprintCone = FootprintCone(), ra: str = "ra", dec: str = "dec_", guard: bool = True
) -> DataFrame:
    """One row (center_ra, center_dec, radius_deg): the cone around all rows.

    Two aggregates; the centre goes through the driver as one row of literals,
    which keeps the second pass a plain scan. With ``guard`` a cone wider than
    the limit raises.
    """
    center = footprint_center(df, ra, dec).first()
    if center is None or center["center_ra"] is None:
        raise ValueError("catalog has no valid sky coordinates")
    ra0, dec0 = F.lit(center["center_ra"]), F.lit(center["center_dec"])
    sep = F.degrees(sky.separation_rad(sky.finite(ra), sky.finite(dec), ra0, dec0))
    out = df.agg((F.max(sep) + cfg.padding_deg).alias("radius_deg")).select(
        ra0.alias("center_ra"), dec0.alias("center_dec"), "radius_deg"
    )
    if guard:
        radius = out.first()["radius_deg"]
        if radius > cfg.max_radius_deg:
            raise ValueError(f"query radius {radius:.4f} deg exceeds the limit {cfg.max_radius_deg:.4f} deg")
    return out


def in_cone(
    df: DataFrame, ra0: float, dec0: float, radius_deg: float, ra: str = "ra", dec: str = "dec_"
) -> DataFrame:
    """Cone search; the Dec band is a plain range, so it reaches the scan."""
    band = F.col(dec).between(dec0 - radius_deg, dec0 + radius_deg)
    return df.where(band & (F.degrees(sky.separation_rad(F.col(ra), F.col(dec), F.lit(ra0), F.lit(dec0))) <= radius_deg))


def point_like_stars(
    stars: DataFrame, min_star: float = 0.8, mag_limit: float | None = None, mag: str = "phot_g_mean_mag"
) -> DataFrame:
    """Rows whose class probabilities say star; a missing probability fails."""
    out = stars.where(
        (F.col("p_star") >= min_star)
        & (F.col("p_star") > F.col("p_galaxy"))
        & (F.col("p_star") > F.col("p_quasar"))
    )
    return out if mag_limit is None else out.where(F.col(mag) <= mag_limit)


def sanitize_stars(
    df: DataFrame, ra: str = "ra", dec: str = "dec", mag: str = "phot_g_mean_mag", mag_limit: float | None = None
) -> DataFrame:
    """Numeric (ra, dec, phot_g_mean_mag) with finite positions; the magnitude
    cut applies only when the column exists, and a missing magnitude fails it."""
    names = {c.lower(): c for c in df.columns}
    missing = [c for c in (ra, dec) if c.lower() not in names]
    if missing:
        raise ValueError(f"star table lacks column(s): {missing}")

    def number(c: str) -> Column:
        return sky.finite(F.col(names[c.lower()]).try_cast("double"))

    has_mag = mag.lower() in names
    out = df.select(
        number(ra).alias("ra"),
        number(dec).alias("dec_"),
        (number(mag) if has_mag else F.lit(None).cast("double")).alias("phot_g_mean_mag"),
    ).where(F.col("ra").isNotNull() & F.col("dec_").isNotNull())
    return out.where(F.col("phot_g_mean_mag") <= mag_limit) if mag_limit is not None and has_mag else out


def join_parameters(sources: DataFrame, parameters: DataFrame, key: str = "source_id") -> DataFrame:
    """Inner join: sources without a parameter row drop out."""
    return salted_join(sources, parameters, [key], "inner")


def _fine_height(radius_deg: float, cells: int) -> float:
    """Height of cells of which ``cells`` fit a radius: far smaller than a footprint,
    so that most points of a touched cell lie inside it."""
    return max(radius_deg / cells, MIN_CELL_DEG)


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    corners: list[tuple[str, str]],
    max_radius_deg: float,
    ra: str = "ra",
    dec: str = "dec_",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of points and convex footprints that contain them.

    ``max_radius_deg`` bounds the distance from a footprint's centre to its
    corners; it sets the cell size.
    """
    height = _fine_height(max_radius_deg, 2)
    circles = sky.with_edge_normals(_polygon_cells(polygons, corners, 0.0, height), len(corners))
    placed = sky.with_point_vector(with_point_cell(points, height, ra, dec), ra, dec)
    # The cheap cap test comes first; AND stops there for most pairs.
    inside = sky.in_bounding_cap() & sky.inside_normals(len(corners))
    hits = salted_join(placed, circles, CELL, "inner", inside, hot_rows=hot_rows, growth=_cells_touched(2))
    return hits.drop(*CELL, *sky.POLYGON_COLUMNS, *sky.normal_columns(len(corners)))


def _cells_touched(cells: int) -> int:
    """Cells that a circle touches at most, where ``cells`` fit its radius."""
    return (2 * cells + 2) ** 2


def _polygon_cells(polygons: DataFrame, corners, beyond_deg: float, height: float) -> DataFrame:
    """Footprints with the cells within ``beyond_deg`` of their own circle."""
    shaped = sky.with_polygon_edges(polygons, corners)
    ra0, dec0 = sky.polygon_center()
    placed = shaped.withColumns({"_cra": ra0, "_cdec": dec0})
    return explode_circle_cells(placed, height, F.degrees("_capr") + beyond_deg, "_cra", "_cdec").drop("_cra", "_cdec")


def newest_covering_mosaic(
    targets: DataFrame,
    mosaics: DataFrame,
    corners: list[tuple[str, str]],
    target_radius_deg: str,
    max_target_radius_deg: float,
    max_mosaic_radius_deg: float,
    key: str = "id",
    created: str = "creation_date",
    keep: tuple[str, ...] = ("file_name",),
    ra: str = "ra",
    dec: str = "dec_",
) -> DataFrame:
    """Per target, the newest mosaic whose footprint meets the target's circle;
    targets without any keep NULLs. Of a cell, only mosaics can win that are not
    older than the newest one that holds all of it, so the mosaics tested per
    target do not grow with their number. ``max_by`` combines on the map side."""
    cells = 4
    height = _fine_height(max_target_radius_deg + max_mosaic_radius_deg, cells)
    circles = _polygon_cells(mosaics, corners, max_target_radius_deg, height)
    age = F.struct(created, *keep)
    whole = circles.where(sky.polygon_covers_cell(height)).groupBy(*CELL).agg(F.max(age).alias("_newest"))
    able = salted_join(circles, whole, CELL, "left", growth=_cells_touched(cells))
    circles = cut_lineage(able.where(F.col("_newest").isNull() | (age >= F.col("_newest"))).drop("_newest"), "able-mosaics")
    points = sky.with_point_vector(
        with_point_cell(targets.select(key, ra, dec, target_radius_deg), height, ra, dec), ra, dec)
    close = sky.dot(sky.vector_columns("_c"), sky.vector_columns("_p")) >= F.cos(
        F.col("_capr") + F.radians(target_radius_deg)) - 1e-12
    hits = salted_join(points, circles, CELL, "inner", close & sky.circle_meets_polygon(target_radius_deg), growth=4)
    best = hits.groupBy(key).agg(
        F.max_by(F.struct(*keep, created), F.struct(created, *keep)).alias("_best")
    )
    return targets.join(best, key, "left").select(
        targets["*"], *[F.col(f"_best.{c}").alias(c) for c in (*keep, created)]
    )


def polygon_radius_bound(half_deg: float) -> float:
    """Centre-to-corner bound of a square footprint of the given half side."""
    return half_deg * math.sqrt(2.0) * 1.01
