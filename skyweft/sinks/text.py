"""Text and CSV writers. The line columns are ordinary DataFrames, so they can
be tested and joined before they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as ph
from ..functions.sky import ARCSEC, finite, region_angle, region_angle_half_turn
from ..functions.text import fixed_point

# Region-file headers and the appended catalog columns.
REGION_VERSION = "# Region file format: DS9 version 4.1"
REGION_STYLE = ('global color={color} dashlist=8 3 width=1 font="helvetica 10 normal" '
                "select=1 highlite=1 dash=0 fixed=0 edit=1 move=1 delete=1 include=1 source=1")
DETECTION_STYLE = 'global color=green width=3 select=1 highlite=1 dash=0 font="helvetica 4 normal"'
PEAK_STYLE = "global color=red width=1 select=1 highlite=1 move=1 delete=1 source=1"
CLEAN_COLUMNS = [
    ("AREA_KRON_ARCSEC2", "Kron ellipse area [arcsec**2]"),
    ("MU_2ARC", "SB from MAG_2ARC in 1 arcsec radius aperture [mag/arcsec**2]"),
    ("SNR_SB_2ARC", "SB SNR proxy from MAGERR_2ARC"),
    ("MU_COG_KRON", "SB from MAG_COG and Kron area [mag/arcsec**2]"),
    ("SNR_SB_COG", "SB SNR proxy from MAGERR_COG"),
]
MIN_AXIS_ARCSEC = 0.10


def region_header(color: str, frame: str = "fk5") -> list[str]:
    return [REGION_VERSION, REGION_STYLE.format(color=color), frame]


def _call(shape: str, *parts: Column | str) -> Column:
    args = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(f"{shape}("), F.concat_ws(",", *args), F.lit(")"))


def _arcsec(value: Column) -> Column:
    return F.concat(fixed_point(value, 3), F.lit('"'))


def star_circles(stars: DataFrame, radius: str = "radius_arcsec", digits: int = 8) -> DataFrame:
    return stars.withColumn("line", _call("circle", fixed_point("ra", digits), fixed_point("dec_", digits),
                                          _arcsec(F.col(radius))))


def labelled_star_circles(stars: DataFrame, radius: str = "radius_arcsec", mag: str = "phot_g_mean_mag") -> DataFrame:
    text = F.concat(F.lit(" # text={id="), F.col("source_id").cast("string"), F.lit(" G="), fixed_point(mag, 2), F.lit("}"))
    circle = _call("circle", fixed_point("ra", 10), fixed_point("dec_", 10), _arcsec(F.col(radius)))
    return stars.withColumn("line", F.concat(circle, text))


def ellipse_columns(df: DataFrame) -> DataFrame:
    """Sky ellipses: Kron-scaled axes with a minimum, else a circle from half the
    FWHM; rows with neither, or without a position, have NULL axes."""
    kron = F.coalesce(ph.positive("kron_radius"), F.lit(1.0))

    def axis(c: str) -> Column:
        return F.when(F.col(c) > 0.0, F.greatest(F.col(c) * ARCSEC * kron, F.lit(MIN_AXIS_ARCSEC)))

    a, b = axis("a_world"), axis("b_world")
    both = a.isNotNull() & b.isNotNull()
    fallback = F.when(F.col("fwhm_world") > 0.0, F.greatest(F.col("fwhm_world") * ARCSEC / 2.0, F.lit(MIN_AXIS_ARCSEC)))
    return df.withColumns({
        "a_arcsec": F.when(both, a).otherwise(fallback), "b_arcsec": F.when(both, b).otherwise(fallback),
        "theta": F.coalesce(region_angle("theta_j2000"), F.lit(0.0)),
    })


def catalog_ellipses(df: DataFrame) -> DataFrame:
    """Region lines of a catalog; rows without a usable shape are left out."""
    placed = ellipse_columns(df).where(
        F.col("ra").isNotNull() & F.col("dec_").isNotNull() & F.col("a_arcsec").isNotNull())
    return placed.withColumn("line", _call("ellipse", fixed_point("ra", 8), fixed_point("dec_", 8),
                                           _arcsec(F.col("a_arcsec")), _arcsec(F.col("b_arcsec")), fixed_point("theta", 2)))


def subset_ellipses(df: DataFrame) -> DataFrame:
    """Region lines of a binary-table subset: rows without both axes become points."""
    shaped = ellipse_columns(df.withColumn("fwhm_world", F.lit(None).cast("double")))
    point = F.concat(_call("point", fixed_point("ra", 8), fixed_point("dec_", 8)), F.lit(" # point=circle"))
    ellipse = _call("ellipse", fixed_point("ra", 8), fixed_point("dec_", 8), _arcsec(F.col("a_arcsec")),
                    _arcsec(F.col("b_arcsec")), fixed_point("theta", 2))
    return shaped.withColumn("line", F.when(F.col("a_arcsec").isNull(), point).otherwise(ellipse))


def detection_ellipses(df: DataFrame) -> DataFrame:
    """Image ellipses of detected sources: 1-based centre, equal-area axes."""
    a, b = ph.ellipse_axes("equivalent_radius", "elongation")
    out = df.withColumns({"a_pix": a, "b_pix": b}).where(
        F.col("a_pix").isNotNull() & F.col("b_pix").isNotNull() & finite("xcentroid").isNotNull() & finite("ycentroid").isNotNull())
    body = _call("ellipse", fixed_point(F.col("xcentroid") + 1.0, 6), fixed_point(F.col("ycentroid") + 1.0, 6),
                 fixed_point("a_pix", 6), fixed_point("b_pix", 6), fixed_point("orientation", 6))
    return out.withColumn("line", F.concat(body, F.lit(" # text={"), F.col("label").cast("string"), F.lit("}")))


def axis_ratio_ellipses(df: DataFrame, x="x", y="y", a="a", ratio="ba", angle="pa") -> DataFrame:
    """Image ellipses from a major axis and an axis ratio b/a; the angle turns by
    90 degrees modulo 180. Rows with a missing or non-positive shape are skipped."""
    ok = (F.col(a) > 0.0) & (F.col(ratio) > 0.0) & F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(angle).isNotNull()
    return df.where(ok).withColumn("line", _call(
        "ellipse", fixed_point(x, 6), fixed_point(y, 6), fixed_point(a, 6),
        fixed_point(F.col(a) * F.col(ratio), 6), fixed_point(region_angle_half_turn(angle), 6)))


def peak_points(df: DataFrame) -> DataFrame:
    """Image points of 1-based match positions."""
    body = _call("point", fixed_point("x", 3), fixed_point("y", 3))
    return df.withColumn("line", F.concat(body, F.lit(" # point=x")))


def write_lines(header: Sequence[str], body: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """Text folder whose parts concatenate to one file: the header is the first
    part, the body follows and is range-sorted when ``order`` is given. A repeated
    run replaces the folder."""
    spark = body.sparkSession
    lines = body.orderBy(*order).select("line") if order else body.select("line")
    if header:
        lines = spark.createDataFrame([(h,) for h in header], "line string").coalesce(1).union(lines)
    lines.write.mode("overwrite").text(path)


# -- pass-through catalogs ----------------------------------------------------------------

def clean_header(headers: Sequence[str], next_index: int) -> list[str]:
    extra = [f"# {next_index + i:3d} {name:<16} {text}" for i, (name, text) in enumerate(CLEAN_COLUMNS)]
    return [*headers, *extra]


def clean_lines(df: DataFrame) -> DataFrame:
    """Original line plus the five surface-brightness values."""
    values = [fixed_point(c, 6) for c in
              ("area_kron_arcsec2", "mu_2arc", "snr_sb_2arc", "mu_cog_kron", "snr_sb_cog")]
    return df.select("seq", F.concat_ws(" ", F.regexp_replace("line", r"[\r\n]+$", ""), *values).alias("line"))


# -- CSV ------------------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """CSV folder with a header in every part; ordered when asked."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def union_of_columns(frames: Sequence[DataFrame], preferred: Sequence[str] = (), sort_rest: bool = True) -> DataFrame:
    """Rows of all frames with the union of their columns: preferred names first,
    the rest sorted or in order of first appearance."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    seen = list(dict.fromkeys(c for f in frames for c in f.columns))
    head = [c for c in preferred if c in seen]
    rest = [c for c in seen if c not in head]
    return out.select(*head, *(sorted(rest) if sort_rest else rest))


def key_union(df: DataFrame, column: str) -> DataFrame:
    """Spread a map<string,string> column over the sorted union of its keys. The
    distinct keys are field names and reach the driver as such."""
    keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(column))).distinct().collect())
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].alias(k) for k in keys])


# -- SVG --------------------------------------------------------------------------------------

def svg_rects(boxes: DataFrame, fill: str = "#0ea5e9", opacity: str = "0.65") -> DataFrame:
    two = [fixed_point(c, 2) for c in ("x", "y", "w", "h")]
    line = F.concat(F.lit('<rect x="'), two[0], F.lit('" y="'), two[1], F.lit('" width="'), two[2],
                    F.lit('" height="'), two[3], F.lit(f'" fill="{fill}" fill-opacity="{opacity}" stroke="none"/>'))
    return boxes.withColumn("line", line)


def svg_galaxies(rows: DataFrame, ra: str = "ra", dec: str = "dec_") -> DataFrame:
    """Overlay circles; positions outside the plot are left out."""
    from ..functions.sky import wrap360
    from ..operators import tiles as t

    placed = rows.withColumns({"_px": t.ra_to_svg_x(wrap360(ra)), "_py": t.dec_to_svg_y(F.col(dec))}).where(
        F.col("_px").between(t.MARGIN_LEFT, t.MARGIN_LEFT + t.PLOT_WIDTH)
        & F.col("_py").between(t.MARGIN_TOP, t.MARGIN_TOP + t.PLOT_HEIGHT))
    line = F.concat(F.lit('<circle cx="'), fixed_point("_px", 2), F.lit('" cy="'), fixed_point("_py", 2),
                    F.lit('" r="1.8" fill="#dc2626" fill-opacity="0.85" stroke="none"/>'))
    return placed.withColumn("line", line).drop("_px", "_py")
