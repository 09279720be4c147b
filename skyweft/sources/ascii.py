"""Indexed text catalogs: '# <index> NAME' header lines, whitespace-split body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import finite
from ..functions.text import HEADER_LINE, source_id
from ..plans.lineage import cut_lineage
from ..plans.skew import fits_broadcast

# Catalog column -> engine column.
BOUND_COLUMNS = {
    "MAG_AUTO": "mag_auto", "MAG_APAUTO": "mag_apauto", "FWHM_WORLD": "fwhm_world", "PREDIQ": "prediq",
    "A_WORLD": "a_world", "B_WORLD": "b_world", "KRON_RADIUS": "kron_radius", "FLAGS": "flags",
    "MAG_COG": "mag_cog", "MAG_2ARC": "mag_2arc", "PREDMAGLIM": "predmaglim", "MAGERR_COG": "magerr_cog",
    "MAGERR_2ARC": "magerr_2arc", "MAGERR_AUTO": "magerr_auto",
}
POSITION_COLUMNS = {"ra": ("ALPHA_J2000", "RA"), "dec_": ("DELTA_J2000", "DEC")}


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): seq keeps file order; blank lines stay. Text splits
    carry increasing partition ids, so the id is monotone within a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    return located_lines(spark, path).drop("file")


def header_lines(lines: DataFrame, leading_only: bool = False) -> DataFrame:
    """All header lines of each file, wherever they stand; with ``leading_only``
    those before the file's first other line."""
    heads = lines.where(F.col("line").startswith("#"))
    if not leading_only:
        return heads
    body = lines.where(~F.col("line").startswith("#")).groupBy("file").agg(F.min("seq").alias("_body"))
    return heads.join(body, "file", "left").where(F.col("_body").isNull() | (F.col("seq") < F.col("_body"))).drop("_body")


def column_maps(headers: DataFrame) -> DataFrame:
    """(file, columns): NAME -> 0-based position; a repeated name keeps its last."""
    parsed = headers.where(F.col("line").rlike(HEADER_LINE)).select(
        "file", "seq", F.regexp_extract("line", HEADER_LINE, 2).alias("name"),
        (F.regexp_extract("line", HEADER_LINE, 1).cast("int") - 1).alias("at"))
    last = parsed.groupBy("file", "name").agg(F.max_by("at", "seq").alias("at"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "at"))).alias("columns"))


def _first_position(columns: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(columns, F.lit(n)) for n in names])


def _require(lines: DataFrame, maps: DataFrame, present: Column, message: str) -> None:
    """Every file of the path must have the columns: one small job over the maps."""
    files = lines.select("file").distinct().join(maps, "file", "left")
    bad = files.where(~F.coalesce(present, F.lit(False))).select(F.min("file")).first()[0]
    if bad is not None:
        raise ValueError(f"{message}: {bad}")


def _body(lines: DataFrame, maps: DataFrame, blanks: bool) -> DataFrame:
    """Body lines with their tokens and their own file's column map."""
    body = lines.where(~F.col("line").startswith("#"))
    if not blanks:
        body = body.where(F.trim("line") != "")
    # Catalyst takes a map for as large as the lines it was made from; once written
    # its size is known, and body lines are not shuffled by file.
    maps = cut_lineage(maps, "column-maps")
    maps = F.broadcast(maps) if fits_broadcast(maps) else maps
    return body.join(maps, "file").withColumn("_t", tokens())


def tokens(line: str = "line") -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def token_at(columns: Column, *names: str) -> Column:
    """Token of the first of the names that the row's file has."""
    at = _first_position(columns, names)
    return F.when(at >= 0, F.get("_t", at))


def number_at(columns: Column, *names: str) -> Column:
    return finite(token_at(columns, *names).try_cast("double"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line, ra, dec_, bound columns): one row per body line, NULL for
    missing, malformed or non-finite tokens. Each file of a folder is read by its
    own header."""
    lines = located_lines(spark, path)
    maps = column_maps(header_lines(lines))
    c = F.col("columns")
    placed = _first_position(c, POSITION_COLUMNS["ra"]).isNotNull() & _first_position(c, POSITION_COLUMNS["dec_"]).isNotNull()
    _require(lines, maps, placed, "catalog has no ALPHA_J2000/DELTA_J2000 (or RA/DEC) columns")
    wanted = {**POSITION_COLUMNS, **{v: (k,) for k, v in BOUND_COLUMNS.items()}}
    return _body(lines, maps, blanks=True).select("seq", "line", *[number_at(c, *names).alias(n) for n, names in wanted.items()])


def read_wide_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All columns of all files, blank lines dropped: a column is double when
    every non-missing token parses as a number, else string. Adds source_id from
    NUMBER. The names are header fields, listed on the driver in order of place."""
    lines = located_lines(spark, path)
    maps = column_maps(header_lines(lines))
    c = F.col("columns")
    listed = maps.select(F.explode("columns").alias("name", "at")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    if not listed:
        raise ValueError("catalog has no indexed header")
    _require(lines, maps, _first_position(c, ("NUMBER",)).isNotNull(), "catalog has no NUMBER column")
    names = [r["name"] for r in listed]
    raw = _body(lines, maps, blanks=False).select("seq", *[token_at(c, n).alias(n) for n in names])
    missing = r"(?i)^[+-]?nan$"

    def text_seen(n: str) -> Column:
        t = F.col(n)
        return F.count_if(t.isNotNull() & ~t.rlike(missing) & t.try_cast("double").isNull())

    is_text = raw.agg(*[text_seen(n).alias(n) for n in names]).first()

    def typed(n: str) -> Column:
        value = F.when(~F.col(n).rlike(missing), F.col(n))
        return (value if is_text[n] else finite(value.try_cast("double"))).alias(n)

    return raw.select("seq", *[typed(n) for n in names], source_id("NUMBER").alias("source_id"))


def read_cutout_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(seq, source_id, x_image, y_image, kron_radius, a_world, snr_sb_cog); the
    columns NUMBER, X_IMAGE and Y_IMAGE are required in every file."""
    lines = located_lines(spark, path)
    maps = column_maps(header_lines(lines))
    c = F.col("columns")
    needed = [_first_position(c, (n,)).isNotNull() for n in ("NUMBER", "X_IMAGE", "Y_IMAGE")]
    _require(lines, maps, needed[0] & needed[1] & needed[2], "catalog must include NUMBER, X_IMAGE and Y_IMAGE")
    parts = _body(lines, maps, blanks=False).where(F.size("_t") > _first_position(c, ("NUMBER",)))
    out = parts.select(
        "seq", source_id(token_at(c, "NUMBER")).alias("source_id"),
        *[number_at(c, n).alias(n.lower()) for n in ("X_IMAGE", "Y_IMAGE", "KRON_RADIUS", "A_WORLD", "SNR_SB_COG")],
    )
    rated = maps.where(_first_position(c, ("SNR_SB_COG",)).isNotNull())
    return out.drop("snr_sb_cog") if rated.isEmpty() else out


def read_region_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Columns needed for region export; a file's header ends at its first other line."""
    lines = located_lines(spark, path)
    maps = column_maps(header_lines(lines, leading_only=True))
    c = F.col("columns")
    for name in ("ALPHA_J2000", "DELTA_J2000"):
        _require(lines, maps, _first_position(c, (name,)).isNotNull(), f"catalog lacks column {name}")
    names = {"ALPHA_J2000": "ra", "DELTA_J2000": "dec_", "A_WORLD": "a_world", "B_WORLD": "b_world",
             "THETA_J2000": "theta_j2000", "KRON_RADIUS": "kron_radius", "FWHM_WORLD": "fwhm_world"}
    return _body(lines, maps, blanks=False).select("seq", *[number_at(c, k).alias(v) for k, v in names.items()])
