"""CSV and plain-text tables: stars, targets, tile lists, galaxy lists, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import finite
from ..functions.text import CUTOUT_FILE, filter_and_field, parse_tile, source_id
from ..operators.xmatch import sanitize_stars

MAG_NAMES = ("phot_g_mean_mag", "gmag", "mag")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; types are decided by the reader of each table."""
    return spark.read.option("header", True).csv(path)


def read_stars(spark: SparkSession, path: str, mag_limit: float | None = None) -> DataFrame:
    """(ra, dec_, phot_g_mean_mag) with finite positions; the first magnitude
    column that exists wins."""
    raw = read_csv_text(spark, path)
    present = {c.lower() for c in raw.columns}
    mag = next((m for m in MAG_NAMES if m in present), MAG_NAMES[0])
    return sanitize_stars(raw, "ra", "dec", mag, mag_limit)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(id, ra, dec_, size); column names match in any case."""
    raw = read_csv_text(spark, path)
    names = {c.lower(): c for c in raw.columns}
    missing = sorted({"id", "ra", "dec", "size"} - set(names))
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def number(c: str):
        return finite(F.col(names[c]).try_cast("double"))

    return raw.select(F.col(names["id"]).alias("id"), number("ra").alias("ra"), number("dec").alias("dec_"),
                      number("size").alias("size"))


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (tile_x, tile_y) from lines with a tile file name or xxx.yyy."""
    t = parse_tile("value")
    lines = spark.read.text(path).select(t["tile_x"].alias("tile_x"), t["tile_y"].alias("tile_y"))
    return lines.where(F.col("tile_x").isNotNull()).distinct()


def read_galaxy_list(spark: SparkSession, path: str, header: str = "# PGC_name") -> DataFrame:
    """Whitespace table whose header line starts with ``header``; rows with fewer
    than three tokens drop out, rows shorter than the header keep the first
    three columns (and z_all from the tenth)."""
    text = spark.read.text(path)
    head = text.where(F.col("value").startswith(header)).limit(1).collect()
    names = head[0]["value"].lstrip("#").split() if head else []
    body = (
        text.select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("_l"))
        .where((F.col("_l") != "") & ~F.col("_l").startswith("#"))
        .withColumn("_t", F.split("_l", " ")).where(F.size("_t") >= 3)
    )
    fallback = {"PGC_name": 0, "RA": 1, "DEC": 2, "z_all": 9}
    full = F.size("_t") >= len(names) if names else F.lit(False)
    columns = list(dict.fromkeys([*names, *fallback])) if names else list(fallback)

    def token(name: str):
        named = F.get("_t", names.index(name)) if name in names else F.lit(None)
        plain = F.get("_t", fallback[name]) if name in fallback else F.lit(None)
        return F.when(full, named).otherwise(plain).alias(name)

    return body.select(*[token(c) for c in columns])


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, length) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    local = F.regexp_replace("path", r"^file:/*", "/")  # local paths without a scheme
    return files.select(local.alias("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def list_cutouts(spark: SparkSession, folder: str, tile_id: str | None = None) -> DataFrame:
    """(tile_id, source_id, cutout_path) from file names; names that do not follow
    the pattern are resolved from the file header cards TILEID and SRCID."""
    from .fits import header_cards

    files = list_files(spark, folder, "*.fits")
    named = files.where(F.col("file_name").rlike(CUTOUT_FILE)).select(
        F.regexp_extract("file_name", CUTOUT_FILE, 1).alias("tile_id"),
        source_id(F.regexp_extract("file_name", CUTOUT_FILE, 2)).alias("source_id"), F.col("path").alias("cutout_path"))
    others = files.where(~F.col("file_name").rlike(CUTOUT_FILE)).select("path")
    carded = header_cards(spark, folder, "*.fits").where("hdu = 0").groupBy(
        F.regexp_replace("path", r"^file:/*", "/").alias("path")).agg(
        F.max(F.when(F.col("key") == "TILEID", F.col("value"))).alias("tile_id"),
        F.max(F.when(F.col("key") == "SRCID", F.col("value"))).alias("source_id"))
    resolved = others.join(carded, "path").where((F.col("tile_id") != "") & F.col("source_id").isNotNull()).select(
        "tile_id", source_id("source_id").alias("source_id"), F.col("path").alias("cutout_path"))
    out = named.unionByName(resolved)
    return out if tile_id is None else out.where(F.col("tile_id") == tile_id)


def sibling_lists(files: DataFrame) -> DataFrame:
    """One row per file: (path, siblings), the images of the same folder and field in
    any filter, without repeats, the file itself first and the others by path. A file
    without a filter or field stands alone. Every field's list is made and sorted
    once and joined by folder and field."""
    parts = filter_and_field("file_name")
    keyed = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("_dir"),
                         F.when(parts["filter"].isNotNull(), parts["field"]).alias("_f"))
    fields = keyed.where(F.col("_f").isNotNull()).groupBy("_dir", "_f").agg(F.array_sort(F.collect_set("path")).alias("_members"))
    others = F.filter(F.coalesce("_members", F.array().cast("array<string>")), lambda m: m != F.col("path"))
    return keyed.join(fields, ["_dir", "_f"], "left").select("path", F.concat(F.array("path"), others).alias("siblings"))


def sibling_images(files: DataFrame) -> DataFrame:
    """The lists of ``sibling_lists`` as rows: (path, member, member_rank), rank 0 for
    the file itself and 1 for the others."""
    rows = sibling_lists(files).select("path", F.explode("siblings").alias("member"))
    return rows.withColumn("member_rank", (F.col("member") != F.col("path")).cast("int"))


def expect_count(found: int, expected: int | None) -> None:
    if expected is not None and found != expected:
        raise ValueError(f"expected {expected} inputs, found {found}")
