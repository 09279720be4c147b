"""Cutouts: stamps of pixels around sources, reprojection, per-stamp metrics."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KronCutout, SourceCutout
from ..functions import photometry as ph
from ..functions.sky import TangentPlane, finite
from ..functions.text import metric_name
from ..plans.halo import block_of
from ..plans.lineage import cut_lineage
from ..plans.ranking import with_row_number
from ..plans.skew import rows_fit_broadcast, salted_join

#: Side of the pixel blocks of cutouts, and the largest side of a window's pieces.
BLOCK = 32
BLOCK_KEYS = ["_by", "_bx"]


def plan_kron_cutouts(sources: DataFrame, pixel_scale: float | None, cfg: KronCutout = KronCutout(),
                      order: str = "source_number") -> DataFrame:
    """Window per source from its Kron radius: half_size, 0-based centre, side.

    The pixel-radius test comes before the source limit, and the size follows
    the unit-less Kron radius.
    """
    scale = F.lit(pixel_scale) if pixel_scale else F.lit(None).cast("double")
    out = sources.withColumn("kron_pix", ph.kron_pixels("kron_radius", "a_world", scale))
    if cfg.min_kron_pix is not None:
        out = out.where(F.col("kron_pix") > cfg.min_kron_pix)
    if cfg.max_sources is not None:
        out = out.orderBy(order).limit(cfg.max_sources)
    half = ph.kron_half_size("kron_radius", cfg)
    return out.withColumns({
        "half_size": half, "side": 2 * half + 1,
        "cx": F.col("x_image") - 1.0, "cy": F.col("y_image") - 1.0,
    })


def plan_source_cutouts(sources: DataFrame, cfg: SourceCutout = SourceCutout()) -> DataFrame:
    half = ph.source_half_size("kron", "sma", cfg)
    return sources.withColumns({"cutout_half_pix": half, "cutout_size_pix": ph.stamp_pixels(half)})


def window_origin(center: Column, side: Column) -> Column:
    """First pixel of a window of ``side`` pixels around a centre."""
    return F.ceil(center - side / F.lit(2.0)).cast("int")


def with_windows(sources: DataFrame, cx: str = "cx", cy: str = "cy", side: str = "side") -> DataFrame:
    x0, y0 = window_origin(F.col(cx), F.col(side)), window_origin(F.col(cy), F.col(side))
    return sources.withColumns({"wx0": x0, "wx1": x0 + F.col(side), "wy0": y0, "wy1": y0 + F.col(side)})


def _valid(windows: DataFrame) -> DataFrame:
    return windows.where((F.col("wx1") > F.col("wx0")) & (F.col("wy1") > F.col("wy0")))


def _pieces(windows: DataFrame, key: str) -> DataFrame:
    """Windows cut into pieces of at most ``BLOCK`` pixels a side, each with the
    block of its first pixel."""
    def cuts(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.col(lo), F.col(hi) - 1, F.lit(BLOCK)))

    rows = _valid(windows).select(key, "wx0", "wx1", "wy1", cuts("wy0", "wy1").alias("_y0"))
    cut = rows.select(key, "wx1", "wy1", "_y0", cuts("wx0", "wx1").alias("_x0"))
    return cut.select(key, "_y0", F.least(F.col("_y0") + BLOCK, "wy1").alias("_y1"), "_x0", F.least(F.col("_x0") + BLOCK, "wx1").alias("_x1"),
                      block_of("_y0", BLOCK).alias("_by"), block_of("_x0", BLOCK).alias("_bx"))


def _pixel_blocks(cells: DataFrame, side: int, value: str) -> DataFrame:
    """One row per block: x and value of its pixels by (y, x), and for every
    position of the block and its halo how many pixels stand before it. Absent,
    repeated and NULL pixels stay what they are."""
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def pack(table: pa.Table) -> pa.Table:
        by, bx = table["_by"][0].as_py(), table["_bx"][0].as_py()
        place = (table["y"].to_numpy() - by * BLOCK) * side + table["x"].to_numpy() - bx * BLOCK
        order = np.argsort(place, kind="stable")
        at = np.searchsorted(place[order], np.arange(side * side + 1))

        def one_list(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = {"_at": pa.array(at, pa.int32()), "_x": table["x"].combine_chunks().take(pa.array(order)),
                   "_v": table[value].combine_chunks().take(pa.array(order))}
        return pa.table({"_by": pa.array([by], pa.int32()), "_bx": pa.array([bx], pa.int32()), **{c: one_list(v) for c, v in columns.items()}})

    return cells.select("_by", "_bx", "y", "x", value).groupBy("_by", "_bx").applyInArrow(
        pack, f"_by int, _bx int, _at array<int>, _x array<{types['x']}>, _v array<{types[value]}>")


def _on_blocks(pixels: DataFrame, windows: DataFrame, key: str, value: str, how: str) -> tuple[DataFrame, int]:
    """Every piece of a window beside the one block that holds all its pixels, and
    the side of the blocks with their halo. Pixels are shuffled once, as many
    times as blocks need them, and windows once; pixels of windows are never.
    The blocks are written, so that the join knows their size; many pieces on
    one block are spread over salts. If there are few pieces, only blocks that
    they ask for are made."""
    extent = F.least(F.greatest(F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")), F.lit(BLOCK))
    many = F.ceil((F.col("wx1") - F.col("wx0")) / BLOCK) * F.ceil((F.col("wy1") - F.col("wy0")) / BLOCK)
    reach, n = _valid(windows).agg(F.max(extent), F.sum(many)).first()
    halo = (reach or 1) - 1
    pieces = _pieces(windows, key)

    def touched(c: str) -> Column:
        return F.explode(F.sequence(block_of(F.col(c) - halo, BLOCK), block_of(c, BLOCK)))

    cells = pixels.select("y", "x", value).withColumn("_by", touched("y")).withColumn("_bx", touched("x"))
    if rows_fit_broadcast(pixels.sparkSession, n or 0):
        cells = cells.join(F.broadcast(pieces.select(*BLOCK_KEYS).distinct()), BLOCK_KEYS, "left_semi")
    blocks = cut_lineage(_pixel_blocks(cells, BLOCK + halo, value), "pixel-blocks")
    return salted_join(pieces, blocks, BLOCK_KEYS, how, spread_by=(key,)), BLOCK + halo


def _place(y: Column, x: Column | str, side: int) -> Column:
    """Position in a block with its halo, counted by rows."""
    return (y - F.col("_by") * BLOCK) * side + (F.col(x) if isinstance(x, str) else x) - F.col("_bx") * BLOCK


def _held(first: Column, end: Column, entry: Callable[[Column], Column]) -> Column:
    """Entries first..end - 1 of a block. (``slice`` would copy the whole block.)"""
    found = F.transform(F.sequence(first, end - 1), entry)
    return F.when(end > first, found).otherwise(F.filter(F.array(entry(F.lit(0))), lambda _: F.lit(False)))


def window_pixels(pixels: DataFrame, windows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, _pixels) for each piece of a window that holds pixels: an array of
    (y, x, value) by rows."""
    joined, side = _on_blocks(pixels, windows, key, value, "inner")

    def row(y: Column) -> Column:
        first, end = F.get("_at", _place(y, "_x0", side)), F.get("_at", _place(y, "_x1", side))
        return _held(first, end, lambda i: F.struct(y.alias("y"), F.get("_x", i).alias("x"), F.get("_v", i).alias(value)))

    held = F.flatten(F.transform(F.sequence(F.col("_y0"), F.col("_y1") - 1), row))
    return joined.select(key, held.alias("_pixels")).where(F.size("_pixels") > 0)


def cutout_pixels(pixels: DataFrame, windows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, y, x, value) of the image pixels inside each window."""
    held = window_pixels(pixels, windows, key, value).select(key, F.explode("_pixels").alias("_p"))
    return held.select(key, "_p.y", "_p.x", F.col("_p")[value].alias(value))


def _by_key(windows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Windows that have their key alone, and those that share it (None: none do)."""
    windows = _valid(windows)
    bounds = [F.min(c).alias(c) for c in ("wx0", "wx1", "wy0", "wy1")]
    listed = cut_lineage(windows.groupBy(key).agg(F.count("*").alias("_n"), *bounds), "windows")
    shared = listed.where("_n > 1").select(F.col(key).alias("_key"))
    # A NULL key may be shared as well.
    rest = None if shared.isEmpty() else windows.join(shared, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return listed.where("_n = 1").drop("_n"), rest


def partial_cutouts(pixels: DataFrame, windows: DataFrame, key: str, fill: float = 0.0, value: str = "v") -> DataFrame:
    """Full windows: positions outside the image carry ``fill``. Windows of one
    key are one set of positions, and the largest of repeated pixels counts."""
    def positions(of: DataFrame) -> DataFrame:
        joined, side = _on_blocks(pixels, of, key, value, "left")

        def at(y: Column, x: Column) -> Column:
            first, end = F.get("_at", _place(y, x, side)), F.get("_at", _place(y, x, side) + 1)
            many = F.array_max(_held(first, end, lambda i: F.get("_v", i)))
            held = F.when(end - first == 1, F.get("_v", first)).when(end > first, many)
            return F.struct(y.alias("y"), x.alias("x"), held.alias(value))

        ys, xs = (F.sequence(F.col(f"_{c}0"), F.col(f"_{c}1") - 1) for c in "yx")
        every = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: at(y, x))))
        return joined.select(key, F.explode(every).alias("_p")).select(key, "_p.y", "_p.x", F.col("_p")[value].alias(value))

    alone, shared = _by_key(windows, key)
    out = positions(alone)
    if shared is not None:
        out = out.unionByName(positions(shared).groupBy(key, "y", "x").agg(F.max(value).alias(value)))
    return out.withColumn(value, F.coalesce(value, F.lit(fill)))


def trimmed_summary(pixels: DataFrame, windows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """Actual extent of trimmed cutouts; windows that miss the image are absent
    (the caller counts them as skipped). Only sums of pieces are shuffled."""
    xs, first = F.transform("_pixels", lambda p: p["x"]), F.get("_pixels", F.lit(0))
    known = F.filter("_pixels", lambda p: p[value].isNotNull())
    total = F.when(F.exists("_pixels", lambda p: p[value].isNotNull()), F.aggregate(known, F.lit(0.0), lambda a, p: a + p[value]))
    pieces = window_pixels(pixels, windows, key, value).select(
        key, F.size("_pixels").alias("n"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
        first["y"].alias("y0"), F.element_at("_pixels", -1)["y"].alias("y1"), total.alias("total"))
    return pieces.groupBy(key).agg(
        F.sum("n").alias("n_pixels"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("total").alias("total"))


def window_stamps(pixels: DataFrame, windows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """``stamps`` of ``cutout_pixels``. A window of at most ``BLOCK`` pixels a side
    with a key of its own is a stamp where its block is; only pieces of larger
    windows and windows that share a key are grouped."""
    def stamped(held: DataFrame) -> DataFrame:
        full = held.select(key, F.sort_array("_pixels").alias("_p"))
        first, xs = F.get("_p", F.lit(0))["y"], F.transform("_p", lambda p: p["x"])
        return full.select(key, first.alias("y0"), F.array_min(xs).alias("x0"), (F.element_at("_p", -1)["y"] - first + 1).alias("height"),
                           (F.array_max(xs) - F.array_min(xs) + 1).alias("width"), F.transform("_p", lambda p: p[value]).alias("data"))

    alone, shared = _by_key(windows, key)
    small = F.greatest(F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")) <= BLOCK
    large = alone.where(~small)
    rest = shared if large.isEmpty() else large if shared is None else large.unionByName(shared.select(*large.columns))
    out = stamped(window_pixels(pixels, alone.where(small), key, value))
    if rest is None:
        return out
    together = window_pixels(pixels, rest, key, value).groupBy(key).agg(F.flatten(F.collect_list("_pixels")).alias("_pixels"))
    return out.unionByName(stamped(together))


def stamps(cutouts: DataFrame, key: str, value: str = "v") -> DataFrame:
    """One row per source: height, width and the row-major pixel array. A stamp
    is bounded by the largest configured window."""
    packed = cutouts.groupBy(key).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"),
        (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
        F.sort_array(F.collect_list(F.struct("y", "x", value))).alias("_p"))
    return packed.withColumn("data", F.transform("_p", lambda p: p[value])).drop("_p")


#: Side of the source blocks of a reprojection.
REPROJECT_BLOCK = 64


def reproject(source: DataFrame, source_wcs: TangentPlane, reference: DataFrame, reference_wcs: TangentPlane,
              value: str = "v", block: int = REPROJECT_BLOCK) -> DataFrame:
    """Bilinear resampling on the reference grid (y, x); NULL where the source
    does not reach. The source travels as dense blocks that hold one more row and
    column than they own, so a reference pixel finds all four neighbours in one
    block and is shuffled once."""
    side = block + 1
    ra, dec = reference_wcs.world("x", "y")
    sx, sy = source_wcs.pixel("_ra", "_dec")
    spots = reference.select("y", "x", ra.alias("_ra"), dec.alias("_dec")).withColumns({"_sx": sx, "_sy": sy})
    spots = spots.withColumns({"_iy": F.floor("_sy").cast("int"), "_ix": F.floor("_sx").cast("int")})
    spots = spots.withColumns({"_by": block_of("_iy", block), "_bx": block_of("_ix", block)})

    # The first row and column of a block also end the blocks before it.
    def touched(c: str) -> Column:
        return F.array_distinct(F.array(block_of(F.col(c) - 1, block), block_of(c, block)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = int(pdf["_by"].iat[0]), int(pdf["_bx"].iat[0])
        data = np.full(side * side, np.nan)
        data[(pdf["y"] - by * block) * side + pdf["x"] - bx * block] = pdf["_v"].to_numpy(float, na_value=np.nan)
        return pd.DataFrame({"_by": [by], "_bx": [bx], "_data": [data]})

    cells = source.select("y", "x", finite(value).alias("_v")).where("_v is not null")
    cells = cells.withColumn("_by", F.explode(touched("y"))).withColumn("_bx", F.explode(touched("x")))
    blocks = cells.groupBy("_by", "_bx").applyInPandas(pack, "_by int, _bx int, _data array<double>")
    fx, fy = F.col("_sx") - F.col("_ix"), F.col("_sy") - F.col("_iy")
    at = (F.col("_iy") - F.col("_by") * block) * side + F.col("_ix") - F.col("_bx") * block

    def part(weight: Column, step: int) -> Column:
        v = F.get("_data", at + step)
        return F.when(weight > 0.0, weight * F.when(~F.isnan(v), v)).otherwise(0.0)

    total = part((1.0 - fy) * (1.0 - fx), 0) + part((1.0 - fy) * fx, 1) + part(fy * (1.0 - fx), side) + part(fy * fx, side + 1)
    # A spot without a place has no block either.
    return spots.join(blocks, ["_by", "_bx"], "left").select("y", "x", F.when(F.col("_data").isNotNull(), total).alias(value))


def catalog_rows(
    sources: DataFrame, cfg: SourceCutout, pixscale_arcsec: float | None = None, wcs: TangentPlane | None = None
) -> DataFrame:
    """Catalog columns of the extraction: position on the sky, kron_radius =
    kron * sma, pixel scale, cutout sizes and whether a shape is missing.
    Non-finite measurements are NULL; without ``wcs`` there is no position."""
    clean = sources.withColumns({c: finite(c) for c in ("x", "y", "sma", "smi", "kron")})
    ra, dec = wcs.world("x", "y") if wcs is not None else (F.lit(None).cast("double"),) * 2
    scale = wcs.pixel_scale_arcsec() if pixscale_arcsec is None and wcs is not None else F.lit(pixscale_arcsec).cast("double")
    shaped = F.col("sma").isNotNull() & F.col("smi").isNotNull() & F.col("kron").isNotNull()
    return plan_source_cutouts(clean, cfg).withColumns({
        "ra": ra, "dec_": dec, "kron_radius": F.col("kron") * F.col("sma"), "pixscale_arcsec": scale, "shape_missing": ~shaped})


def numbered(catalog: DataFrame, order: Sequence[str] = ("y", "x")) -> DataFrame:
    """id = 1..n over a total order, first column."""
    out = with_row_number(catalog.drop("id"), "id", list(order))
    return out.select("id", *[c for c in out.columns if c != "id"])


# -- per-stamp metrics -------------------------------------------------------------

class MetricTimeout(Exception):
    pass


@contextmanager
def _time_limit(seconds: float):
    usable = seconds > 0 and threading.current_thread() is threading.main_thread()
    if not usable:
        yield
        return

    def expire(signum, frame):
        raise MetricTimeout

    previous = signal.signal(signal.SIGALRM, expire)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, previous)


def scalar_metrics(found: dict) -> dict[str, float]:
    """Public scalar entries as floats, with their name prefix removed."""
    kinds = (bool, int, float, np.number, np.bool_)
    return {metric_name(k): float(v) for k, v in found.items()
            if not k.startswith("_") and isinstance(v, kinds)}


def measure_stamps(stamped: DataFrame, key: str, measure: Callable[[np.ndarray], dict],
                   timeout_s: float = 0.0) -> DataFrame:
    """Run ``measure(stamp)`` for every stamp: (key, ok, timeout, error, metrics).

    A failure or an exceeded time limit marks its row and never fails the job.
    """
    key_type = stamped.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h, w, data in zip(pdf[key], pdf["height"], pdf["width"], pdf["data"]):
                row = {key: k, "ok": 1.0, "timeout": 0.0, "error": "", "metrics": {}}
                try:
                    with _time_limit(timeout_s):
                        row["metrics"] = scalar_metrics(measure(np.asarray(data, dtype=float).reshape(h, w)))
                except MetricTimeout:
                    row.update(ok=0.0, timeout=1.0, error=f"timeout_after_{timeout_s:.2f}s")
                except Exception as exc:  # the contract: a bad stamp is a row, not a crash
                    row.update(ok=0.0, error=f"measure_failed: {exc}")
                rows.append(row)
            yield pd.DataFrame(rows, columns=[key, "ok", "timeout", "error", "metrics"])

    schema = f"{key} {key_type}, ok double, timeout double, error string, metrics map<string,double>"
    return stamped.select(key, "height", "width", "data").mapInPandas(run, schema)


def spread_metrics(measured: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Map entries as columns; without ``names`` the union of all keys is used
    (a distinct over metric names, bounded by the extractor)."""
    if names is None:
        found = measured.select(F.explode(F.map_keys("metrics")).alias("k")).distinct()
        names = sorted(r["k"] for r in found.collect())
    return measured.select(*[c for c in measured.columns if c != "metrics"],
                           *[F.col("metrics")[n].alias(n) for n in names])


def attach_catalog(metrics: DataFrame, catalog: DataFrame, key: str = "source_id", suffix: str = "_cat") -> DataFrame:
    """Left join of metrics and catalog rows; colliding catalog columns get a suffix."""
    clash = {c: c + suffix for c in catalog.columns if c in metrics.columns and c != key}
    return salted_join(metrics, catalog.withColumnsRenamed(clash), [key], "left")


def keep_listed(cutouts: DataFrame, catalog: DataFrame, key: str = "source_id") -> DataFrame:
    return salted_join(cutouts, catalog.select(key).distinct(), [key], "left_semi")


def array_nanmax(values: Column | str) -> Column:
    return F.array_max(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
