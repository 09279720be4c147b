"""Tile work with a halo: each tile sees its neighbours' edge pixels and keeps
only the pixels it owns, so the result does not depend on the tile grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_of(coord: str | Column, size: int) -> Column:
    c = F.col(coord) if isinstance(coord, str) else coord
    return F.floor(c / F.lit(size)).cast("int")


def replicate_to_tiles(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """Add ``_ty``/``_tx``; pixels within ``halo`` of a tile edge are copied to
    the neighbouring tiles."""
    if halo > tile:
        raise ValueError("halo must not exceed the tile size")

    def touched(c: str) -> Column:
        return F.sequence(block_of(F.col(c) - halo, tile), block_of(F.col(c) + halo, tile))

    if halo == 0:
        return pixels.withColumns({"_ty": block_of("y", tile), "_tx": block_of("x", tile)})
    return pixels.withColumn("_ty", F.explode(touched("y"))).withColumn("_tx", F.explode(touched("x")))


def map_tiles(
    pixels: DataFrame,
    func: Callable[[dict[str, np.ndarray], np.ndarray, int, int], dict[str, np.ndarray]],
    outputs: str,
    values: Sequence[str] = ("v",),
    image: Sequence[str] = (),
    tile: int = 256,
    halo: int = 0,
) -> DataFrame:
    """Run ``func(planes, present, y0, x0)`` on the dense form of every tile.

    ``pixels`` must be unique by (image, y, x); a task then holds at most
    (tile + 2 halo)**2 rows. ``planes`` has one float array per value column
    with NaN where no pixel exists; the returned planes have the same shape.
    Result rows: image columns, y, x and ``outputs`` for owned, present pixels.
    """
    image, values = list(image), list(values)
    names = [part.split()[0] for part in outputs.split(",")]
    side = tile + 2 * halo
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in image] + ["y int", "x int", outputs])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0 = int(pdf["_ty"].iat[0]) * tile - halo
        x0 = int(pdf["_tx"].iat[0]) * tile - halo
        iy = pdf["y"].to_numpy() - y0
        ix = pdf["x"].to_numpy() - x0
        present = np.zeros((side, side), dtype=bool)
        present[iy, ix] = True
        planes = {}
        for c in values:
            plane = np.full((side, side), np.nan)
            plane[iy, ix] = pdf[c].to_numpy(dtype=float, na_value=np.nan)
            planes[c] = plane
        result = func(planes, present, y0, x0)
        owned = present.copy()
        if halo:
            owned[:halo], owned[-halo:] = False, False
            owned[:, :halo], owned[:, -halo:] = False, False
        oy, ox = np.nonzero(owned)
        out = {c: pdf[c].iat[0] for c in image}
        out.update(y=(oy + y0).astype("int32"), x=(ox + x0).astype("int32"))
        for n in names:
            out[n] = result[n][oy, ox]
        return pd.DataFrame(out, columns=[*image, "y", "x", *names])

    cells = replicate_to_tiles(pixels.select(*image, "y", "x", *values), tile, halo)
    return cells.groupBy(*image, "_ty", "_tx").applyInPandas(run, schema)


