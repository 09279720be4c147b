"""Splitting of blended segments by a component tree over threshold levels.

Every segment gets ``nlevels`` thresholds between its faintest and its brightest
pixel, in equal ratios (equal steps if it has values that are not positive). What
lies above a threshold falls into components, and the components of all levels form
a tree. One is significant if it has ``npixels`` pixels and at least ``contrast`` of
the segment's flux; the significant ones that hold no other significant one a level
up are the parts' cores. A pixel belongs to the cores inside the innermost
significant component around it, and of several to the one whose brightest pixel is
nearest.

Tiles build the trees of their own pixels. A tree node is known by its level and the
smallest pixel of its component in the tile; pixels that touch across a tile border
join their nodes at every level both reach. Sizes, fluxes, peaks and cores are then
worked out on nodes, and pixels are joined once to the answer, so the result does not
depend on the tile grid. The cores of one component travel as one array; there are at
most its area / ``npixels``.

Defined cases: a null or non-finite value counts as the segment's faintest; a flat
segment, or one with a single core, stays whole; equally near cores: the one with the
smaller peak position; equally bright pixels: the first in raster order; no pixels, no
parts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import finite
from ..plans.halo import block_of
from ..plans.lineage import cut_lineage, drop_table
from ..plans.ranking import with_row_number
from ..plans.skew import salted_join
from .graph import connected_components

Y_SHIFT = 1 << 32
PIXEL, NODE = 0, 1


def level_of(v: Column, low: Column, high: Column, nlevels: int) -> Column:
    """How many of the thresholds between ``low`` and ``high`` a value reaches."""
    ratio = F.ln(v / low) / F.ln(high / low)
    step = (v - low) / (high - low)
    share = F.when(high > low, F.when(low > 0, ratio).otherwise(step)).otherwise(0.0)
    return F.least(F.floor(share * (nlevels + 1)), F.lit(nlevels)).cast("int")


def _components(ids: np.ndarray, alive: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Smallest pixel index of each pixel's component among the pixels ``alive``."""
    both = alive[heads] & alive[tails]
    heads, tails = heads[both], tails[both]
    parent = ids.copy()
    while True:
        a, b = parent[heads], parent[tails]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not ((jumped := parent[parent]) == parent).all():
            parent = jumped


def _tile_tree(y: np.ndarray, x: np.ndarray, v: np.ndarray, label: np.ndarray, level: np.ndarray, connectivity: int, tile: int):
    """Pixel rows (level, local, path on the tile border) and node rows of one tile,
    whose pixels come in raster order."""
    y0, x0 = int(y[0]) // tile * tile, int(x[0]) // tile * tile
    index = np.full((tile + 2, tile + 2), -1)
    index[y - y0 + 1, x - x0 + 1] = np.arange(len(y))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    heads, tails = [], []
    for dy, dx in steps:
        other = index[y - y0 + 1 + dy, x - x0 + 1 + dx]
        at = np.flatnonzero(other >= 0)
        at = at[label[at] == label[other[at]]]
        heads.append(at)
        tails.append(other[at])
    heads, tails = np.concatenate(heads), np.concatenate(tails)
    ids, where = np.arange(len(y)), y.astype(np.int64) * Y_SHIFT + x
    local = np.full((int(level.max()) + 1, len(y)), -1)
    for k in range(len(local)):
        local[k] = np.where(level >= k, _components(ids, level >= k, heads, tails), -1)
    own = local[level, ids]
    border = (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)
    paths = [where[local[: level[i] + 1, i]].tolist() if border[i] else None for i in ids]
    pixels = (np.zeros(len(y), np.int32), y, x, v, label, level, where[own], paths)
    nodes: list[list] = [[] for _ in range(8)]
    light = np.maximum(v, 0.0)
    for k in range(len(local)):
        alive = np.flatnonzero(level >= k)
        roots, inverse, counts = np.unique(local[k, alive], return_inverse=True, return_counts=True)
        flux = np.bincount(inverse, light[alive])
        # Brightest pixel of each component, the first in raster order of equal ones.
        order = np.lexsort((alive, -v[alive], inverse))
        peak = alive[order[np.searchsorted(inverse[order], np.arange(len(roots)))]]
        for r, n, f, p in zip(roots.tolist(), counts.tolist(), flux.tolist(), peak.tolist(), strict=True):
            for column, value in zip(nodes, (int(y[p]), int(x[p]), float(v[p]), int(label[r]), k, int(where[r]), (n, f), where[local[: k + 1, r]].tolist()), strict=True):
                column.append(value)
    return pixels, nodes


def _trees(pixels: DataFrame, connectivity: int, image: list[str], tile: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in image), "kind int, y int, x int, v double, label bigint, level int, local bigint, n bigint, flux double, path array<bigint>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        columns = [pdf[c].to_numpy() for c in ("y", "x", "v", "label", "level")]
        (kind, y, x, v, label, level, local, paths), nodes = _tile_tree(*columns, connectivity, tile)
        sizes = nodes.pop(6)
        made = pd.concat([
            pd.DataFrame({"kind": kind, "y": y, "x": x, "v": v, "label": label, "level": level, "local": local, "n": 0, "flux": 0.0, "path": paths}),
            pd.DataFrame({"kind": NODE, **dict(zip(("y", "x", "v", "label", "level", "local", "path"), nodes, strict=True)),
                          "n": [s[0] for s in sizes], "flux": [s[1] for s in sizes]}),
        ])
        for c in image:
            made[c] = pdf[c].iat[0]
        return made[[*image, "kind", "y", "x", "v", "label", "level", "local", "n", "flux", "path"]]

    tiles = pixels.withColumns({"_ty": block_of("y", tile), "_tx": block_of("x", tile)})
    return cut_lineage(tiles.groupBy(*image, "_ty", "_tx").applyInPandas(run, schema), "component-trees")


def _merged(trees: DataFrame, connectivity: int, image: list[str]) -> DataFrame:
    """(image..., level, local, root) of nodes that touch a node of another tile."""
    border = trees.where((F.col("kind") == PIXEL) & F.col("path").isNotNull()).select(*image, "y", "x", "label", "path")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    reach = border.withColumn("_s", F.explode(offsets)).select(
        *image, "label", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("path").alias("other"))
    # Of two pixels, nodes join at every level that both reach.
    met = border.join(reach, [*image, "label", "y", "x"]).select(*image, F.explode(F.filter(
        F.arrays_zip("path", "other", F.sequence(F.lit(0), F.greatest(F.size("path"), F.size("other")) - 1).alias("level")),
        lambda e: e["path"].isNotNull() & e["other"].isNotNull() & (e["path"] != e["other"]))).alias("e"))
    node = lambda c: F.struct(*image, F.col("e.level").alias("level"), F.col(f"e.{c}").alias("local"))
    merged = connected_components(met.select(node("path").alias("u"), node("other").alias("v")).distinct())
    return merged.select(*[F.col(f"node.{c}").alias(c) for c in (*image, "level", "local")], F.col("root.local").alias("root"))


def deblend(labelled: DataFrame, npixels: int, nlevels: int = 32, contrast: float = 0.001, connectivity: int = 8,
            image: Sequence[str] = (), value: str = "v", tile: int = 256) -> DataFrame:
    """(image..., y, x, value, label, parent, seed_y, seed_x): every labelled pixel
    with the label of its part, numbered 1..n by parent and core in each image, the
    label it had, and the brightest pixel of the part's core."""
    image = list(image)
    start = labelled.select(*image, "y", "x", F.col("label").cast("bigint").alias("label"), finite(value).alias("v"))
    range_of = cut_lineage(start.groupBy(*image, "label").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.greatest("v", F.lit(0.0))).alias("total")), "segment-ranges")
    v, low = F.coalesce("v", "low", F.lit(0.0)), F.coalesce("low", F.lit(0.0))
    leveled = salted_join(start, range_of, [*image, "label"], "inner", spread_by=("y", "x")).select(
        *image, "y", "x", "label", v.alias("v"), level_of(v, low, F.coalesce("high", F.lit(0.0)), nlevels).alias("level"))
    trees = _trees(leveled, connectivity, image, tile)

    # Nodes of the whole image: parts in different tiles add up.
    node, key = [*image, "level", "local"], [*image, "level", "root"]
    parts = trees.where(F.col("kind") == NODE).join(_merged(trees, connectivity, image), node, "left")
    parts = cut_lineage(parts.select(*node, "label", F.coalesce("root", "local").alias("root"), "n", "flux", "path",
                                     F.struct((-F.col("v")).alias("v"), "y", "x").alias("peak")), "tree-nodes")
    whole = parts.groupBy(*key).agg(F.first("label").alias("label"), F.sum("n").alias("n"), F.sum("flux").alias("flux"), F.min("peak").alias("peak"))
    whole = salted_join(whole, range_of.drop("low", "high"), [*image, "label"], "inner", spread_by=("level", "root"))
    enough = (F.col("n") >= npixels) & (F.col("flux") >= contrast * F.coalesce("total", F.lit(0.0)))
    kept = cut_lineage(whole.where(enough | (F.col("level") == 0)).select(*key, "label", "peak"), "significant-nodes")
    # Every node with the nodes around it: a path names one node of each lower level.
    roots = parts.select(*node, "root")
    above = parts.select(*image, F.col("level").alias("at"), F.col("local").alias("of"), F.col("root").alias("of_root"),
                         F.posexplode("path").alias("level", "local")).join(roots, node)
    above = cut_lineage(above.join(kept.select(*key), key).select(*image, "at", "of", "of_root", "level", "root"), "node-paths")
    inner = above.groupBy(*image, "at", "of").agg(F.max(F.struct("level", "root")).alias("inner")).select(
        *image, F.col("at").alias("level"), F.col("of").alias("local"), F.col("inner.level").alias("in_level"), F.col("inner.root").alias("in_root"))
    # A core holds no significant node of the next level.
    chain = above.select(*image, F.col("at"), F.col("of_root"), "level", "root").distinct()
    chain = chain.join(kept.select(*image, F.col("level").alias("at"), F.col("root").alias("of_root"), F.col("peak"), F.col("label")), [*image, "at", "of_root"])
    chain = cut_lineage(chain, "significant-paths")
    holders = chain.where(F.col("at") == F.col("level") + 1).select(*key).distinct()
    cores = kept.join(holders, key, "left_anti")
    numbered = with_row_number(cores.select(*image, "label", F.col("level").alias("at"), F.col("root").alias("of_root"), "peak"), "part", [*image, "label", "of_root", "at"])
    if image:
        before = numbered.groupBy(*image).agg((F.min("part") - 1).alias("_before"))
        numbered = salted_join(numbered, before, image, "inner", spread_by=("part",)).withColumn("part", F.col("part") - F.col("_before")).drop("_before")
    numbered = cut_lineage(numbered.select(*image, "at", "of_root", "part"), "cores")
    inside = chain.join(numbered, [*image, "at", "of_root"]).groupBy(*key).agg(
        F.collect_list(F.struct(F.col("peak.y").alias("y"), F.col("peak.x").alias("x"), "part")).alias("cores"))
    answer = inner.join(inside.withColumnsRenamed({"level": "in_level", "root": "in_root"}), [*image, "in_level", "in_root"]).select(*node, "cores")

    # A node of a tile has at most tile**2 pixels, so this key cannot be hot.
    placed = trees.where(F.col("kind") == PIXEL).select(*image, "y", "x", "v", "label", "level", "local").join(answer, node)
    away = lambda c: ((c["y"] - F.col("y")).cast("bigint") * (c["y"] - F.col("y")) + (c["x"] - F.col("x")).cast("bigint") * (c["x"] - F.col("x")))
    nearest = F.array_min(F.transform("cores", lambda c: F.struct(away(c).alias("d"), c["y"].alias("y"), c["x"].alias("x"), c["part"].alias("part"))))
    out = cut_lineage(placed.select(*image, "y", "x", F.col("v").alias(value), F.col("label").alias("parent"), nearest.alias("c")).select(
        *image, "y", "x", value, F.col("c.part").alias("label"), "parent", F.col("c.y").alias("seed_y"), F.col("c.x").alias("seed_x")), "deblended")
    for table in (trees, parts, kept, above, chain, numbered):
        drop_table(table)
    return out
