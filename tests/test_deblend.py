import numpy as np
import pytest

from skyweft.config import Extraction
from skyweft.operators import deblend, detect

from test_images import flood, pixels


def brute(img, label, npixels, nlevels, contrast):
    """(y, x) -> (parent, peak of the core) by flood fills of every level."""
    out = {}
    for k in sorted(set(label[label > 0].tolist())):
        inside = label == k
        low, high, total = img[inside].min(), img[inside].max(), np.maximum(img[inside], 0).sum()
        share = np.zeros_like(img) if high == low else np.log(np.where(inside, img, low) / low) / np.log(high / low) if low > 0 else (img - low) / (high - low)
        level = np.where(inside, np.minimum(np.floor(share * (nlevels + 1)), nlevels), -1)
        nodes = {0: [frozenset(zip(*np.nonzero(inside)))]}
        for i in range(1, nlevels + 1):
            nodes[i] = [frozenset(c) for c in flood(level >= i, True) if len(c) >= npixels and sum(max(img[p], 0) for p in c) >= contrast * total]
        cores = [(i, c) for i in nodes for c in nodes[i] if not any(d <= c for d in nodes.get(i + 1, []))]
        peaks = {c: min(c, key=lambda p: (-img[p], p)) for _, c in cores}
        for p in zip(*np.nonzero(inside)):
            inner = next(c for i in sorted(nodes, reverse=True) for c in nodes[i] if p in c)
            mine = [peaks[c] for _, c in cores if c <= inner]
            best = min(mine, key=lambda q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q))
            out[int(p[0]), int(p[1])] = (int(k), (int(best[0]), int(best[1])))
    return out


def blobs(h, w, sources, seed=0):
    y, x = np.mgrid[:h, :w]
    img = np.random.default_rng(seed).normal(0, 0.02, (h, w))
    for cy, cx, amp, s in sources:
        img += amp * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    return img


SOURCES = [(8, 8, 9, 2.0), (8, 15, 6, 2.0), (20, 10, 5, 3.0), (16, 30, 8, 2.5), (22, 30, 7, 2.0), (19, 35, 3, 1.5)]


@pytest.mark.parametrize(("tile", "nlevels", "contrast"), [(256, 16, 0.001), (7, 16, 0.001), (9, 5, 0.3)])
def test_parts_equal_flood_fills(spark, tile, nlevels, contrast):
    img = blobs(30, 42, SOURCES)
    found = detect.segment(pixels(spark, img), 0.3, 4, tile=tile)
    label = np.zeros(img.shape, int)
    for r in found.collect():
        label[r.y, r.x] = r.label
    got = deblend.deblend(found, 4, nlevels, contrast, tile=tile).collect()
    assert {(r.y, r.x): (r.parent, (r.seed_y, r.seed_x)) for r in got} == brute(img, label, 4, nlevels, contrast)
    labels = {(r.parent, r.seed_y, r.seed_x): r.label for r in got}
    assert sorted(labels.values()) == list(range(1, len(labels) + 1))


def test_several_images_and_odd_values(spark):
    rows = [("a", 0, x, v, 1) for x, v in enumerate([5.0, 6.0, 1.0, float("nan"), 1.0, 7.0, None, 8.0])]
    rows += [("b", 3, x, 2.0, 1) for x in range(4)] + [("b", 9, x, v, 2) for x, v in enumerate([-1.0, 3.0, -2.0, 3.0])] + [("c", 0, 0, None, 5)]
    df = spark.createDataFrame(rows, "image string, y int, x int, v double, label int")
    got = sorted(tuple(r) for r in deblend.deblend(df, 1, 8, 0.1, image=["image"], tile=3).select("image", "y", "x", "parent", "label", "seed_x").collect())
    assert [g for g in got if g[0] == "b"] == [("b", 3, x, 1, 1, 0) for x in range(4)] + [("b", 9, 0, 2, 2, 1), ("b", 9, 1, 2, 2, 1), ("b", 9, 2, 2, 2, 1), ("b", 9, 3, 2, 3, 3)]
    assert [(g[4], g[5]) for g in got if g[0] == "a"] == [(1, 1)] * 4 + [(2, 5)] * 3 + [(3, 7)]
    assert [g for g in got if g[0] == "c"] == [("c", 0, 0, 5, 1, 0)]


def test_no_pixels(spark):
    none = spark.createDataFrame([], "y int, x int, v double, label int")
    assert deblend.deblend(none, 3).collect() == []


def test_extraction_splits_blends(spark):
    img = blobs(48, 64, [(24, 20, 60, 2.2), (24, 28, 50, 2.2)]) + 5
    cfg = dict(nsigma=3.0, npixels=8, box_size=32)
    assert detect.extract_sources(pixels(spark, img), Extraction(**cfg)).count() == 1
    split = detect.extract_sources(pixels(spark, img), Extraction(**cfg, deblend=True)).orderBy("x").collect()
    assert [round(r.x) for r in split] == [20, 28] and sum(r.segment_area for r in split) > 60
