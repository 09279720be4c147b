import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.config import Coadd, Detection, Extraction, MatchedFilter, StarMask
from skyweft.functions import kernels, stamps
from skyweft.functions.sky import TangentPlane
from skyweft.operators import coadd, cutouts, detect, mask, match


def pixels(spark, img):
    rows = [(y, x, None if np.isnan(img[y, x]) else float(img[y, x])) for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "y int, x int, v double")


def samples(spark, stack, weights):
    rows = [(k, y, x, float(stack[k, y, x]), float(weights[k, y, x]))
            for k in range(stack.shape[0]) for y in range(stack.shape[1]) for x in range(stack.shape[2])]
    return spark.createDataFrame(rows, "exposure int, y int, x int, sci double, wht double")


def flood(above, eight):
    h, w = above.shape
    seen, comps = np.zeros_like(above), []
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for y in range(h):
        for x in range(w):
            if above[y, x] and not seen[y, x]:
                todo, comp = [(y, x)], []
                seen[y, x] = True
                while todo:
                    p = todo.pop()
                    comp.append(p)
                    for a, b in near:
                        q = (p[0] + a, p[1] + b)
                        if 0 <= q[0] < h and 0 <= q[1] < w and above[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
                comps.append(sorted(comp))
    return comps


@pytest.mark.parametrize("tile,conn", [(5, 8), (8, 4), (64, 8)])
def test_segments_equal_flood_fill(spark, tile, conn):
    rng = np.random.default_rng(tile)
    img = rng.random((26, 33))
    img[:, 16] = 0.9  # one component through all tiles
    want = [c for c in flood(img > 0.6, conn == 8) if len(c) >= 2]
    got = {}
    for r in detect.segment(pixels(spark, img), 0.6, 2, conn, tile=tile).collect():
        got.setdefault(r["label"], []).append((r["y"], r["x"]))
        assert (r["seed_y"], r["seed_x"]) <= (r["y"], r["x"])
    assert [sorted(got[k]) for k in sorted(got)] == want  # labels follow the raster order of seeds


def test_components_per_image(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 1.0), ("b", 0, 2, 1.0), ("b", 0, 3, 1.0), ("b", 3, 9, 1.0)],
                               "image string, y int, x int, v double")
    got = detect.label_components(df, image=["image"], tile=2).collect()
    roots = {(r["image"], r["y"], r["x"]): r["root"] for r in got}
    assert roots == {("a", 0, 0): 0, ("a", 0, 1): 0, ("b", 0, 2): 2, ("b", 0, 3): 2, ("b", 3, 9): 3 * 2**32 + 9}


def clip(stack, sigma, iters):
    keep = np.isfinite(stack)
    for _ in range(iters):
        v = stack[keep]
        if not len(v):
            break
        c, h = np.median(v), sigma * v.std()
        keep = keep & (stack >= c - h) & (stack <= c + h)
    return keep


@pytest.mark.parametrize("stack_rows", [10_000, 3])
def test_clipped_coadd(spark, stack_rows):
    rng = np.random.default_rng(9)
    stack = rng.normal(10, 1, (9, 3, 4))
    stack[0] += 100
    stack[4, 0, 0] = np.nan
    weights = rng.uniform(1, 3, stack.shape)
    weights[2, 1, 1] = 0
    cfg = Coadd(sigma=2.0, output_type="float64")
    out = coadd.clipped_coadd(samples(spark, stack, weights), cfg, stack_rows=stack_rows).collect()
    assert len(out) == 12
    for r in out:
        s, w = stack[:, r["y"], r["x"]], weights[:, r["y"], r["x"]]
        k = clip(s, 2.0, 5)
        assert r["sci"] == pytest.approx((s[k] * w[k]).sum() / w[k].sum())
        assert r["wht"] == pytest.approx(w[k].sum()) and r["err"] == pytest.approx(math.sqrt(1 / w[k].sum()))


def test_weighted_coadd_policies(spark):
    rows = [(1, 0, 0, 1.0, 2.0), (2, 0, 0, 3.0, 2.0), (3, 0, 0, float("nan"), 5.0), (1, 0, 1, 7.0, 0.0), (2, 0, 1, 7.0, -1.0)]
    df = spark.createDataFrame(rows, "exposure int, y int, x int, sci double, wht double")
    got = {r["x"]: r for r in coadd.weighted_coadd(df).collect()}
    assert got[0]["sci"] == 2.0 and got[0]["wht"] == 4.0 and got[0]["err"] == 0.5
    assert got[1]["sci"] is None and got[1]["err"] is None and got[1]["wht"] == 0.0
    zero = {r["x"]: r for r in coadd.weighted_coadd(df, Coadd(empty="zero", err_mode="zero")).collect()}
    assert zero[1]["sci"] == 0.0 and zero[1]["err"] == 0.0
    raw = {r["x"]: r["sci"] for r in coadd.weighted_coadd(df, propagate_nonfinite=True).collect()}
    assert math.isnan(raw[0])
    with pytest.raises(ValueError):
        coadd.check_same_shape(df)


def test_detection_stack_needs_two_inputs(spark):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, 4.0), (2, 0, 1, float("nan")), (3, 0, 1, float("nan"))],
                               "exposure int, y int, x int, sci double")
    assert {(r["x"], r["v"]) for r in coadd.detection_stack(df).collect()} == {(0, 3.0), (1, 0.0)}
    assert coadd.detection_stack(df.where("exposure = 1")).count() == 0


def dense_part_mask(shape, rr, cx, cy, n, turn):
    """Direct evaluation of the shape on a grid."""
    y, x = np.mgrid[0:n, 0:n]
    dx, dy = x - cx, y - cy
    if shape == "circle":
        return dx**2 + dy**2 <= rr**2
    if shape == "jwst":
        period = np.pi / 3
        th = (np.arctan2(dy, dx) - turn + np.pi) % period - period / 2
        m = np.hypot(dx, dy) <= 0.72 * rr * np.cos(np.pi / 6) / np.cos(th)
        arms = [(turn + k * period, 0.0, 1.2 * rr, max(2.0, 0.12 * rr)) for k in range(6)]
    else:
        b = rr / (rr + 18)
        f = (1 - b) ** 1.35
        eff = rr * (1 + f * 0.95)
        core, hw, unit = max(1, 0.45 * eff * (1 + f * 1.45)), max(3.2, 0.1 * eff), eff * (0.98 + b**1.2 * 0.27)
        m = dx**2 + dy**2 <= core**2
        arms = [(math.radians(a) + turn, core, 1.1 * {0.0: 0.4, 180.0: 0.28}.get(a, 1.0) * unit, hw)
                for a in stamps.ARM_ANGLES[shape]]
    for a, start, length, hw in arms:
        along, across = dx * np.cos(a) + dy * np.sin(a), dy * np.cos(a) - dx * np.sin(a)
        end = start + length
        m = m | ((along >= start) & (along <= end) & (abs(across) <= hw)) | ((along - end) ** 2 + across**2 <= hw**2)
    return m


@pytest.mark.parametrize("shape", ["circle", "jwst", "star4", "star12"])
def test_star_masks(spark, shape):
    n, cfg = 150, StarMask(shape=shape, rotation_deg=11.0)
    placed = spark.createDataFrame([(70.3, 75.8, 21.0), (-5.0, 140.2, 9.5)], "cx double, cy double, radius double")
    want = np.zeros((n, n), bool)
    for cx, cy, rr in ((70.3, 75.8, 21.0), (-5.0, 140.2, 9.5)):
        want |= dense_part_mask(shape, rr, cx, cy, n, math.radians(11.0))
    got = np.zeros((n, n), bool)
    for r in mask.mask_raster(spark, n, n, placed, cfg).collect():
        assert not got[r["y"], r["x"]]
        got[r["y"], r["x"]] = True
    assert (got == want).all()
    nothing = spark.createDataFrame([(-900.0, 0.0, 5.0)], "cx double, cy double, radius double")
    assert mask.mask_raster(spark, n, n, nothing, cfg).count() == 0


def test_apply_mask_keeps_every_pixel(spark):
    img = np.arange(100.0).reshape(10, 10)
    placed = spark.createDataFrame([(4.0, 4.0, 2.0)], "cx double, cy double, radius double")
    out = mask.apply_mask(pixels(spark, img), placed, StarMask(shape="circle"), fill=-1.0).collect()
    assert len(out) == 100 and sum(r["v"] == -1.0 for r in out) == 13


def test_convolution_and_peaks(spark):
    rng = np.random.default_rng(4)
    img = rng.random((20, 25))
    k = kernels.gaussian_kernel(1.1)
    r = k.shape[0] // 2
    p = np.pad(img, r)
    want = sum(k[a, b] * p[a:a + 20, b:b + 25] for a in range(k.shape[0]) for b in range(k.shape[1]))
    out = np.zeros_like(img)
    for row in detect.convolve(pixels(spark, img), k, tile=16).collect():
        out[row["y"], row["x"]] = row["v"]
    np.testing.assert_allclose(out, want)
    peaks = {(q["y"], q["x"]) for q in match.local_maxima(pixels(spark, img), 0.8, 20, 25, block=4).collect()}
    assert peaks == {(y, x) for y in range(1, 19) for x in range(1, 24)
                     if img[y, x] >= 0.8 and img[y, x] >= img[y - 1:y + 2, x - 1:x + 2].max()}


def test_template_zoom():
    t = kernels.gaussian_psf(33, 6.0).astype(float)
    assert kernels.resize_template(t, 1.0) is not t
    z = kernels.resize_template(t, 1.15)
    assert z.shape == (38, 38)
    grid = np.linspace(0, 32, 38)
    s = 6.0 / 2.3548200450309493
    g = np.exp(-0.5 * ((grid - 16) / s) ** 2)
    np.testing.assert_allclose(z, np.outer(g, g) * t.max(), atol=2e-5)
    with pytest.raises(ValueError):
        kernels.unit_template(np.ones((5, 5)))
    with pytest.raises(ValueError):
        MatchedFilter(scale_min=2.0)


def test_matched_filter_finds_planted_sources(spark):
    rng = np.random.default_rng(8)
    psf = kernels.gaussian_psf(15, 4.0).astype(float)
    img = rng.normal(0, 0.001, (70, 80))
    for y, x, a in ((20, 30, 3.0), (50, 61, 2.0)):
        img[y - 7:y + 8, x - 7:x + 8] += a * psf
    img[5, 5] = np.nan
    out = match.find_matches(pixels(spark, img), psf, 70, 80, MatchedFilter(threshold_sigma=25.0)).orderBy("id").collect()
    assert [(r["x"], r["y"]) for r in out] == [(31.0, 21.0), (62.0, 51.0)]
    assert out[0]["snr"] > out[1]["snr"] and all(r["fit_corr"] > 0.95 for r in out)


def test_detect_and_measure(spark):
    rng = np.random.default_rng(6)
    img = rng.normal(10, 0.5, (64, 64))
    y, x = np.mgrid[0:64, 0:64]
    img += 80 * np.exp(-0.5 * (((x - 20) / 3) ** 2 + ((y - 40) / 1.5) ** 2))
    found, s = detect.detect_sources(pixels(spark, img), Detection(threshold_sigma=5.0, npixels=8))
    assert s["median"] == pytest.approx(10, abs=0.1)
    rows = detect.merge_catalogs(detect.basic_catalog(found), detect.extended_catalog(found).withColumn("seq", F.lit(0)), "seq").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["sc_xcentroid"], r["sc_ycentroid"]) == pytest.approx((20, 40), abs=0.2)
    assert abs(r["sc_orientation"]) < 5 and r["sc_elongation"] > 1.3 and r["npix"] == r["sc_area"]
    assert r["sc_kron_radius"] >= 1.4 and 0 < r["sc_r50"] < 8
    flat = spark.createDataFrame([(a, b, 1.0 + (a * 7 + b) % 2) for a in range(9) for b in range(9)], "y int, x int, v double")
    assert detect.detect_sources(flat)[0].count() == 0


def test_extraction_on_sloped_background(spark):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:96, 0:96]
    img = 5 + 0.05 * x + rng.normal(0, 0.3, (96, 96)) + 60 * np.exp(-0.5 * ((x - 50) ** 2 + (y - 30) ** 2) / 9)
    cfg = Extraction(box_size=24, npixels=12, nsigma=3.0)
    out = detect.extract_sources(pixels(spark, img), cfg).collect()
    assert len(out) == 1 and (out[0]["x"], out[0]["y"]) == pytest.approx((50, 30), abs=0.3)
    blocked = spark.createDataFrame([(a, b) for a in range(10, 50) for b in range(30, 70)], "y int, x int")
    assert detect.extract_sources(pixels(spark, img), cfg, masked=blocked).count() == 0
    with pytest.raises(ValueError):
        Extraction(tile_max=4, mosaic_cutout=100)


def test_cutouts_trim_and_fill(spark, no_broadcast):
    img = np.arange(400.0).reshape(20, 20)
    src = spark.createDataFrame([("in", 10.0, 10.0, 5), ("edge", 0.0, 19.0, 5), ("out", 200.0, 5.0, 5)],
                                "id string, cx double, cy double, side int")
    w = cutouts.with_windows(src)
    trimmed = {r["id"]: r for r in cutouts.trimmed_summary(pixels(spark, img), w, "id").collect()}
    assert set(trimmed) == {"in", "edge"} and trimmed["in"]["n_pixels"] == 25 and trimmed["edge"]["n_pixels"] == 9
    assert (trimmed["in"]["x0"], trimmed["in"]["x1"]) == (8, 12)
    full = cutouts.stamps(cutouts.partial_cutouts(pixels(spark, img), w, "id"), "id").collect()
    assert {r["id"]: (r["height"], r["width"], len(r["data"])) for r in full} == {k: (5, 5, 25) for k in ("in", "edge", "out")}


def _shuffled_columns(df):
    """Shuffle keys of the physical plan, one text per exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_cutouts_shuffle_windows_not_their_pixels(spark, no_broadcast):
    img = np.arange(6400.0).reshape(80, 80)
    src = spark.range(50).selectExpr("id", "id*1.6D as cx", "id*1.5D as cy", "cast(3 + 2*(id % 4) as int) as side")
    w = cutouts.with_windows(src)
    full = cutouts.partial_cutouts(pixels(spark, img), w, "id")
    assert not any("hashpartitioning(id" in line and "y#" in line for line in _shuffled_columns(full))
    assert not any("collect_list" in line for line in cutouts.window_stamps(pixels(spark, img), w, "id")._jdf.queryExecution().executedPlan().toString().splitlines())


def test_cutouts_equal_brute_force(spark, no_broadcast):
    # Holes, NULL values, repeated pixels and windows, windows larger than a block, shared and NULL keys.
    rng = np.random.default_rng(5)
    dots = [(y, x, None if rng.random() < 0.05 else float(rng.integers(-50, 50))) for y in range(90) for x in range(70) if rng.random() > 0.1]
    dots += dots[::17] + [(3, 3, 7.0), (None, 4, 1.0)]
    image = spark.createDataFrame(dots, "y int, x int, v double")
    asked = [(k, float(rng.uniform(-5, 75)), float(rng.uniform(-5, 95)), int(s)) for k, s in enumerate(rng.choice([1, 3, 5, 9], 60))]
    asked += [(100, 30.0, 40.0, 81), (101, 5.0, 5.0, 33), (7, 20.0, 20.0, 5), (8, 10.0, 10.0, 9), (8, 10.0, 10.0, 9),
              (None, 12.0, 12.0, 3), (None, 50.0, 50.0, 5), (200, 500.0, 500.0, 5), (201, None, 5.0, 5)]
    w = cutouts.with_windows(spark.createDataFrame(asked, "id int, cx double, cy double, side int"))
    inside, spots = [], {}
    for r in w.where("wx0 is not null").collect():
        inside += [(r["id"], y, x, v) for y, x, v in dots if y is not None and r["wy0"] <= y < r["wy1"] and r["wx0"] <= x < r["wx1"]]
        spots.update({(r["id"], y, x): -999.0 for y in range(r["wy0"], r["wy1"]) for x in range(r["wx0"], r["wx1"])})
    assert sorted(map(tuple, cutouts.cutout_pixels(image, w, "id").collect()), key=repr) == sorted(inside, key=repr)
    for k, y, x, v in inside:
        if v is not None:
            spots[k, y, x] = max(spots[k, y, x], v)
    full = {(r["id"], r["y"], r["x"]): r["v"] for r in cutouts.partial_cutouts(image, w, "id", -999.0).collect()}
    assert full == spots
    by_key = {}
    for k, *p in inside:
        by_key.setdefault(k, []).append(tuple(p))
    summary = {r["id"]: tuple(r)[1:] for r in cutouts.trimmed_summary(image, w, "id").collect()}
    assert summary == {k: (len(p), min(x for _, x, _ in p), max(x for _, x, _ in p), min(y for y, _, _ in p), max(y for y, _, _ in p),
                           sum(v for _, _, v in p if v is not None) if any(v is not None for _, _, v in p) else None) for k, p in by_key.items()}
    plain = {r["id"]: r for r in cutouts.stamps(cutouts.cutout_pixels(image, w, "id"), "id").collect()}
    assert {r["id"]: r for r in cutouts.window_stamps(image, w, "id").collect()} == plain and set(plain) == set(by_key)


def test_metric_failures_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, 1, 2, [1.0, 2.0]), (2, 1, 1, [0.0]), (3, 1, 1, [9.0])],
                               "id int, height int, width int, data array<double>")

    def measure(stamp):
        if stamp.max() == 0.0:
            raise ValueError("empty")
        while stamp.max() == 9.0:
            pass
        return {"P_sum": stamp.sum(), "S_n": stamp.size, "ok_list": [1], "_private": 3}

    out = {r["id"]: r for r in cutouts.measure_stamps(df, "id", measure, timeout_s=0.3).collect()}
    assert out[1]["ok"] == 1.0 and out[1]["metrics"] == {"sum": 3.0, "n": 2.0}
    assert out[2]["ok"] == 0.0 and out[2]["error"] == "measure_failed: empty" and out[2]["timeout"] == 0.0
    assert out[3]["timeout"] == 1.0 and out[3]["error"] == "timeout_after_0.30s"


def test_many_images_equal_one_at_a_time(spark):
    """Each image keeps its own statistics, threshold and labels."""
    rng = np.random.default_rng(11)
    frames = {}
    for k, (level, noise) in enumerate(((10.0, 1.0), (500.0, 20.0), (0.0, 0.1))):
        img = rng.normal(level, noise, (60, 50))
        for y, x in rng.integers(5, 45, (6, 2)):
            img[y : y + 4, x : x + 4] += 40 * noise
        img[3, 4] = np.nan
        frames[k] = img
    rows = [(k, y, x, None if np.isnan(v) else float(v)) for k, img in frames.items() for (y, x), v in np.ndenumerate(img)]
    table = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    cfg = Detection(threshold_sigma=5.0, npixels=4)
    found, stats = detect.detect_sources(table, cfg, ["frame"])
    got = {(r["frame"], r["y"], r["x"]): r["label"] for r in found.collect()}
    levels = {r["frame"]: r for r in stats.collect()}
    for k in frames:
        one, s = detect.detect_sources(table.where(F.col("frame") == k).drop("frame"), cfg)
        assert {(k, r["y"], r["x"]): r["label"] for r in one.collect()} == {p: v for p, v in got.items() if p[0] == k}
        assert levels[k]["threshold"] == pytest.approx(s["threshold"]) and levels[k]["n"] == s["n"]


@pytest.mark.parametrize("block", [3, 64])
def test_reprojection_equals_bilinear_interpolation(spark, block):
    rng = np.random.default_rng(3)
    img = rng.random((14, 17))
    img[5, 6] = np.nan
    source = TangentPlane(8.0, 7.0, 150.0, 2.0, -1e-4, 0.0, 0.0, 1e-4)
    c, s = 0.6e-4 * np.cos(0.3), 0.6e-4 * np.sin(0.3)
    reference = TangentPlane(10.0, 9.0, 150.0, 2.0, -c, s, s, c)
    grid = spark.createDataFrame([(y, x) for y in range(25) for x in range(25)], "y int, x int")
    got = {(r.y, r.x): r.v for r in cutouts.reproject(pixels(spark, img), source, grid, reference, block=block).collect()}
    assert len(got) == 625
    for (y, x), v in got.items():
        u, w = x - 9.0, y - 8.0
        xi, eta = -c * u + s * w, s * u + c * w
        sx, sy = -xi / 1e-4 + 7.0, eta / 1e-4 + 6.0
        iy, ix = int(np.floor(sy)), int(np.floor(sx))
        want = 0.0
        for dy, dx, k in ((0, 0, (1 - sy + iy) * (1 - sx + ix)), (0, 1, (1 - sy + iy) * (sx - ix)), (1, 0, (sy - iy) * (1 - sx + ix)), (1, 1, (sy - iy) * (sx - ix))):
            there = 0 <= iy + dy < 14 and 0 <= ix + dx < 17
            want += k * (img[iy + dy, ix + dx] if there else np.nan)
        assert (v is None) == bool(np.isnan(want)) and (v is None or v == pytest.approx(want, abs=1e-6)), (y, x)
    assert sum(v is not None for v in got.values()) > 100
