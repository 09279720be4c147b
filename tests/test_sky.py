import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.config import QualityCuts, StarRadius
from skyweft.functions import sky
from skyweft.operators import catalog, tiles, xmatch


def haversine(ra1, dec1, ra2, dec2):
    ra1, dec1, ra2, dec2 = map(math.radians, (ra1, dec1, ra2, dec2))
    a = math.sin((dec2 - dec1) / 2) ** 2 + math.cos(dec1) * math.cos(dec2) * math.sin((ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(a)))) * 3600


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def radius(mag):
    return min(max(8 * 10 ** (-0.2 * ((15 if mag is None else mag) - 15)), 1), 40)


@pytest.mark.parametrize("ra0,dec0", [(150.0, 2.0), (359.999, -40.0), (0.001, 60.0), (10.0, 89.995), (200.0, -89.99)])
@pytest.mark.parametrize("hot", [10_000, 3])
def test_star_exclusion_equals_brute_force(spark, no_broadcast, ra0, dec0, hot):
    rng = random.Random(int(ra0 * 7 + dec0 + hot))
    width = 0.05 / max(math.cos(math.radians(dec0)), 1e-3)

    def place():
        return ((ra0 + rng.uniform(-width, width)) % 360, max(-90.0, min(90.0, dec0 + rng.uniform(-0.05, 0.05))))

    rows = [(i, *place()) for i in range(300)] + [(1000, None, dec0), (1001, ra0, None)]
    rows += [(2000 + i, ra0, dec0) for i in range(30)]  # copies of one position
    stars = [(i, *place(), rng.choice([None, 10.5, 14.0, 16.0, 19.0])) for i in range(60)]
    cat = spark.createDataFrame(rows, "id bigint, ra double, dec_ double")
    st = spark.createDataFrame(stars, "source_id bigint, ra double, dec_ double, phot_g_mean_mag double")

    def near(r, s):
        return None not in r[1:] and haversine(r[1], r[2], s[1], s[2]) <= radius(s[3])

    kept = {r["id"] for r in xmatch.exclude_near_stars(cat, st, hot_rows=hot).collect()}
    assert kept == {r[0] for r in rows if not any(near(r, s) for s in stars)}
    hits = [r["source_id"] for r in xmatch.stars_with_match(cat, st, hot_rows=hot).collect()]
    assert sorted(hits) == sorted(s[0] for s in stars if any(near(r, s) for r in rows))


def test_star_exclusion_keeps_all_without_stars(spark):
    cat = spark.createDataFrame([(1, 10.0, 5.0), (2, None, 5.0)], "id int, ra double, dec_ double")
    st = spark.createDataFrame([], "source_id bigint, ra double, dec_ double, phot_g_mean_mag double")
    assert xmatch.exclude_near_stars(cat, st).count() == 2


def test_radius_policies(spark):
    m = F.lit(None).cast("double")
    got = one(spark, sky.star_radius_arcsec(m).alias("a"),
              sky.star_radius_arcsec(m, StarRadius(r0=100.0, null_mag="r0")).alias("b"),
              sky.star_radius_arcsec(m, StarRadius(null_mag="null")).alias("c"),
              sky.star_radius_arcsec(F.lit(15.0), StarRadius(r0=100.0)).alias("d"))
    assert tuple(got) == (8.0, 100.0, None, 40.0)
    with pytest.raises(ValueError):
        StarRadius(min_radius=5.0, max_radius=1.0)


def test_tile_rounding_is_half_to_even(spark):
    # (dec + 90) * 2 = 0.5 and 1.5 -> 0 and 2
    rows = spark.createDataFrame([(0.0, -89.75), (0.0, -89.25), (0.25, 0.0), (0.75, 0.0)], "ra double, dec_ double")
    got = [tuple(r) for r in tiles.with_tile(rows).select("tile_x", "tile_y").collect()]
    assert got == [(0, 0), (0, 2), (0, 180), (2, 180)]


def test_tile_of_center_is_the_tile(spark):
    grid = [(x, y) for y in range(20, 341, 16) for x in (0, 3, 50)
            if x < 720 * math.cos(math.radians(y / 2 - 90)) - 1]
    t = tiles.tile_centers(spark.createDataFrame(grid, "tile_x int, tile_y int"))
    back = tiles.with_tile(t.select(F.col("tile_x").alias("tx"), F.col("tile_y").alias("ty"), "center_ra", "center_dec"),
                           "center_ra", "center_dec")
    assert back.where("tx != tile_x or ty != tile_y").count() == 0
    pole = tiles.tile_centers(spark.createDataFrame([(0, 360)], "tile_x int, tile_y int")).first()
    assert pole["center_ra"] is None


def test_wrap_segments(spark):
    rows = spark.createDataFrame([(-1.0, 2.0), (359.0, 361.5), (10.0, 11.0)], "a double, b double")
    got = [[tuple(s) for s in r[0]] for r in rows.select(sky.wrap_segments(F.col("a"), F.col("b"))).collect()]
    assert got == [[(359.0, 360.0), (0.0, 2.0)], [(359.0, 360.0), (0.0, 1.5)], [(10.0, 11.0)]]


def test_in_tile_equals_full_test(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(148, 153, 4000), rng.uniform(0, 5, 4000)))]
    df = spark.createDataFrame(rows, "id int, ra double, dec_ double")
    want = {r["id"] for r in tiles.with_tile(df).where("tile_x = 300 and tile_y = 184").collect()}
    assert want and {r["id"] for r in tiles.in_tile(df, 300, 184).collect()} == want


def test_tangent_plane_from_header(spark):
    wcs = sky.TangentPlane.from_header({"CRPIX1": 50.5, "CRPIX2": 40.5, "CRVAL1": 10.0, "CRVAL2": -30.0,
                                        "CDELT1": -2e-4, "CDELT2": 2e-4, "PC1_1": 1.0, "PC2_2": 1.0})
    ra, dec = wcs.world(F.lit(49.5), F.lit(39.5))
    got = one(spark, ra, dec, wcs.pixel_scale_arcsec())
    assert got[0] == pytest.approx(10.0, abs=1e-12) and got[1] == pytest.approx(-30.0, abs=1e-12)
    assert got[2] == pytest.approx(0.72)
    far = one(spark, *wcs.pixel(F.lit(190.0), F.lit(30.0)))
    assert tuple(far) == (None, None)


def test_polygons_and_antipode(spark):
    polys = spark.createDataFrame([(1, 10.0, 0.0, 10.0, 1.0, 11.0, 1.0, 11.0, 0.0)],
                                  "pid int, a1 double, d1 double, a2 double, d2 double, a3 double, d3 double, a4 double, d4 double")
    pts = spark.createDataFrame([(1, 10.5, 0.5), (2, 190.5, -0.5), (3, 12.0, 0.5)], "id int, ra double, dec_ double")
    hit = xmatch.points_in_polygons(pts, polys, [(f"a{i}", f"d{i}") for i in range(1, 5)], 0.8)
    assert [(r["id"], r["pid"]) for r in hit.collect()] == [(1, 1)]


def test_footprint_cone_guard(spark):
    df = spark.createDataFrame([(359.5, 0.0), (0.5, 0.0)], "ra double, dec_ double")
    cone = xmatch.footprint_cone(df).first()
    assert min(cone["center_ra"], 360 - cone["center_ra"]) < 1e-9 and cone["radius_deg"] == pytest.approx(0.55)
    wide = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0)], "ra double, dec_ double")
    with pytest.raises(ValueError):
        xmatch.footprint_cone(wide)


def test_votes_need_enough_available_criteria(spark):
    schema = ("flags double, mag_apauto double, mag_auto double, fwhm_world double, prediq double, a_world double, "
              "b_world double, kron_radius double, mag_cog double, predmaglim double, magerr_cog double, magerr_auto double")
    star = (None, 20.0, 20.0, 0.5 / 3600, 0.6, 1.0, 0.9, 3.5, 20.0, 24.5, 0.01, 0.01)
    rows = [
        star,                                                                    # four votes
        star[:1] + (None, None) + star[3:],                                      # three of three
        star[:1] + (None, None, None) + star[4:],                                # two of two: not enough
        (4.0,) + (None,) * 11,                                                   # flags only
        (None,) * 8 + (24.1, 24.5, None, None),                                  # faint by limit
        (None,) * 12,                                                            # nothing known: kept
    ]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in catalog.with_quality(df).select("flags_bad", "point_like", "faint_bad").collect()]
    t, f = True, False
    assert got == [(f, t, f), (f, t, f), (f, f, f), (t, f, f), (f, f, t), (f, f, f)]
    stats = catalog.quality_counters(df).first().asDict()
    assert stats["rows_removed_total"] == 4 and stats["rows_written"] == 2
    assert catalog.keep_good(df, QualityCuts(disable_point=True, disable_faint=True, flags_max=-1)).count() == 6


def test_nonfinite_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in catalog.nulls_for_nonfinite(df).collect()] == [None, None, 1.0]


def test_staged_cut_requires_column(spark):
    with pytest.raises(ValueError):
        catalog.staged_cuts(spark.createDataFrame([(1,)], "a int"), snr_sb_cog=3.0)


def test_positions_that_are_not_finite_meet_nothing(spark):
    rows = [(1, 10.0, 20.0), (2, float("nan"), 20.0), (3, 10.0, float("inf"))]
    catalog = spark.createDataFrame(rows, "seq int, ra double, dec_ double")
    stars = spark.createDataFrame([(10.0, 20.0, 12.0), (10.0, float("nan"), 12.0), (float("nan"), 20.0, 12.0), (float("-inf"), 1.0, 12.0)],
                                  "ra double, dec_ double, phot_g_mean_mag double")
    assert sorted(r.seq for r in xmatch.exclude_near_stars(catalog, stars).collect()) == [2, 3]


def test_newest_mosaic_tests_few_of_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    boxes = [(k, float(rng.uniform(10, 10.4)), float(rng.uniform(-0.2, 0.2)), float(rng.uniform(0.02, 0.07)), float(rng.integers(0, 50)) if k % 9 else None) for k in range(300)]
    names = [(f"a{i}", f"d{i}") for i in range(1, 5)]
    mosaics = spark.createDataFrame([(k, c, *[z for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for z in (r + sx * h, d + sy * h)]) for k, r, d, h, c in boxes],
                                    "file_name long, creation_date double, " + ", ".join(f"{a} double, {d} double" for a, d in names))
    points = [(k, float(rng.uniform(9.9, 10.5)), float(rng.uniform(-0.3, 0.3)), 1e-9) for k in range(400)]
    targets = spark.createDataFrame(points, "id long, ra double, dec_ double, rad double")
    tested, plain = [], xmatch.cut_lineage if hasattr(xmatch, "cut_lineage") else None
    monkeypatch.setattr(xmatch, "cut_lineage", lambda df, *a: tested.append(plain(df, *a)) or tested[-1])
    got = {r["id"]: r["file_name"] for r in xmatch.newest_covering_mosaic(targets, mosaics, names, "rad", 1e-9, 0.1).collect()}
    for k, ra, dec, _ in points:
        held = [(c is not None, c or 0.0, n) for n, r, d, h, c in boxes if abs(ra - r) <= h and abs(dec - d) <= h]
        assert got[k] == (max(held)[2] if held else None)
    # Footprints that a newer one hides in a cell are not tested there.
    everything = xmatch._polygon_cells(mosaics, names, 1e-9, 0.025).count()
    assert tested[0].count() < everything / 2
