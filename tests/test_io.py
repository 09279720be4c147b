import bz2
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.config import Coadd
from skyweft.functions import text
from skyweft.operators import catalog, coadd, selection, tiles
from skyweft.sinks import fits as fits_sink, text as sink
from skyweft.sources import ascii as ascii_source, fits, remote, tables
from skyweft.streaming import incremental

CATALOG = """# 1 NUMBER running number
#   2   X_IMAGE
# 3 Y_IMAGE
# 4 ALPHA_J2000 [deg]
# 5 DELTA_J2000
# 6 KRON_RADIUS
# 7 MAG_COG
# 8 NOTE free text
# a comment
1 10.5 20.5 150.0 2.0 3.5 20.1 ok

2.0 11 nan 150.1 2.1 -1 inf good
x/y 12.5 22.5 bad 2.2
\t4  13.0   23.0  150.3 2.3 0 21.5 7
"""


@pytest.fixture
def catalog_path(tmp_path):
    path = tmp_path / "cat.txt"
    path.write_text(CATALOG)
    return str(path)


def test_parsed_catalog_keeps_blank_and_short_lines(spark, catalog_path):
    got = ascii_source.read_catalog(spark, catalog_path).orderBy("seq").collect()
    assert [r["line"] for r in got] == CATALOG.splitlines()[9:]
    assert [(r["ra"], r["dec_"], r["kron_radius"], r["mag_cog"], r["flags"]) for r in got] == [
        (150.0, 2.0, 3.5, 20.1, None), (None,) * 5, (150.1, 2.1, -1.0, None, None), (None, 2.2, None, None, None),
        (150.3, 2.3, 0.0, 21.5, None)]


def test_wide_catalog_types(spark, catalog_path):
    df = ascii_source.read_wide_catalog(spark, catalog_path)
    types = dict(df.dtypes)
    assert types["NUMBER"] == "string" and types["X_IMAGE"] == "double" and types["NOTE"] == "string"
    got = df.orderBy("seq").collect()
    assert [r["source_id"] for r in got] == ["1", "2", "x_y", "4"]
    assert [r["MAG_COG"] for r in got] == [20.1, None, None, 21.5]


def test_cutout_catalog(spark, catalog_path):
    df = ascii_source.read_cutout_catalog(spark, catalog_path)
    assert "snr_sb_cog" not in df.columns
    usable = catalog.cutout_sources(df).orderBy("seq").collect()
    assert [(r["source_id"], r["x_image"], r["kron_radius"]) for r in usable] == [("1", 10.5, 3.5), ("x_y", 12.5, 3.5), ("4", 13.0, 3.5)]


def test_catalog_without_position_is_an_error(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("# 1 NUMBER\n1\n")
    with pytest.raises(ValueError):
        ascii_source.read_catalog(spark, str(p))
    with pytest.raises(ValueError):
        ascii_source.read_region_catalog(spark, str(p))


def test_clean_lines_and_header(spark, catalog_path, tmp_path):
    df = ascii_source.read_catalog(spark, catalog_path)
    lines = sink.clean_lines(catalog.with_surface_brightness(df)).orderBy("seq").collect()
    assert lines[0]["line"].endswith("1 10.5 20.5 150.0 2.0 3.5 20.1 ok nan nan nan nan nan")
    found = ascii_source.header_lines(ascii_source.located_lines(spark, catalog_path))
    headers = [r["line"] for r in found.orderBy("seq").collect()]
    columns = ascii_source.column_maps(found).first()["columns"]
    full = sink.clean_header(headers, max(columns.values()) + 2)
    assert len(headers) == 9 and full[9].startswith("#   9 AREA_KRON_ARCSEC2 Kron") and full[-1].startswith("#  13 SNR_SB_COG ")
    out = str(tmp_path / "out")
    sink.write_lines(full, sink.clean_lines(catalog.with_surface_brightness(df)), out, ["seq"])
    sink.write_lines(full, sink.clean_lines(catalog.with_surface_brightness(df)), out, ["seq"])  # a second run replaces the first
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    written = "".join(open(os.path.join(out, p)).read() for p in parts).splitlines()
    assert written[:14] == full and len(written) == 19 and written[14].endswith("nan nan nan nan nan")


def test_late_headers_and_files_with_other_columns(spark, tmp_path):
    """A header after ten thousand body lines counts; every file has its own."""
    (tmp_path / "late").mkdir()
    body = "".join(f"{i} 1.5 2.5\n" for i in range(10_050))
    (tmp_path / "late" / "a.cat").write_text("# 1 NUMBER\n# 2 RA\n" + body + "# late comment\n# 3 DEC\n7 8.5 9.5\n")
    lines = ascii_source.located_lines(spark, str(tmp_path / "late"))
    assert [r["line"] for r in ascii_source.header_lines(lines).orderBy("seq").collect()] == ["# 1 NUMBER", "# 2 RA", "# late comment", "# 3 DEC"]
    assert ascii_source.header_lines(lines, leading_only=True).count() == 2
    read = ascii_source.read_catalog(spark, str(tmp_path / "late"))
    assert read.count() == 10_051 and read.where("dec_ = 9.5 and ra = 8.5").count() == 1
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.cat").write_text("# 1 RA\n# 2 DEC\n# 3 MAG_AUTO\n10 20 30\n")
    (tmp_path / "two" / "b.cat").write_text("# 1 MAG_AUTO\n# 2 RA\n# 3 DEC\n30 10 20\n")
    two = ascii_source.read_catalog(spark, str(tmp_path / "two")).select("ra", "dec_", "mag_auto").collect()
    assert [tuple(r) for r in two] == [(10.0, 20.0, 30.0)] * 2
    (tmp_path / "two" / "c.cat").write_text("# 1 MAG_AUTO\n30\n")
    with pytest.raises(ValueError, match="c.cat"):
        ascii_source.read_catalog(spark, str(tmp_path / "two"))


def test_fixed_point_matches_c_rounding(spark):
    rng = np.random.default_rng(0)
    values = [0.125, 1.005, 2.675, 0.5, 1.5, 2.5, -0.001, -0.125, 0.0, 1e-9, 123456789.125, 359.99999999, 0.045, 1.115]
    values += [float(x) for x in rng.uniform(-400, 400, 500)] + [float(x) / 8 for x in range(-40, 40)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3, 6, 8, 10):
        got = [r[0] for r in df.select(text.fixed_point("v", digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]
    large = [1e9 + 0.1, 4503599627370497.5, 9007199254740993.0, 123456789012.34567, 1e15 + 0.3, 1e22, 9e36, -1e18, 99999999.999999999, 2.0**70 + 2.0**18]
    wide = spark.createDataFrame([(v,) for v in large], "v double")
    for digits in (0, 2, 6, 8):
        assert [r[0] for r in wide.select(text.fixed_point("v", digits)).collect()] == [f"{v:.{digits}f}" for v in large]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "v double")
    assert [r[0] for r in odd.select(text.fixed_point("v", 2)).collect()] == ["nan", "nan", "-inf"]


def test_text_helpers(spark):
    assert text.qualify_columns("ra, p_star, count(*) n, gs.dec, other", {"gs": {"ra"}, "ap": {"p_star"}}) == \
        "gs.ra, ap.p_star, count(*) n, gs.dec, other"
    assert text.metric_name("P_Rp") == "Rp" and text.metric_name("Rp") == "Rp"
    df = spark.createDataFrame([("", None, "x"), (None, "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_nonempty("a", "b", "c")).collect()] == ["x", ""]


def test_regions(spark):
    schema = "ra double, dec_ double, a_world double, b_world double, theta_j2000 double, kron_radius double, fwhm_world double"
    rows = [(10.0, 5.0, 1 / 3600, 0.5 / 3600, 30.0, 2.0, None), (10.0, 5.0, None, 1.0, None, None, 1 / 3600),
            (10.0, 5.0, None, None, -100.0, None, None), (None, 5.0, 1.0, 1.0, 0.0, 1.0, 1.0),
            (10.0, 5.0, 1e-9, 1e-9, 200.0, -1.0, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r["line"] for r in sink.catalog_ellipses(df).collect()] == [
        'ellipse(10.00000000,5.00000000,2.000",1.000",60.00)', 'ellipse(10.00000000,5.00000000,0.500",0.500",0.00)',
        'ellipse(10.00000000,5.00000000,0.100",0.100",-110.00)']
    points = [r["line"] for r in sink.subset_ellipses(df.where("ra is not null")).collect()]
    assert points[1] == points[2] == "point(10.00000000,5.00000000) # point=circle"
    d = spark.createDataFrame([(7, 1.0, 2.0, 4.0, 2.0, 15.0), (8, 1.0, 2.0, 0.0, 2.0, 1.0)],
                              "label int, xcentroid double, ycentroid double, elongation double, equivalent_radius double, orientation double")
    assert [r["line"] for r in sink.detection_ellipses(d).collect()] == [
        "ellipse(2.000000,3.000000,4.000000,1.000000,15.000000) # text={7}"]
    e = spark.createDataFrame([(1.0, 2.0, 4.0, 0.5, 100.0), (1.0, 2.0, -4.0, 0.5, 1.0)], "x double, y double, a double, ba double, pa double")
    assert [r["line"] for r in sink.axis_ratio_ellipses(e).collect()] == ["ellipse(1.000000,2.000000,4.000000,2.000000,10.000000)"]
    s = spark.createDataFrame([(5, 1.5, -2.5, 14.256, 8.0)], "source_id bigint, ra double, dec_ double, phot_g_mean_mag double, radius_arcsec double")
    assert sink.labelled_star_circles(s).first()["line"] == 'circle(1.5000000000,-2.5000000000,8.000") # text={id=5 G=14.26}'
    assert sink.star_circles(s).first()["line"] == 'circle(1.50000000,-2.50000000,8.000")'
    p = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    assert sink.peak_points(p).first()["line"] == "point(3.000,4.000) # point=x"


def test_svg(spark):
    t = spark.createDataFrame([(0, 180)], "tile_x int, tile_y int")
    lines = [r["line"] for r in sink.svg_rects(tiles.footprint_boxes(t)).orderBy("x").collect()]
    assert len(lines) == 2 and lines[0].startswith('<rect x="90.00"') and 'width="1.16"' in lines[0]
    g = spark.createDataFrame([(180.0, 0.0), (-180.0, 0.0)], "ra double, dec_ double")
    assert {r["line"].split(" r=")[0] for r in sink.svg_galaxies(g).collect()} == {'<circle cx="925.00" cy="490.00"'}


def test_csv_tables(spark, tmp_path):
    stars = tmp_path / "stars.csv"
    stars.write_text("source_id,RA,Dec,gmag\n1,10.0,5.0,14.5\n2,x,5.0,14.5\n3,11.0,6.0,\n4,nan,1,1\n")
    got = tables.read_stars(spark, str(stars)).orderBy("ra").collect()
    assert [(r["ra"], r["phot_g_mean_mag"]) for r in got] == [(10.0, 14.5), (11.0, None)]
    assert tables.read_stars(spark, str(stars), mag_limit=20.0).count() == 1
    targets = tmp_path / "t.csv"
    targets.write_text("ID,RA,DEC,Size\na,1,2,3\n")
    assert tuple(tables.read_targets(spark, str(targets)).first()) == ("a", 1.0, 2.0, 3.0)
    targets.write_text("ID,RA\na,1\n")
    with pytest.raises(ValueError):
        tables.read_targets(spark, str(targets))
    lst = tmp_path / "list.txt"
    lst.write_text("vos:CFIS_LSB.068.167.r.fits\n\n068.167\n 001.020 x\nnone\n")
    assert sorted(map(tuple, tables.read_tile_list(spark, str(lst)).collect())) == [(1, 20), (68, 167)]
    gal = tmp_path / "gal.txt"
    gal.write_text("# PGC_name RA DEC type\nPGC1 10.0 5.0 S extra\nPGC2 11.0 6.0\nPGC3 1\n\n# end\n")
    rows = tables.read_galaxy_list(spark, str(gal)).collect()
    assert [(r["PGC_name"], r["RA"], r["type"]) for r in rows] == [("PGC1", "10.0", "S"), ("PGC2", "11.0", None)]
    inside = tiles.mark_coverage(spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0), (3, 9.0, 0.0)], "id int, ra double, dec_ double"),
                                 spark.createDataFrame([(0, 180)], "tile_x int, tile_y int")).orderBy("id").collect()
    assert [(r["tile_id"], r["in_footprint"]) for r in inside] == [("000.180", True), (None, False), ("018.180", False)]


def test_fits_table_round_trip(spark, tmp_path):
    folder = str(tmp_path / "tab")
    df = spark.range(500).select(
        F.col("id"), (F.col("id") / 7).alias("RA"), (F.col("id") % 90).cast("float").alias("DEC"), F.col("id").cast("int").alias("N"),
        F.concat(F.lit("s"), F.col("id")).alias("NAME"), (F.col("id") % 2 == 0).alias("OK"))
    fits_sink.write_table(df.repartition(3), folder, {"NAME": 6})
    assert len([f for f in os.listdir(folder) if f.endswith(".fits")]) == 3
    fits.register(spark)
    back = spark.read.format("fits_table").option("rangeBytes", 1000).load(folder)
    assert dict(back.dtypes) == {"id": "bigint", "RA": "double", "DEC": "float", "N": "int", "NAME": "string", "OK": "boolean"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert fits.read_table(spark, folder, ["DEC", "id"]).columns == ["DEC", "id"]
    assert fits.read_table(spark, folder, ["id"]).agg(F.sum("id")).first()[0] == 499 * 250
    with pytest.raises(Exception):
        fits.read_table(spark, folder, ["nope"]).count()
    with pytest.raises(Exception):
        fits_sink.write_table(df, str(tmp_path / "short"), {"NAME": 2})
    cards = fits.header_cards(spark, folder).where("hdu = 1 and key = 'NAXIS2'").collect()
    assert sum(int(r["value"]) for r in cards) == 500


def test_fits_cards_and_forms():
    assert fits.card_value("KEY     = 'it''s / ok'  / note".ljust(80)) == "it's / ok"
    assert fits.card_comment("KEY     = 'it''s / ok'  / note".ljust(80)) == "note"
    assert fits.card_value("A       =                    T / x".ljust(80)) is True
    assert fits.card_value("A       =              1.5D+03".ljust(80)) == 1500.0
    assert fits.card_value("A       =                   12".ljust(80)) == 12
    assert fits.card_value("COMMENT no value".ljust(80)) is None
    assert [fits.tform_bytes(t) for t in ("D", "3E", "12A", "1PE(5)"[:2], "2J", "M")] == [8, 12, 12, 8, 8, 16]
    with pytest.raises(ValueError):
        fits.tform_bytes("Z")
    head = [fits_sink.card("NAXIS2", 5, "rows"), fits_sink.card("CHECKSUM", "x"), fits_sink.card("TFIELDS", 1)]
    new = fits_sink.resized_table_header(head, 9)
    assert len(new) == 2 and fits.card_value(new[0]) == 9 and fits.card_comment(new[0]) == "rows"
    assert fits_sink.label_type(40000) == "int" and fits_sink.label_type(5) == "smallint"
    with pytest.raises(ValueError):
        fits_sink.label_type(40000, "smallint")


def test_fits_vectors_and_complex(spark, tmp_path):
    rows = np.zeros(3, [("V", ">f4", 2), ("C", ">f8", 2), ("P", ">i4", 2)])
    rows["V"] = [[1, 2], [3, 4], [5, 6]]
    rows["C"] = [[1, -1], [2, -2], [3, -3]]
    cards = [fits_sink.card("XTENSION", "BINTABLE"), fits_sink.card("BITPIX", 8), fits_sink.card("NAXIS", 2),
             fits_sink.card("NAXIS1", rows.itemsize), fits_sink.card("NAXIS2", 3), fits_sink.card("PCOUNT", 0),
             fits_sink.card("GCOUNT", 1), fits_sink.card("TFIELDS", 3)]
    for i, (n, f) in enumerate((("V", "2E"), ("C", "M"), ("P", "P")), 1):
        cards += [fits_sink.card(f"TTYPE{i}", n), fits_sink.card(f"TFORM{i}", f)]
    path = tmp_path / "v.fits"
    path.write_bytes(fits_sink.header_bytes(fits_sink.PRIMARY) + fits_sink.header_bytes(cards) + fits_sink.padded(rows.tobytes()))
    got = fits.read_table(spark, str(path)).collect()
    assert [list(r["V"]) for r in got] == [[1, 2], [3, 4], [5, 6]]
    assert [(r["C"]["re"], r["C"]["im"]) for r in got] == [(1, -1), (2, -2), (3, -3)]
    assert bytes(got[0]["P"]) == b"\0" * 8


def test_fits_images(spark, tmp_path):
    img = np.arange(70 * 50, dtype="float64").reshape(70, 50)
    img[3, 4] = np.nan
    px = spark.createDataFrame([(y, x, None if np.isnan(img[y, x]) else float(img[y, x])) for y in range(70) for x in range(50)],
                               "y int, x int, sci double")
    folder = str(tmp_path / "img")
    sci = px.withColumn("wht", F.lit(1.0))
    bands = fits_sink.write_image_bands(sci, folder, ["sci", "wht"], 50, 70, band_rows=40, dtype="float64",
                                        cards=[fits_sink.card("CRPIX2", 10.5)]).collect()
    assert sorted((r["y0"], r["rows"]) for r in bands) == [(0, 40), (40, 30)]
    first = sorted(r["path"] for r in bands)[0]
    back = fits.read_pixels(spark, first, hdu="SCI", block=16)
    out = np.full((40, 50), np.inf)
    for r in back.collect():
        out[r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    np.testing.assert_array_equal(out, img[:40])
    window = fits.read_pixels(spark, first, hdu="SCI", x0=5, x1=9, y0=30, y1=33, block=16)
    assert sorted((r["y"], r["x"], r["v"]) for r in window.collect()) == [(y, x, img[y, x]) for y in range(30, 33) for x in range(5, 9)]
    assert fits.image_header(sorted(r["path"] for r in bands)[1], 1)["CRPIX2"] == -29.5
    cube = tmp_path / "cube.fits"
    data = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    head = [fits_sink.card("SIMPLE", True), fits_sink.card("BITPIX", 16), fits_sink.card("NAXIS", 3), fits_sink.card("NAXIS1", 4),
            fits_sink.card("NAXIS2", 3), fits_sink.card("NAXIS3", 2), fits_sink.card("BSCALE", 2.0), fits_sink.card("BZERO", 1.0)]
    cube.write_bytes(fits_sink.header_bytes(head) + fits_sink.padded(data.tobytes()))
    assert list(fits.read_blocks(spark, str(cube)).first()["data"])[:2] == [1.0, 3.0]
    assert list(fits.read_blocks(spark, str(cube), plane="last", scaled="false").first()["data"])[:2] == [12.0, 13.0]
    with pytest.raises(Exception):
        fits.read_blocks(spark, str(cube), plane="squeeze").count()


def test_compressed_files_equal_the_plain_ones(spark, tmp_path):
    img = np.arange(300 * 40, dtype=">f4").reshape(300, 40)
    card = fits_sink.card
    empty = fits_sink.header_bytes([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)])
    planes = b""
    for name, data in (("SCI", img), ("WHT", img + 1)):
        planes += fits_sink.header_bytes([card("XTENSION", "IMAGE"), card("BITPIX", -32), card("NAXIS", 2), card("NAXIS1", 40), card("NAXIS2", 300),
                                          card("PCOUNT", 0), card("GCOUNT", 1), card("EXTNAME", name)]) + fits_sink.padded(data.tobytes())
    plain, packed = tmp_path / "a.fits", tmp_path / "b.fits.gz"
    plain.write_bytes(empty + planes)
    packed.write_bytes(gzip.compress((empty + planes)[:50_000]) + gzip.compress((empty + planes)[50_000:]))  # two members
    for options in ({}, {"hdu": "WHT"}, {"hdu": "WHT", "y0": 130, "y1": 290, "x0": 3, "x1": 20}):
        a, b = ([tuple(r)[1:] for r in fits.read_blocks(spark, str(f), block=64, rangeBytes=9000, **options).orderBy("y0", "x0").collect()] for f in (plain, packed))
        assert a == b and a
    assert fits.read_blocks(spark, str(packed), rangeBytes=9000).rdd.getNumPartitions() == 1
    cards = [sorted(tuple(r)[1:] for r in fits.header_cards(spark, str(f)).select("path", "hdu", "key", "value").collect()) for f in (plain, packed)]
    assert cards[0] == cards[1]
    both = fits.header_cards(spark, str(tmp_path), "*.fits*").select("path").distinct().count()
    assert both == 2
    with pytest.raises(Exception):
        fits.read_blocks(spark, str(packed), hdu="ERR").count()


def test_cutout_listing(spark, tmp_path):
    (tmp_path / "tile_042.345_source_7.0.fits").write_bytes(fits_sink.image_hdu(np.zeros((2, 2), "float32"), primary=True))
    cards = [fits_sink.card("TILEID", "042.346"), fits_sink.card("SRCID", "9")]
    (tmp_path / "odd.fits").write_bytes(fits_sink.image_hdu(np.zeros((2, 2), "float32"), cards, primary=True))
    (tmp_path / "none.fits").write_bytes(fits_sink.image_hdu(np.zeros((2, 2), "float32"), primary=True))
    got = tables.list_cutouts(spark, str(tmp_path)).orderBy("tile_id").collect()
    assert [(r["tile_id"], r["source_id"]) for r in got] == [("042.345", "7"), ("042.346", "9")]
    assert tables.list_cutouts(spark, str(tmp_path), "042.345").count() == 1


def test_sibling_images(spark):
    names = ["/a/CW-F444W-7Bv2_i2d.fits", "/a/CW-F150W-7b_i2d.fits.gz", "/a/CW-F150W-8B_i2d.fits", "/b/CW-F150W-7B_i2d.fits", "/a/x.fits"]
    df = spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in names], "path string, file_name string")
    got = {}
    for r in tables.sibling_images(df).orderBy("member_rank", "member").collect():
        got.setdefault(r["path"], []).append(r["member"])
    assert got[names[0]] == [names[0], names[1]] and got[names[4]] == [names[4]] and got[names[3]] == [names[3]]
    with pytest.raises(ValueError):
        tables.expect_count(3, 4)


def test_service_payloads(spark):
    pages = [(1, json.dumps({"data": [{"a": 1, "b": "x"}, 5, {"a": None}]})), (2, json.dumps({"Data": [{"c": 2.5}]})), (3, json.dumps({"data": []}))]
    df = spark.createDataFrame(pages, "page int, payload string")
    rows = remote.json_rows(df).orderBy("page", "pos").collect()
    assert [r["row"] for r in rows] == [{"a": "1", "b": "x"}, {"a": None}, {"c": "2.5"}]
    assert sorted(r["page"] for r in remote.accepted_pages(df, 3).collect()) == [1, 2]
    assert sorted(r["page"] for r in remote.accepted_pages(df, 1, max_pages=2).collect()) == [1, 2]
    assert sink.key_union(remote.json_rows(df), "row").columns == ["page", "pos", "a", "b", "c"]
    vo = """<VOTABLE xmlns="u"><RESOURCE><TABLE><FIELD name="t"/><FIELD name="url" ucd="VOX:Image_AccessReference"/>
      <FIELD name="format"/><FIELD name="filter"/><DATA><TABLEDATA>
      <TR><TD>a</TD><TD>/x/frame-g-1.fits.bz2</TD><TD>image/fits</TD><TD>g</TD></TR><TR><TD>b</TD><TD></TD></TR>
      <TR><TD>c</TD><TD>http://o/y.jpg</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""
    resp = spark.createDataFrame([("http://h/siap", vo), ("http://h/bad", "<x")], "endpoint string, payload string")
    got = remote.access_rows(resp).orderBy("seq").collect()
    assert [(r["url"], r["image_format"], r["bandpass"]) for r in got] == [
        ("http://h/x/frame-g-1.fits.bz2", "image/fits", "g"), ("http://o/y.jpg", "", "")]
    plain = fits_sink.header_bytes(fits_sink.PRIMARY)
    blobs = spark.createDataFrame([(0, plain), (1, gzip.compress(plain)), (2, bz2.compress(plain)), (3, b"html"), (4, None)], "i int, b binary")
    out = [r[1] for r in blobs.select("i", remote.decode_fits("b")).orderBy("i").collect()]
    assert [bytes(o) if o else None for o in out] == [plain] * 3 + [None, None]
    urls = F.array(*[F.lit(u) for u in ("http://h/siap?x=fits", "http://h/a.jpg", "http://h/b.FITS")])
    pick = spark.range(1).select(selection.choose_fits_url(urls, "http://h/SIAP?y"), selection.choose_fits_url(F.slice(urls, 2, 1), "http://z")).first()
    assert tuple(pick) == ("http://h/b.FITS", "http://h/a.jpg")
    assert remote.cone_query(1, 2, 0.5, "t", 10).startswith("SELECT TOP 10 source_id")
    assert "phot_g_mean_mag <= 18.0" in remote.polygon_query([(0, 0), (1, 0), (1, 1)], "t", mag_limit=18)


def test_version_order_and_sorting(spark):
    df = spark.createDataFrame([("A", "m_v9"), ("A", "m_v10"), ("A", "m_v1"), ("B", "m_v2")], "field string, version string")
    assert sorted(map(tuple, selection.latest_version(df, ["field"], "version").collect())) == [("A", "m_v10"), ("B", "m_v2")]
    obs = spark.createDataFrame([(1, "nan", None), (2, "5", "x"), (3, "5", "1"), (4, "", "0")], "i int, distance string, t_min string")
    assert [r["i"] for r in selection.sort_observations(obs, tie=("i",)).collect()] == [3, 2, 4, 1]


def test_incremental_coadd_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    inbox, target = str(tmp_path / "in"), str(tmp_path / "sums")
    rows = [(k, y, x, float(rng.normal()), float(rng.uniform(0, 2))) for k in range(3) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "exposure int, y int, x int, sci double, wht double")
    for k in range(2):
        df.where(F.col("exposure") == k).coalesce(1).write.mode("append").parquet(inbox)
    stream = incremental.exposure_stream(spark, inbox, df.schema)
    incremental.accumulate(stream, target, str(tmp_path / "ck")).awaitTermination(120)
    df.where("exposure = 2").coalesce(1).write.mode("append").parquet(inbox)
    incremental.accumulate(stream, target, str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["y"], r["x"]): r["sci"] for r in incremental.latest_coadd(spark, target).collect()}
    want = {(r["y"], r["x"]): r["sci"] for r in coadd.weighted_coadd(df, Coadd(output_type="float64")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    appended = str(tmp_path / "cat")
    incremental.append_catalog(stream, appended, str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(appended).count() == 60


def test_fits_table_writer_replaces_and_keeps_cards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("N"), (F.col("id") * 1.5).alias("V"))
    folder = (tmp_path / "t").as_uri()
    source = [fits_sink.card("TTYPE1", "OLD"), fits_sink.card("NAXIS2", 7), fits_sink.card("TELESCOP", "survey"), fits_sink.card("EPOCH", 2000.0)]
    for _ in range(2):
        fits_sink.write_table(df.repartition(3), folder, cards=source)
    assert fits.read_table(spark, folder).count() == 100
    fits_sink.write_table(df.limit(5), folder, mode="append")
    assert fits.read_table(spark, folder).count() == 105
    cards = {r["key"]: r["value"] for r in fits.header_cards(spark, folder).where("hdu = 1").collect() if r["key"] in ("TELESCOP", "TTYPE1")}
    assert cards == {"TELESCOP": "survey", "TTYPE1": "N"}
    assert not [f for f in os.listdir(tmp_path / "t") if f.startswith("_attempt")]


def test_fits_nonfinite_and_blank_become_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 4.0)], "N long, V double")
    fits_sink.write_table(df, str(tmp_path / "n"))
    assert sorted((r["N"], r["V"]) for r in fits.read_table(spark, str(tmp_path / "n")).where("V is not null").collect()) == [(3, 4.0)]
    head = [fits_sink.card("SIMPLE", True), fits_sink.card("BITPIX", 16), fits_sink.card("NAXIS", 2), fits_sink.card("NAXIS1", 2),
            fits_sink.card("NAXIS2", 2), fits_sink.card("BLANK", -9), fits_sink.card("BSCALE", 2.0)]
    (tmp_path / "b.fits").write_bytes(fits_sink.header_bytes(head) + fits_sink.padded(np.array([[1, -9], [3, 4]], ">i2").tobytes()))
    assert list(fits.read_blocks(spark, str(tmp_path / "b.fits")).first()["data"]) == [2.0, None, 6.0, 8.0]


def test_image_in_column_blocks(spark, tmp_path):
    px = spark.range(12 * 10).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.col("id").cast("double").alias("sci"))
    files = fits_sink.write_image_bands(px, str(tmp_path / "i"), ["sci"], 10, 12, band_rows=8, band_columns=6,
                                        cards=[fits_sink.card("CRPIX1", 3.0), fits_sink.card("CRPIX2", 9.0)]).collect()
    assert sorted((r["y0"], r["rows"], r["x0"], r["columns"]) for r in files) == [(0, 8, 0, 6), (0, 8, 6, 4), (8, 4, 0, 6), (8, 4, 6, 4)]
    last = next(r["path"] for r in files if (r["y0"], r["x0"]) == (8, 6))
    assert {(r["y"], r["x"]): r["v"] for r in fits.read_pixels(spark, last, hdu="SCI").collect()}[1, 2] == 98.0
    head = fits.image_header(last, 1)
    assert head["CRPIX1"] == -3.0 and head["CRPIX2"] == 1.0
