import numpy as np
import pytest

from skyweft.operators import apertures, detect

from test_deblend import blobs
from test_images import pixels


def brute(img, owner, shapes, bin_pix=0.5):
    y, x = np.mgrid[: img.shape[0], : img.shape[1]]
    out = {}
    for label, cx, cy, a, b, angle in shapes:
        t, a, b = np.radians(angle), max(a, apertures.PIXEL_SIGMA), max(b, apertures.PIXEL_SIGMA)
        dx, dy = x - cx, y - cy
        r = np.sqrt(dx * dx + dy * dy)
        re = np.sqrt(((dx * np.cos(t) + dy * np.sin(t)) / a) ** 2 + ((dy * np.cos(t) - dx * np.sin(t)) / b) ** 2)
        mine = ((owner == 0) | (owner == label)) & np.isfinite(img)
        near = mine & (re <= 6) & (r <= 6 * a)
        f, fr = img[near].sum(), (img * re)[near].sum()
        kron = max(fr / f if f > 0 and fr > 0 else 0, 1.4)
        reach = mine & (r <= 2.5 * kron * a)
        flux = img[reach & (re <= 2.5 * kron)].sum()
        r50, cum = None, 0.0
        for ring in range(int(r.max() / bin_pix) + 1):
            add = img[reach & (np.floor(r / bin_pix) == ring)].sum()
            if flux > 0 and cum + add >= flux / 2:
                r50 = (ring + (flux / 2 - cum) / add) * bin_pix
                break
            cum += add
        out[label] = (kron, flux, int((reach & (re <= 2.5 * kron)).sum()), r50)
    return out


@pytest.mark.parametrize("block", [64, 5])
def test_equal_to_whole_image_sums(spark, monkeypatch, no_broadcast, block):
    monkeypatch.setattr(apertures, "BLOCK", block)
    img = blobs(40, 50, [(12, 12, 9, 2.0), (14, 22, 6, 1.5), (30, 35, 5, 3.0)])
    img[11, 12] = np.nan
    owner = np.zeros(img.shape, int)
    owner[8:16, 8:16], owner[11:18, 19:26], owner[26:35, 30:40] = 1, 2, 3
    shapes = [(1, 12.2, 11.9, 2.1, 1.8, 30.0), (2, 22.0, 14.0, 1.6, 1.4, -80.0), (3, 35.1, 30.0, 3.0, 2.9, 0.0), (4, 45.0, 5.0, 0.0, 0.0, 0.0)]
    labelled = spark.createDataFrame([(int(y), int(x), int(owner[y, x])) for y, x in zip(*np.nonzero(owner))], "y int, x int, label int")
    table = spark.createDataFrame(shapes + [(5, None, None, None, None, None)], "label int, xcentroid double, ycentroid double, semimajor_sigma double, semiminor_sigma double, orientation double")
    got = {r.label: (r.kron_radius, r.kron_flux, r.kron_area, r.r50) for r in apertures.kron_apertures(pixels(spark, img), labelled, table).collect()}
    want = brute(img, owner, shapes)
    assert got.pop(5) == (1.4, None, None, None) and got.keys() == want.keys()
    for label, values in want.items():
        assert got[label] == pytest.approx(values, nan_ok=True), label


def test_light_beyond_the_segment_counts(spark):
    img = blobs(48, 48, [(24, 24, 50, 3.0)])
    found = detect.segment(pixels(spark, img), 20.0, 5)
    inside = detect.extended_catalog(found).first()
    beyond = detect.extended_catalog(found, pixels=pixels(spark, img)).first()
    assert beyond.r50 > inside.r50 and beyond.kron_radius > inside.kron_radius
    assert beyond.r50 == pytest.approx(3.0 * np.sqrt(2 * np.log(2)), rel=0.05)  # of a Gaussian
