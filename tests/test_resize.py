import numpy as np
import pytest

from skyweft.operators import resize


def plain(img, shape, smooth=True):
    """Smooth and sample one axis after the other, index by index."""
    for axis in (0, 1):
        img = img.T if axis else img
        n, m = img.shape[0], shape[axis]

        def at(i):
            while n > 1 and not 0 <= i <= n - 1:
                i = -i if i < 0 else 2 * (n - 1) - i
            return i if n > 1 else 0

        sigma = max(0.0, (n / m - 1) / 2) if smooth else 0.0
        reach = int(4 * sigma + 0.5)
        kernel = np.array([np.exp(-0.5 * (k / sigma) ** 2) if reach else 1.0 for k in range(-reach, reach + 1)])
        kernel /= kernel.sum()
        soft = np.array([sum(w * img[at(i + k)] for k, w in zip(range(-reach, reach + 1), kernel)) for i in range(n)])
        rows = []
        for o in range(m):
            s = at((o + 0.5) * n / m - 0.5)
            low = int(np.floor(s))
            rows.append(soft[low] * (1 - (s - low)) + (soft[at(low + 1)] * (s - low) if s > low else 0))
        img = np.array(rows).T if axis else np.array(rows)
    return img


def table(spark, img):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(img)], "y int, x int, v double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["y"], r["x"]])
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("source,shape", [((23, 17), (8, 30)), ((9, 9), (9, 9)), ((1, 7), (3, 2)), ((40, 3), (2, 11))])
def test_resized_equals_plain_loops(spark, source, shape):
    img = np.random.default_rng(3).normal(size=source) * 50
    for smooth in (True, False):
        got = array(resize.resized(table(spark, img), shape, anti_aliasing=smooth), shape)
        np.testing.assert_allclose(got, plain(img, shape, smooth), atol=1e-9)


def test_weights_add_up():
    for n, m in ((1, 1), (1, 5), (2, 7), (100, 3), (7, 100)):
        sums = np.zeros(m)
        for _, o, w in resize.axis_weights(n, m):
            sums[o] += w
        np.testing.assert_allclose(sums, 1.0)
    with pytest.raises(ValueError):
        resize.axis_weights(0, 3)


def test_missing_pixels_images_and_empty_tables(spark):
    rows = [("a", 0, 0, 4.0), ("a", 1, 1, None), ("a", 1, 0, float("nan")), ("b", 0, 1, 8.0)]
    df = spark.createDataFrame(rows, "name string, y int, x int, v double")
    got = {(r["name"], r["y"], r["x"]): r["v"] for r in resize.resized(df, (2, 2), (2, 2), ["name"]).collect()}
    assert len(got) == 8 and got["a", 0, 0] == 4.0 and got["b", 0, 1] == 8.0 and sum(got.values()) == 12.0
    assert resize.resized(df.limit(0), (2, 2)).count() == 0


def test_normalized(spark):
    img = np.arange(36.0).reshape(6, 6)
    img[0, 0] = -50
    got = array(resize.normalized(table(spark, img), 6), (6, 6))
    np.testing.assert_allclose(got, np.where(img < 0, 0, img) / 35, atol=1e-12)
