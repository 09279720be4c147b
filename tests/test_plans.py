import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.operators import graph, match, selection, stats
from skyweft.plans import halo, lineage, ranking, skew


def test_salted_join_equals_plain_join(spark, no_broadcast):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).where("k != 11")
    for how in ("inner", "left_anti", "left_semi", "left"):
        got = skew.salted_join(left, right, ["k"], how, hot_rows=200)
        want = left.join(right, "k", how)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    hot = skew.hot_keys(left, ["k"], 200).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [(7, 9)]


def test_salted_semi_join_with_hot_right(spark, no_broadcast):
    left = spark.range(20).select(F.col("id").alias("k"))
    right = spark.range(3000).select(F.lit(5).cast("bigint").alias("k"), F.col("id").alias("w"))
    got = skew.salted_join(left, right, ["k"], "left_semi", hot_side="right", hot_rows=100).distinct().collect()
    assert [r["k"] for r in got] == [5]
    with pytest.raises(ValueError):
        skew.salted_join(left, right, ["k"], "left_anti", hot_side="right")


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("a"), F.col("id").alias("b"))
    got = ranking.with_row_number(df, "n", [F.col("a").desc(), "b"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert [r["a"] for r in got] == list(range(999, -1, -1))


def test_lineage_is_cut_into_configured_folder(spark):
    df = lineage.cut_lineage(spark.range(10), "t")
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(f"file:{root}") or root in f for f in df.inputFiles())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_rank_equal_numpy(spark, monkeypatch, by):
    monkeypatch.setattr(stats, "BINS", 8)
    monkeypatch.setattr(stats, "SMALL", 5)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 300), np.repeat(0.25, 200), rng.normal(1e6, 1, 50), [1e-300, -1e300]])
    g = np.where(np.arange(len(v)) % 3 == 0, 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)] + [(0, None)], "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.997, 1.0]
    got = stats.exact_quantiles(df, "v", probs, list("abcde"), by, direct=0).collect()
    for row in got:
        want = np.quantile(v if not by else v[g == row["g"]], probs)
        np.testing.assert_allclose([row[c] for c in "abcde"], want, rtol=1e-12)
    assert len(got) == (2 if by else 1)
    direct = stats.exact_quantiles(df, "v", probs, list("abcde"), by).collect()
    np.testing.assert_allclose(sorted(map(tuple, direct)), sorted(map(tuple, got)), rtol=1e-12)


def test_clipped_stats_and_robust_sigma(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(5, 2, 2000), rng.normal(500, 1, 30)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    kept = v
    for _ in range(5):
        c, h = np.median(kept), 3 * kept.std()
        kept = kept[(kept >= c - h) & (kept <= c + h)]
    for direct in (10**6, 0):
        s = stats.clipped_stats(df, "v", 3.0, 5, direct=direct)
        assert s["n"] == len(kept)
        assert (s["mean"], s["median"], s["std"]) == pytest.approx((kept.mean(), np.median(kept), kept.std()))
    center, sigma = stats.robust_sigma(df, "v")
    assert sigma == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    mostly_flat = spark.createDataFrame([(1.0,)] * 9 + [(3.0,)], "v double")
    assert stats.robust_sigma(mostly_flat, "v")[1] == pytest.approx(0.6)
    with pytest.raises(ValueError):
        stats.robust_sigma(spark.createDataFrame([(1.0,)] * 3, "v double"), "v")


def test_connected_components_of_random_graph(spark):
    rng = np.random.default_rng(11)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)]
    edges += [(300, i) for i in range(301, 340)]  # a hub
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_halo_result_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(2)
    img = rng.normal(size=(23, 31))
    df = spark.createDataFrame([(y, x, float(img[y, x])) for y in range(23) for x in range(31)], "y int, x int, v double")

    def box_sum(planes, present, y0, x0):
        p = np.pad(np.nan_to_num(planes["v"]), 2)
        return {"s": sum(p[2 + a:p.shape[0] - 2 + a, 2 + b:p.shape[1] - 2 + b] for a in range(-2, 3) for b in range(-2, 3))}

    results = []
    for tile in (4, 7, 64):
        rows = halo.map_tiles(df, box_sum, "s double", tile=tile, halo=2).collect()
        out = np.full(img.shape, np.nan)
        for r in rows:
            out[r["y"], r["x"]] = r["s"]
        assert len(rows) == img.size
        results.append(out)
    np.testing.assert_allclose(results[0], results[2])
    np.testing.assert_allclose(results[1], results[2])


def greedy(points, sep):
    kept = []
    for y, x, s in sorted(points, key=lambda p: (-p[2], p[0], p[1])):
        if all((y - a) ** 2 + (x - b) ** 2 >= sep * sep for a, b, _ in kept):
            kept.append((y, x, s))
    return sorted(kept)


@pytest.mark.parametrize("sep", [1.0, 3.5, 6.0])
def test_suppression_equals_greedy(spark, sep):
    rng = np.random.default_rng(int(sep * 10))
    cells = rng.permutation(30 * 30)[:150]
    pts = [(int(c // 30), int(c % 30), float(rng.integers(0, 12))) for c in cells]
    got = match.suppress_close(spark.createDataFrame(pts, "y int, x int, score double"), sep).collect()
    assert sorted((r["y"], r["x"], r["score"]) for r in got) == greedy(pts, sep)


def test_every_field_has_one_planned_run(spark):
    listing = spark.createDataFrame([
        ("a", "mosaic_a_v9", "x_F444W.fits"), ("a", "mosaic_a_v10", "z_F444W_i2d.fits"), ("a", "mosaic_a_v10", "b_F444W.fits"), ("a", "other_a_v99", "F444W.fits"),
        ("b", "mosaic_b_v1", "F200W.fits"), ("c", "mosaic_x_v1", "F444W.fits"), ("d", "mosaic_d_v2", "F444W.fits"), ("e", "mosaic_e_v1", "F444W.fits"),
        ("f", "mosaic_f_v1", "F444W.fits.gz"), ("f", "mosaic_f_v2", None), ("zz", "mosaic_zz", "F444W.fits")], "field string, folder string, file_name string")
    fields = spark.createDataFrame([(f,) for f in "abcdefga"], "field string")
    outputs = spark.createDataFrame([("mosaic_d_v2", "catalog_d_v2.csv", 5), ("mosaic_e_v1", "catalog_e_v1.csv", 0)], "folder string, file_name string, size long")
    rows = {r.field: tuple(r)[1:] for r in selection.plan_runs(fields, listing, outputs).collect()}
    assert rows == {
        "a": ("mosaic_a_v10", "b_F444W.fits", "catalog_a_v10.csv", "run"), "b": ("mosaic_b_v1", None, None, "no_f444w"), "c": (None, None, None, "no_mosaic_dir"),
        "d": ("mosaic_d_v2", "F444W.fits", "catalog_d_v2.csv", "skipped"), "e": ("mosaic_e_v1", "F444W.fits", "catalog_e_v1.csv", "run"),
        "f": ("mosaic_f_v2", None, None, "no_f444w"), "g": (None, None, None, "no_mosaic_dir")}
    forced = selection.plan_runs(fields, listing, outputs, force=True)
    assert {r.status for r in forced.collect()} == {"run", "no_f444w", "no_mosaic_dir"}
    assert selection.plan_runs(fields.limit(0), listing, outputs).collect() == []


def test_clipped_statistics_and_whole_table_quantiles_sort_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(5, 2, 3001).round(2), [900.0, -700.0, 5.0, 5.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")

    def no_rounds(*args, **kwargs):
        raise AssertionError("a histogram round reads the input again")

    monkeypatch.setattr(stats, "order_statistics", no_rounds)
    got = stats.clipped_stats(df, "v", 3.0, 5, direct=0)
    kept = v
    for _ in range(5):
        mid, half = np.median(kept), 3.0 * kept.std()
        kept = kept[(kept >= mid - half) & (kept <= mid + half)]
    assert got["n"] == len(kept) and got["median"] == np.median(kept)
    assert np.isclose(got["mean"], kept.mean()) and np.isclose(got["std"], kept.std())
    row = stats.exact_quantiles(df, "v", [0.0, 0.37, 1.0], ["a", "b", "c"], direct=0).first()
    assert np.allclose(tuple(row), np.quantile(v, [0.0, 0.37, 1.0]))
    assert stats.exact_quantiles(df.limit(0), "v", [0.5], ["m"], direct=-1).first() is None
