import numpy as np
import pytest

from glacis.functions.columns import semivariance
from glacis.grid import from_array, located, resized, same_crs, to_array
from glacis.operators import mask as masks
from glacis.operators.sampling import bilinear, nearest, resample
from glacis.operators.terrain import gaussian, largest_wavenumber, lowpass, median, slopes, smooth


def plane(spark, m=6, n=7, d=5.0):
    r, c = np.mgrid[:m, :n]
    return from_array(spark, 2 * (c + 0.5) * d + 3 * (r + 0.5) * d, d, d)


def test_plane_has_constant_gradient(spark):
    cells, grid = plane(spark)
    got = slopes(cells, grid).toPandas()
    assert np.allclose(got["slope_x"], 2) and np.allclose(got["slope_y"], 3)
    assert np.allclose(got["sin_slope"], np.sin(np.arctan(np.sqrt(13))))


def test_gradient_matches_numpy(spark):
    z = np.random.default_rng(0).normal(size=(9, 5))
    cells, grid = from_array(spark, z, 2.0, 3.0)
    got = slopes(cells, grid)
    gy, gx = np.gradient(z, 3.0, 2.0)
    assert np.allclose(to_array(got, grid, "slope_x"), gx) and np.allclose(to_array(got, grid, "slope_y"), gy)


@pytest.mark.parametrize("shape", [(8, 9), (7, 6)])
def test_lowpass_matches_the_2d_transform(spark, shape):
    z = np.random.default_rng(1).normal(size=shape)
    cells, grid = from_array(spark, z, 5.0, 5.0)
    k = np.hypot(*np.meshgrid(2 * np.pi * 5 * np.fft.fftfreq(shape[1]), 2 * np.pi * 5 * np.fft.fftfreq(shape[0])))
    want = np.fft.ifft2(np.fft.fft2(z) * np.exp(-(k**2) / (2 * 4.0**2))).real
    assert np.allclose(to_array(lowpass(cells, grid, 4.0), grid), want)
    assert np.allclose(to_array(lowpass(cells, grid, 0.0), grid), z)
    assert largest_wavenumber(grid) == np.ceil(k.max())


def test_filters_keep_a_constant_and_gaps(spark):
    z = np.full((6, 8), 3.0)
    z[2, 3] = np.nan
    cells, grid = from_array(spark, z)
    for method in ("gaussian", "fft_lowpass"):
        got = to_array(smooth(cells, grid, method), grid)
        assert np.isnan(got[2, 3]) and np.allclose(got[~np.isnan(got)], 3)
    with pytest.raises(ValueError):
        smooth(cells, grid, "wavelet")


def test_gaussian_and_median_mirror_edges(spark):
    z = np.random.default_rng(2).normal(size=(40, 6))
    cells, grid = from_array(spark, z)
    w = np.pad(z, 1, mode="symmetric")
    want = np.array([[np.median(w[i:i + 3, j:j + 3]) for j in range(6)] for i in range(40)])
    assert np.allclose(to_array(median(cells, grid, 3), grid), want)
    from glacis.operators.terrain import gaussian_weights

    g = gaussian_weights(1.0)
    p = np.pad(z, 4, mode="symmetric")
    want = np.array([[(g[:, None] * g * p[i:i + 9, j:j + 9]).sum() for j in range(6)] for i in range(40)])
    assert np.allclose(to_array(gaussian(cells, grid, 1.0), grid), want)


def test_bilinear_and_resample(spark):
    cells, grid = plane(spark)
    pts = spark.createDataFrame([(0, 11.0, 9.0), (1, 2.5, 2.5), (2, 0.0, 9.0), (3, 32.5, 27.5)], "pid long, x double, y double")
    got = {r["pid"]: r["z"] for r in bilinear(pts, cells, grid, ["z"]).collect()}
    assert got[0] == pytest.approx(2 * 11 + 27) and got[1] == pytest.approx(12.5) and got[3] == pytest.approx(65 + 82.5)
    assert 2 not in got
    assert (resized(from_array(spark, np.zeros((179, 213)), 5, 5)[1], 10, 10).nrows, resized(from_array(spark, np.zeros((179, 213)), 5, 5)[1], 10, 10).ncols) == (90, 106)
    same, g = resample(cells, grid, 5.0, 5.0)
    assert g == grid


def test_nearest_fills_gaps(spark):
    z = np.full((20, 20), np.nan)
    z[3, 4], z[15, 15] = 1.0, 2.0
    cells, grid = from_array(spark, z)
    got = to_array(nearest(cells), grid)
    r, c = np.mgrid[:20, :20]
    want = np.where((r - 3) ** 2 + (c - 4) ** 2 <= (r - 15) ** 2 + (c - 15) ** 2, 1.0, 2.0)
    assert (got == want).all()


def test_masks(spark):
    cells, grid = from_array(spark, np.zeros((10, 10)))
    ring = [(0, i, x, y) for i, (x, y) in enumerate([(0.9, 0.9), (9.1, 0.9), (9.1, 9.1), (0.9, 9.1)])]
    hole = [(1, i, x, y) for i, (x, y) in enumerate([(3.9, 3.9), (6.1, 3.9), (6.1, 6.1), (3.9, 6.1)])]
    got = masks.inside(cells, spark.createDataFrame(ring + hole, "ring_id int, seq int, x double, y double"), grid)
    want = np.zeros((10, 10), bool)
    want[1:9, 1:9] = True
    want[4:6, 4:6] = False
    assert (to_array(got.withColumn("inside", got["inside"].cast("double")), grid, "inside") == want).all()
    edge = masks.eroded(got, grid)
    inner = want.copy()
    p = np.pad(want, 1)
    inner &= p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    assert (to_array(edge.withColumn("e", edge["eroded"].cast("double")), grid, "e") == inner).all()
    d = to_array(masks.margin_distance(got, grid), grid, "distance")
    out = np.argwhere(~want)
    for r, c in np.argwhere(want):
        assert d[r, c] == pytest.approx(np.sqrt(((out - (r, c)) ** 2).sum(1)).min())
    assert masks.zero_points(got, grid).count() == (want & ~inner).sum()


def test_distance_without_outside_is_infinite(spark):
    cells, grid = from_array(spark, np.zeros((3, 3)))
    from pyspark.sql import functions as F

    assert np.isinf(to_array(masks.margin_distance(cells.withColumn("inside", F.lit(True)), grid), grid, "distance")).all()


def test_polygons_are_repaired():
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    line = np.array([(1, 1), (2, 1), (3, 1)], float)
    got = masks.valid_polygons([[bow, line], [square, line], [square, square / 4 + 1], [], [line[:2]]])
    assert [len(p) for p in got] == [1, 1, 2]


def test_crs():
    same_crs(None, "EPSG:1")
    same_crs("epsg:25832", "EPSG:25832")
    with pytest.raises(ValueError):
        same_crs("EPSG:1", "EPSG:2")


def test_models_and_coordinates(spark):
    from pyspark.sql import functions as F

    h = spark.createDataFrame([(0.0,), (50.0,), (200.0,)], "h double")
    got = h.select(semivariance(F.col("h"), "spherical", 100, 2.0), semivariance(F.col("h"), "linear", 100, 2.0)).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.375, 1.0), (2.0, 2.0)]
    cells, grid = plane(spark)
    row = located(cells, grid).where("r = 0 and c = 0").first()
    assert (row["x"], row["y"]) == (2.5, 2.5)
