"""Many samples: systems in blocks give what one task's systems give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glacis import queries
from glacis.grid import from_array
from glacis.operators import dense, finalize, kriging, sampling, terrain, variogram


def picks(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, x double, y double, val double")


def bumpy(spark):
    rng = np.random.default_rng(8)
    return from_array(spark, rng.normal(size=(5, 6)).cumsum(0), 5, 5)


def samples(spark, n=45):
    rng = np.random.default_rng(5)
    return picks(spark, [(x, y, 20 + x / 9 + v) for x, y, v in rng.uniform(3, 22, (n, 3))])


def blocks(monkeypatch):
    """Systems of more than 20 samples are factored in blocks of 7 lines."""
    monkeypatch.setattr(kriging, "MOST", 20)
    monkeypatch.setattr(dense, "LINES", 7)


@pytest.mark.parametrize(("method", "terms", "legacy"), [("ordinary", None, False), ("ordinary", None, True), ("universal", ["regional_linear"], False), ("universal", ["quadratic"], True), ("sia", None, False), ("regression", None, False)])
def test_kriging_in_blocks_is_that_of_one_task(spark, monkeypatch, method, terms, legacy):
    cells, grid = bumpy(spark)
    how = {"drift_terms": terms, "legacy_variance": legacy}
    want = kriging.krige(samples(spark), cells, grid, method, **how).orderBy("r", "c").toPandas()
    blocks(monkeypatch)
    got = kriging.krige(samples(spark), cells, grid, method, **how).orderBy("r", "c").toPandas()
    assert len(got) == grid.nrows * grid.ncols and np.allclose(got, want, rtol=1e-8, atol=1e-7)


def test_kriging_in_blocks_without_variance(spark, monkeypatch):
    cells, grid = bumpy(spark)
    blocks(monkeypatch)
    got = kriging.krige(samples(spark), cells, grid, "ordinary").orderBy("r", "c").toPandas()
    bare = kriging.krige(samples(spark), cells, grid, "ordinary", variance=False).orderBy("r", "c").toPandas()
    assert np.allclose(got["z_hat"], bare["z_hat"]) and bare["var"].isna().all()


def test_kriging_of_more_samples_than_one_task_takes(spark):
    """Samples by thousands: estimates at their places are their values."""
    rng = np.random.default_rng(6)
    p = np.column_stack([rng.uniform(0, 900, kriging.MOST + 100), rng.uniform(0, 900, kriging.MOST + 100), rng.normal(size=kriging.MOST + 100)])
    p[:3, :2] = [(0, 0), (900, 900), (0, 900)]
    cells, grid = from_array(spark, np.zeros((3, 3)), 300, 300)
    got = kriging.krige(picks(spark, p), cells, grid, "ordinary").toPandas().set_index(["r", "c"])
    for at, want in (((0, 0), p[0, 2]), ((2, 2), p[1, 2]), ((2, 0), p[2, 2])):
        assert got.loc[at, "z_hat"] == pytest.approx(want, abs=1e-5) and got.loc[at, "var"] == pytest.approx(0, abs=1e-5)


def test_factor_of_a_definite_system(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(23, 23))
    k = q @ q.T + np.eye(23)
    f = dense.factored(spark, 23, lambda a, b: k[a, b].copy(), 5)
    b = rng.normal(size=(23, 4))
    assert np.allclose(f.solve(b), np.linalg.solve(k, b)) and np.allclose(f.squares(b.copy()), (b * np.linalg.solve(k, b)).sum(0))


def test_plausible_with_more_samples_than_one_task_takes(spark, monkeypatch):
    cells, grid = bumpy(spark)
    blocks(monkeypatch)
    got = kriging.krige(samples(spark), cells, grid, "ordinary", variance=False)
    values = samples(spark).toPandas()["val"]
    assert kriging.plausible(got, values) and not kriging.plausible(got.union(spark.createDataFrame([(9, 9, 5e4, None)], got.schema)), values)


def test_range_and_sill_of_any_number_of_samples():
    rng = np.random.default_rng(9)
    x, y, v = rng.uniform(0, 50, (3, kriging.MOST + 1))
    x[:2], y[:2] = (0, 50), (0, 50)
    a, sill, nugget, top = kriging.fitted(x, y, v)
    assert (a, sill, nugget, top) == (pytest.approx(0.6 * 50 * 2**0.5), pytest.approx(v.var()), 0, pytest.approx(50 * 2**0.5))


def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(variogram, "POINTS", 9)
    rng = np.random.default_rng(10)
    p, q = rng.uniform(-40, 40, (50, 2)), rng.normal(size=(50, 3))
    p[7] = p[8]
    points = spark.createDataFrame([(i, *map(float, p[i]), [float(v) for v in q[i]]) for i in range(50)], "pid long, x double, y double, products array<double>")
    i, j = np.triu_indices(50, 1)
    h = np.sqrt(((p[i] - p[j]) ** 2).sum(1))
    k = np.where(h < 23, np.minimum(h // (23 / 5), 4), -1)
    n, far, sums = variogram.binned_pairs(points, 23.0, 5, "products")
    for b in range(5):
        own = k == b
        assert n[b] == own.sum() and far[b] == pytest.approx(h[own].sum()) and sums[b] == pytest.approx(((q[i] - q[j]) ** 2)[own].sum(0))


def test_filtered_points_of_a_tall_grid_take_few_bands(spark):
    """Lines run along the longer side: 200 rows of 6 columns are one band."""
    rng = np.random.default_rng(11)
    cells, grid = from_array(spark, rng.normal(size=(200, 6)).cumsum(0), 5, 5)
    pts = picks(spark, rng.uniform(3, 27, (8, 3)))
    got = terrain.lowpass_at(pts, cells, grid, [3.0, 0.0], "z")
    for k, kc in enumerate((3.0, 0.0)):
        want = {r["pid"]: r["z"] for r in sampling.bilinear(pts, terrain.lowpass(cells, grid, kc), grid, ["z"]).collect() if r["z"] is not None}
        assert {r["pid"]: r["values"][k] for r in got.collect()} == pytest.approx(want)


def test_spline_in_blocks_is_that_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(dense, "LINES", 7)
    cells, grid = bumpy(spark)
    cells = cells.withColumn("inside", F.lit(True))
    p = samples(spark).select("x", "y", F.col("val").alias("depth"))
    want = finalize.blend_points(p, cells, grid).orderBy("r", "c").toPandas()
    got = finalize.blend_points(p, cells, grid, most=20).orderBy("r", "c").toPandas()
    assert len(got) == grid.nrows * grid.ncols and np.allclose(got["thickness"], want["thickness"], atol=1e-6) and (got["thickness"] > 1).any()


def test_factor_of_a_system_that_is_not_definite(spark):
    rng = np.random.default_rng(12)
    q = rng.normal(size=(23, 23))
    k = q @ q.T + np.eye(23) - 6 * np.diag(np.arange(23) % 4 == 1)
    f = dense.factored(spark, 23, lambda a, b: k[a, b].copy(), 5)
    b = rng.normal(size=(23, 4))
    assert (np.linalg.eigvalsh(k) < 0).any()
    assert np.allclose(f.solve(b), np.linalg.solve(k, b)) and np.allclose(f.squares(b.copy()), (b * np.linalg.solve(k, b)).sum(0))


@pytest.mark.parametrize("name", ["facade_migrate", "facade_interpolate", "facade_finalize", "facade_blend"])
def test_facade_in_blocks_is_that_of_one_task(spark, monkeypatch, name):
    run = lambda: queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = run()
    monkeypatch.setattr(kriging, "MOST", 5)
    monkeypatch.setattr(dense, "LINES", 3)
    got, keys = run(), list(want.columns[:2] if "r" in want else want.columns[:1])
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), atol=2e-4, rtol=0)


def test_reconstruction_in_blocks_is_that_of_one_task(spark, monkeypatch):
    """Both krigings of a run (takes a minute or more): of travel times with a quadratic drift, of depths with the slope's and zeros on the margin."""
    run = lambda: queries.reconstruction(spark, "/root/testdata/sf0.001").toPandas().sort_values(["r", "c"], ignore_index=True)
    want = run()
    monkeypatch.setattr(kriging, "MOST", 5)
    monkeypatch.setattr(dense, "LINES", 3)
    pd.testing.assert_frame_equal(run(), want, atol=2e-4, rtol=0)


@pytest.mark.parametrize("name", ["kriging_linear", "kriging_universal"])
def test_kriging_query_in_blocks_is_that_of_one_task(spark, monkeypatch, name):
    run = lambda: queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = run()
    monkeypatch.setattr(kriging, "MOST", 5)
    monkeypatch.setattr(dense, "LINES", 3)
    got, keys = run(), list(want.columns[:2] if "r" in want else want.columns[:1])
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), atol=2e-4, rtol=0)
