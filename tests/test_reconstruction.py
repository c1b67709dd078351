import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glacis import config
from glacis.grid import Grid, from_array, to_array
from glacis.operators import finalize, kriging, migration, sampling, terrain
from glacis.operators.variogram import cutoffs, diameter, fit_spherical, pairs, variogram
from glacis.plans.reconstruction import Reconstruction, run_from_config
from glacis.sources import rasters, vectors


def picks(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, x double, y double, val double")


def test_variogram(spark):
    assert variogram(picks(spark, [(0, 0, 1)])).count() == 0
    two = variogram(picks(spark, [(0, 0, 1), (3, 4, 4)]), 10.0).collect()
    assert [(r["distance"], r["val"], r["np"]) for r in two] == [(5.0, 4.5, 1)]
    p = np.random.default_rng(0).uniform(-50, 50, (60, 3))
    h = np.hypot(*(p[:, None, :2] - p[None, :, :2]).transpose(2, 0, 1))
    assert diameter(picks(spark, p)) == pytest.approx(h.max())
    got = variogram(picks(spark, p)).orderBy("bin").toPandas()
    i, j = np.triu_indices(60, 1)
    near = h[i, j] < h.max() / 2
    k = (h[i, j][near] / (h.max() / 30)).astype(int)
    assert got["np"].tolist() == [n for n in np.bincount(k, minlength=15) if n]


def test_fit_recovers_a_spherical_curve():
    h = np.linspace(5, 100, 15)
    q = np.minimum(h / 60, 1)
    a, c, c0 = fit_spherical(h, 1 + 3 * (1.5 * q - 0.5 * q**3))
    assert (a, c, c0) == pytest.approx((60, 3, 1), rel=1e-3)
    assert fit_spherical([], []) == (100.0, 1.0, 0.0)


def test_cutoffs():
    got = cutoffs()
    assert len(got) == 100 and got[0] == 10 and got[-1] == pytest.approx(0.1)
    assert len(cutoffs(step=None)) == 10


def dense(x, y, z, gx, gy):
    n = len(x)
    h = np.hypot(x[:, None] - x, y[:, None] - y)
    a, s = max(0.6 * h.max(), 1), np.var(z) or 1.0
    g = lambda d: np.where(d > a, s, s * (1.5 * d / a - 0.5 * (d / a) ** 3))
    k = np.ones((n + 1, n + 1))
    k[:n, :n] = g(h) + 1e-8 * np.eye(n)
    k[n, n] = 0
    right = np.vstack([g(np.hypot(x[:, None] - gx, y[:, None] - gy)), np.ones(len(gx))])
    w = np.linalg.solve(k, right)
    return z @ w[:n], np.maximum((w[:n] * right[:n]).sum(0) + w[n], 0)


def test_ordinary_kriging_matches_the_primal_system(spark):
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.uniform(0, 30, 12), rng.uniform(0, 20, 12), rng.normal(size=12)])
    cells, grid = from_array(spark, np.zeros((4, 6)), 5, 5)
    got = kriging.krige(picks(spark, p), cells, grid, "ordinary")
    gx, gy = np.meshgrid(np.linspace(0, 30, 6), np.linspace(0, 20, 4))
    z, var = dense(*p.T, gx.ravel(), gy.ravel())
    assert np.allclose(to_array(got, grid, "z_hat").ravel(), z, atol=1e-6) and np.allclose(to_array(got, grid, "var").ravel(), var, atol=1e-6)


def primal(x, y, z, f, gx, gy, gf):
    """Estimates and variances by one system a place, with drift columns ``f`` at samples and ``gf`` at places."""
    n, p = len(x), f.shape[1]
    h = np.hypot(x[:, None] - x, y[:, None] - y)
    a, s = max(0.6 * h.max(), 1), np.var(z) or 1.0
    g = lambda d: np.where(d > a, s, s * (1.5 * d / a - 0.5 * (d / a) ** 3))
    k = np.zeros((n + p, n + p))
    k[:n, :n] = g(h) + 1e-8 * np.eye(n)
    k[:n, n:], k[n:, :n] = f, f.T
    right = np.vstack([g(np.hypot(x[:, None] - gx, y[:, None] - gy)), gf.T])
    w = np.linalg.solve(k, right)
    return z @ w[:n], np.maximum((w * right).sum(0), 0), np.maximum((w[:n] * right[:n]).sum(0) + w[n], 0)


@pytest.mark.parametrize("terms,method", [(["quadratic"], "universal"), (["regional_linear"], "universal"), (["sia_thickness"], "universal"), ([], "sia")])
@pytest.mark.parametrize("centers", [False, True])
def test_kriging_with_drift_matches_the_primal_system(spark, terms, method, centers):
    rng = np.random.default_rng(6)
    p = np.column_stack([rng.uniform(4, 26, 14), rng.uniform(4, 21, 14), rng.normal(size=14)])
    ground = rng.normal(size=(5, 6)).cumsum(1)
    cells, grid = from_array(spark, ground, 5, 5)
    full, first = (kriging.krige(picks(spark, p), cells, grid, method, drift_terms=terms, centers=centers, legacy_variance=legacy).persist() for legacy in (False, True))
    if centers:
        gx, gy, ox = *np.meshgrid(2.5 + 5 * np.arange(6), 2.5 + 5 * np.arange(5)), 2.5
    else:
        gx, gy, ox = *np.meshgrid(np.linspace(0, 30, 6), np.linspace(0, 25, 5)), 0.0
    gx, gy, (x, y, z) = gx.ravel(), gy.ravel(), p.T
    if "quadratic" in terms or "regional_linear" in terms:
        e = max(np.hypot(x[:, None] - x, y[:, None] - y).max(), 1)
        columns = lambda u, v: np.column_stack([np.ones_like(u), u, v, *([u * u, v * v, u * v] if "quadratic" in terms else [])])
        f, gf = columns((x - ox) / e, (y - ox) / e), columns((gx - ox) / e, (gy - ox) / e)
    else:
        sy, sx = np.gradient(ground, 5, 5)
        u = 1 / np.maximum(np.sin(np.arctan(np.hypot(sx, sy))), np.sin(np.radians(2)))
        u = (u - u.mean()) / u.std()
        fx, fy = x / 5 - 0.5, y / 5 - 0.5
        c, r = np.minimum(fx.astype(int), 4), np.minimum(fy.astype(int), 3)
        s, t = fx - c, fy - r
        at = u[r, c] * (1 - s) * (1 - t) + u[r, c + 1] * s * (1 - t) + u[r + 1, c] * (1 - s) * t + u[r + 1, c + 1] * s * t
        f, gf = np.column_stack([np.ones(14), at]), np.column_stack([np.ones(30), u.ravel()])
    estimate, var, legacy = primal(x, y, z, f, gx, gy, gf)
    assert np.allclose(to_array(full, grid, "z_hat").ravel(), estimate, atol=1e-5)
    assert np.allclose(to_array(full, grid, "var").ravel(), var, atol=1e-5) and np.allclose(to_array(first, grid, "var").ravel(), legacy, atol=1e-5)


def test_estimates_out_of_bounds_fall_back(spark, monkeypatch):
    rng = np.random.default_rng(7)
    p = picks(spark, np.column_stack([rng.uniform(3, 22, (9, 2)), rng.normal(size=9)]))
    cells, grid = from_array(spark, np.zeros((5, 5)), 5, 5)
    want = to_array(kriging.krige(p, cells, grid, "ordinary"), grid, "z_hat")
    monkeypatch.setattr(kriging, "plausible", lambda *_: False)
    assert np.allclose(to_array(kriging.krige(p, cells, grid, "universal"), grid, "z_hat"), want)


def test_regression_kriging(spark):
    """Near the samples the residuals bring back what the forest leaves."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, 40) * 5.0, rng.integers(0, 9, 40) * 5.0
    ground = rng.normal(size=(9, 9)).cumsum(0)
    cells, grid = from_array(spark, ground, 5, 5)
    values = {(a, b): 0.3 * a + np.sin(b) for a, b in zip(x, y)}
    got = kriging.krige(picks(spark, [(a, b, v) for (a, b), v in values.items()]), cells, grid, "regression").toPandas()
    step = 45 / 8
    for (a, b), v in values.items():
        r, c = b / step, a / step
        if r == int(r) and c == int(c):
            assert got[(got["r"] == r) & (got["c"] == c)]["z_hat"].item() == pytest.approx(v, abs=1e-3)
    assert np.allclose(got["var"], 0.2 * np.var(list(values.values()))) and got["z_hat"].between(-5, 18).all()


def test_forest_fills_holes_below_the_surface(spark):
    rng = np.random.default_rng(9)
    z = 100 + rng.normal(size=(12, 12)).cumsum(0)
    cells, grid = from_array(spark, z, 5, 5)
    hole = (F.col("r") == 5) & F.col("c").between(3, 6)
    rows = cells.withColumns({"inside": F.col("r").between(1, 10), "bed": F.when(hole, F.col("z")).otherwise(F.col("z") - 20)})
    got = finalize.fill_holes(rows, grid).toPandas().merge(rows.toPandas(), on=["r", "c"])
    filled = (got["r"] == 5) & got["c"].between(3, 6)
    assert (got.loc[~filled, "bed_x"] == got.loc[~filled, "bed_y"]).all() and (got["bed_x"] <= got["z_x"]).all()
    assert (got.loc[filled, "z_x"] - got.loc[filled, "bed_x"]).between(10, 30).all()
    few = rows.withColumn("inside", F.col("r") == 5)
    assert finalize.fill_holes(few, grid).where(F.col("bed") == F.col("z")).count() == 4


def test_filtered_slopes_at_points(spark):
    """One pass for all cutoffs gives what filtering the grid and sampling it gives; so with points dealt in parts."""
    rng = np.random.default_rng(10)
    z = rng.normal(size=(70, 9)).cumsum(0)
    z[3, 4] = np.nan
    cells, grid = from_array(spark, z, 5, 4)
    pts = picks(spark, np.column_stack([rng.uniform(-2, 47, 40), rng.uniform(-2, 282, 40), np.ones(40)]))
    for together in (65536, 15):
        got = {r["pid"]: r["values"] for r in terrain.lowpass_at(pts, cells, grid, [3.0, 0.5, 0.0], "z", together=together).collect()}
        for k, kc in enumerate([3.0, 0.5, 0.0]):
            want = {r["pid"]: r["z"] for r in sampling.bilinear(pts, terrain.lowpass(cells, grid, kc), grid, ["z"]).collect() if r["z"] is not None}
            assert set(got) == set(want) and all(got[i][k] == pytest.approx(v) for i, v in want.items())


def test_pairs_at_any_tile_width(spark):
    p = np.random.default_rng(11).uniform(-40, 40, (50, 3))
    want = sorted((i, j) for i in range(50) for j in range(i) if np.hypot(*(p[i, :2] - p[j, :2])) < 23)
    for fine in (1, 2, 5):
        assert sorted((r["j"], r["i"]) for r in pairs(picks(spark, p), 23.0, fine=fine).collect()) == want


@pytest.mark.parametrize("method", ["ordinary", "universal", "sia_thickness"])
def test_kriging_of_a_constant(spark, method):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(5, 6)).cumsum(0)
    cells, grid = from_array(spark, z, 5, 5)
    got = kriging.krige(picks(spark, [(x, y, 7.0) for x, y in rng.uniform(3, 22, (9, 2))]), cells, grid, method)
    assert np.allclose(to_array(got, grid, "z_hat"), 7, atol=1e-5)


def test_kriging_without_samples_and_with_unknown_methods(spark):
    cells, grid = from_array(spark, np.zeros((3, 3)))
    assert kriging.krige(picks(spark, []), cells, grid, "ordinary").agg(F.sum("z_hat")).first()[0] == 0
    with pytest.raises(ValueError):
        kriging.krige(picks(spark, []), cells, grid, "cokriging")


def test_flat_ground_moves_nothing(spark):
    cells, grid = from_array(spark, np.full((6, 6), 500.0), 5, 5)
    pts = picks(spark, [(10, 10, 100.0), (-20, 3, 50.0)]).withColumn("z_surf", F.lit(500.0))
    got = {r["pid"]: r for r in migration.migrate(pts, cells.withColumn("t", F.lit(100.0)), grid, 0.16).collect()}
    assert (got[0]["x_mig"], got[0]["y_mig"], got[0]["d_mig"]) == pytest.approx((10, 10, 16))
    assert got[1]["d_mig"] == pytest.approx(8) and got[1]["z_surf_mig"] == 500
    zero = migration.migrate(pts, cells.withColumn("t", F.lit(0.0)), grid, 0.16).collect()
    assert sorted(r["d_mig"] for r in zero) == pytest.approx([8, 16])


def test_survey_units_and_extent(spark):
    cells, grid = from_array(spark, np.full((6, 6), 500.0), 5, 5)
    got = migration.prepare(picks(spark, [(10, 10, 100.0)]), cells, grid, "twt").first()
    assert (got["val"], got["z_surf"]) == (50.0, 500.0)
    raw = migration.prepare(picks(spark, [(10, 10, 10.0)]), cells, grid)
    assert migration.unmigrated(raw, "owt").first()["d_mig"] == 10.0
    with pytest.raises(ValueError):
        migration.check_extent(picks(spark, [(900, 900, 1)]), grid)


def test_blend_leaves_the_outside_alone(spark):
    cells, grid = from_array(spark, np.full((12, 12), 100.0), 5, 5)
    inside = (F.col("r").between(2, 9)) & (F.col("c").between(2, 9))
    got = finalize.blend_margin(cells.withColumns({"inside": inside, "bed": F.lit(50.0)}), grid, 10.0).toPandas()
    assert (got.loc[~got["inside"], "bed"] == 100).all() and got["bed"].between(50, 100).all()
    assert got.loc[(got["r"] == 5) & (got["c"] == 5), "bed"].item() == 50


def test_rasters_round_trip(spark, tmp_path):
    z = np.random.default_rng(5).normal(size=(4, 7)).round(3)
    z[1, 2] = np.nan
    cells, grid = from_array(spark, z, 5, 5, (100.0, 200.0, 135.0, 220.0), "EPSG:25832")
    for path in rasters.write_dem(cells, grid, f"file://{tmp_path}/bed", "all"):
        got, g = rasters.read_dem(spark, path, *((5, 5, grid.bounds) if path.endswith(("csv", "npy")) else ()))
        assert np.allclose(to_array(got, g), z, atol=1e-4, equal_nan=True) and g.bounds == pytest.approx(grid.bounds)
    assert rasters.read_dem(spark, f"file://{tmp_path}/bed.tif")[1].crs == "EPSG:25832"
    with pytest.raises(ValueError):
        rasters.write_dem(cells, grid, f"file://{tmp_path}/bed", "gif")


def test_outlines(spark, tmp_path):
    ring, hole = [(1, 1), (9, 1), (9, 9), (1, 9)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    (tmp_path / "o.csv").write_text("x,y\n" + "\n".join(f"{x}.2,{y}.2" for x, y in ring) + "\n,\n" + "\n".join(f"{x}.2,{y}.2" for x, y in hole) + "\n")
    shift = lambda r: [[x + 0.2, y + 0.2] for x, y in r]
    (tmp_path / "o.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [shift(ring), shift(hole)]}))
    cells, grid = from_array(spark, np.zeros((10, 10)))
    counts = {k: vectors.masked(cells, grid, f"file://{tmp_path}/o.{k}").where("inside").count() for k in ("csv", "geojson")}
    assert counts == {"csv": 60, "geojson": 60}
    assert vectors.masked(cells, grid, np.eye(10)).where("inside").count() == 10
    with pytest.raises(ValueError):
        vectors.masked(cells, grid, np.eye(3))


def lzw(data: bytes) -> bytes:
    """Codes of nine bits only: the table is cleared before they grow."""
    codes = []
    for i in range(0, len(data), 200):
        codes += [256, *data[i:i + 200]]
    bits = "".join(format(c, "09b") for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def tiff(z, tile=None, how=1, predictor=1, kind="<f4", nodata=None):
    """A TIFF of strips of three rows, or of tiles, north up, with cells of 5."""
    z, (h, w), dtype = np.asarray(z)[::-1], np.shape(z), np.dtype(kind)
    size, blocks = dtype.itemsize, []
    th, tw = tile or (3, w)
    for top in range(0, h, th):
        for left in range(0, w, tw):
            rows = th if tile else min(th, h - top)
            block = np.zeros((rows, tw), dtype)
            part = z[top:top + rows, left:left + tw]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] -= block[:, :-1].copy()
            raw = block.tobytes()
            if predictor == 3:
                planes = block.astype(dtype.newbyteorder(">")).view(np.uint8).reshape(rows, tw, size).transpose(0, 2, 1).reshape(rows, -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            blocks.append({1: lambda b: b, 8: zlib.compress, 5: lzw}[how](raw))
    at = np.cumsum([8] + [len(b) for b in blocks])
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [size * 8]), (259, "H", [how]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [{"f": 3, "i": 2, "u": 1}[dtype.kind]]),
              (33550, "d", [5.0, 5.0, 0.0]), (33922, "d", [0.0, 0, 0, 100.0, 5.0 * h, 0])]
    fields += [(322, "I", [tw]), (323, "I", [th]), (324, "I", at[:-1]), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", at[:-1]), (278, "I", [th]), (279, "I", [len(b) for b in blocks])]
    if nodata is not None:
        fields.append((42113, "s", f"{nodata}\0".encode()))
    fields.sort(key=lambda f: f[0])
    start, extra, out = int(at[-1]) + 2 + 12 * len(fields) + 4, b"", b""
    for tag, code, values in fields:
        data = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        head = struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], len(values))
        out += head + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", start + len(extra)))
        extra += data if len(data) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, int(at[-1])) + b"".join(blocks) + struct.pack("<H", len(fields)) + out + b"\0" * 4 + extra


@pytest.mark.parametrize("tile", [None, (4, 6)])
@pytest.mark.parametrize("how,predictor,kind", [(1, 1, "<f8"), (8, 1, "<f4"), (8, 2, "<i2"), (8, 3, "<f4"), (5, 1, "<f4"), (5, 2, "<u2"), (5, 3, "<f8")])
def test_tiffs_of_others(spark, tmp_path, tile, how, predictor, kind):
    z = np.random.default_rng(12).integers(1, 400, (11, 13)).astype(kind)
    z[4, 5] = 7
    (tmp_path / "a.tif").write_bytes(tiff(z, tile, how, predictor, kind, 7))
    cells, grid = rasters.read_dem(spark, str(tmp_path / "a.tif"))
    want = z.astype(float)
    want[z == 7] = np.nan
    assert np.array_equal(to_array(cells, grid), want, equal_nan=True) and grid.bounds == (100.0, 0.0, 165.0, 55.0)


def test_outline_files(spark, tmp_path):
    """Several polygons with holes from each format, and a shapefile whose projection differs."""
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    polygons = [[square(1, 1, 22), square(8, 8, 6)], [square(30, 30, 15)], [square(3, 31, 9), square(5, 33, 3)]]
    cells, grid = from_array(spark, np.zeros((10, 10)), 5, 5, crs="EPSG:32632")
    x, y = np.meshgrid(2.5 + 5 * np.arange(10), 2.5 + 5 * np.arange(10))
    within = lambda s: (x > s[0][0]) & (x < s[2][0]) & (y > s[0][1]) & (y < s[2][1])
    want = np.any([within(p[0]) & ~np.any([within(h) for h in p[1:]] or [np.zeros_like(x, bool)], axis=0) for p in polygons], axis=0)
    for kind in ("geojson", "shp", "gpkg"):
        path = tmp_path / f"o.{kind}"
        path.write_bytes(vectors.encode_outline(polygons, kind, None if kind == "shp" else "EPSG:32632"))
        got = vectors.masked(cells, grid, str(path))
        assert np.array_equal(to_array(got.withColumn("m", F.col("inside").cast("double")), grid, "m") == 1, want), kind
    for zone, fine in ((32, True), (33, False)):
        (tmp_path / "o.prj").write_text(f'PROJCS["WGS_1984_UTM_Zone_{zone}N",GEOGCS["GCS_WGS_1984"]]')
        if fine:
            vectors.masked(cells, grid, str(tmp_path / "o.shp"))
        else:
            with pytest.raises(ValueError):
                vectors.masked(cells, grid, str(tmp_path / "o.shp"))


def test_config_is_merged_deeply(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"inputs": {"dem_path": "a.tif", "travel_times_path": "b.csv"}, "kriging_parameters": {"post_migration": {"method": "ordinary"}}}))
    c = config.load_config(str(path))
    assert c["inputs"]["survey_data_path"] == "b.csv" and c["kriging_parameters"]["post_migration"] == config.DEFAULTS["kriging_parameters"]["post_migration"] | {"method": "ordinary"}
    assert config.DEFAULTS["inputs"]["dem_path"] is None
    with pytest.raises(ValueError):
        config.required(config.DEFAULTS)
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.json"))


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(6)
    r, c = np.mgrid[:14, :16]
    z = 500 + 2.0 * r + 1.0 * c + 3 * np.sin(r / 3)
    np.save(tmp_path / "dem.npy", z)
    rows = [(x, y, 500.0, 200 + 50 * np.sin(x / 20)) for x, y in rng.uniform(5, 60, (25, 2))]
    (tmp_path / "survey.csv").write_text("X,Y,Z,T\n" + "\n".join(",".join(map(str, row)) for row in rows))
    own = {"inputs": {"dem_path": f"file://{tmp_path}/dem.npy", "survey_data_path": f"file://{tmp_path}/survey.csv"}, "spatial_parameters": {"dx": 5.0, "dy": 5.0},
           "optimization_parameters": {"kc_max": 4.0, "kc_min": 1.0, "d_kc": 1.5}, "finalization_parameters": {"apply_margin_blend": True, "smooth_bedrock": True},
           "outputs": {"output_path": f"file://{tmp_path}/bed.asc", "output_format": "asc"}}
    (tmp_path / "run.json").write_text(json.dumps(own))
    bed = run_from_config(spark, str(tmp_path / "run.json"))
    got = bed.cells.toPandas()
    assert bed.shape == (14, 16) and len(got) == 14 * 16 and np.isfinite(got[["bed", "thickness", "uncertainty"]]).all().all()
    assert np.allclose(got["thickness"], got["z"] - got["bed"]) and (tmp_path / "bed.asc").exists()
    with pytest.raises(ValueError):
        Reconstruction(spark, z, dx=5.0).interpolate()
    assert isinstance(bed.grid, Grid)
