"""Queries over fixtures that the driver's tables give, and DuckDB SQL for those that SQL can express.

Fixtures: a raster of 50 columns from ``part`` (elevation: price plus size, spacing 5), picks from
``supplier``, an outline with a hole as shares of the extent, and a smooth travel-time field.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, scratch
from .functions import columns as fn
from .grid import Grid, in_task, located, same_crs, to_array
from .operators import finalize, kriging, migration
from .operators import mask as masks
from .operators.sampling import bilinear, nearest, resample
from .operators.terrain import gaussian, lowpass, median, slopes, smooth
from .operators.variogram import cutoffs, fit_spherical, judged, model_curve, sweep, variogram
from .plans.reconstruction import BedMap, Reconstruction, displacements, pseudo_survey
from .sources.rasters import read_dem, write_bytes, write_dem
from .sources.vectors import encode_outline, masked, read_survey

COLUMNS, STEP = 50, 5.0
#: Outline and hole as shares of the extent; corners lie off the cells' centres.
OUTER = [(0.083, 0.071), (0.921, 0.113), (0.877, 0.893), (0.461, 0.957), (0.107, 0.831)]
HOLE = [(0.433, 0.427), (0.587, 0.431), (0.583, 0.571), (0.429, 0.569)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    part = read(spark, sf_dir, "part")
    rows = part.count() // COLUMNS
    cells = part.select(F.expr(f"p_partkey div {COLUMNS}").alias("r"), (F.col("p_partkey") % COLUMNS).alias("c"), (F.col("p_retailprice") + F.col("p_size")).alias("z"))
    return cells, Grid.of(rows, COLUMNS, STEP, STEP)


def picks(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    k = F.col("s_suppkey")
    height = int(STEP * grid.nrows - STEP)
    return read(spark, sf_dir, "supplier").select(
        k.alias("pid"), (F.lit(2.5) + (k * 37) % 245).alias("x"), (F.lit(2.5) + (k * 53) % height).alias("y"), (F.lit(5.0) + F.abs("s_acctbal") / 100).alias("val"))


def rings(spark: SparkSession, grid: Grid) -> DataFrame:
    w, h = grid.bounds[2], grid.bounds[3]
    rows = [(i, j, fx * w, fy * h) for i, ring in enumerate((OUTER, HOLE)) for j, (fx, fy) in enumerate(ring)]
    return spark.createDataFrame(rows, "ring_id int, seq int, x double, y double")


def outlined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    cells, grid = raster(spark, sf_dir)
    return masks.inside(cells, rings(spark, grid), grid), grid


def timed(cells: DataFrame, grid: Grid) -> DataFrame:
    """The raster over 20 (so that slopes are gentle) and a travel time that varies smoothly."""
    at = located(cells.withColumn("z", F.col("z") / 20), grid)
    return at.withColumn("t", F.lit(200.0) + F.lit(40.0) * F.sin(F.col("x") / 60) + F.lit(30.0) * F.cos(F.col("y") / 75)).drop("x", "y")


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, other.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def terrain_slope(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(slopes(cells, grid).select("r", "c", "slope_x", "slope_y", "slope", "slope_rad"))


def terrain_trig(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(slopes(cells, grid).select("r", "c", "slope_grad", "sin_x", "cos_x", "sin_y", "cos_y", "sin_slope"))


def fft_lowpass(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(lowpass(cells, grid, 10.0))


def post_fft_lowpass(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(lowpass(cells, grid, 0.3, per_cell=False))


def gaussian_smooth(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(gaussian(cells, grid, 1.5))


def median_smooth(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(median(cells, grid, 3))


def variogram_bins(spark, sf_dir):
    _, grid = raster(spark, sf_dir)
    return rounded(variogram(picks(spark, sf_dir, grid), 90.0), 4)


def variogram_default_reach(spark, sf_dir):
    """The reach is half of the largest distance."""
    _, grid = raster(spark, sf_dir)
    return rounded(variogram(picks(spark, sf_dir, grid)), 4)


def variogram_models(spark, sf_dir):
    h = spark.range(0, 60).select((F.col("id") * F.lit(2.5)).alias("h"))
    return rounded(h.select("h", *[fn.semivariance(F.col("h"), m, 80.0, 4.0).alias(m) for m in ("spherical", "exponential", "gaussian", "linear")]))


def variogram_fit(spark, sf_dir):
    _, grid = raster(spark, sf_dir)
    smooth_ = F.lit(30.0) * F.sin(F.col("x") / 40) * F.cos(F.col("y") / 50) + F.col("val") / 10
    got = variogram(picks(spark, sf_dir, grid).withColumn("val", smooth_), 90.0).orderBy("bin").toPandas()  # no more rows than bins
    a, c, c0 = fit_spherical(got["distance"], got["val"])
    return rounded(model_curve(spark, a, c, c0, float(got["distance"].max())), 4)


def bilinear_sample(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(bilinear(picks(spark, sf_dir, grid), cells, grid, ["z"]))


def resample_dem(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(resample(cells, grid, 10.0, 10.0)[0])


def nearest_fill(spark, sf_dir):
    cells, _ = raster(spark, sf_dir)
    return rounded(nearest(cells.withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 3) % 5 > 1, F.col("z")))))


def mask_polygon_with_hole(spark, sf_dir):
    return outlined(spark, sf_dir)[0].select("r", "c", "inside")


def mask_boundary(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    return masks.eroded(cells, grid).select("r", "c", "eroded", "boundary")


def zero_boundary_points(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    return rounded(masks.zero_points(cells, grid))


def distance_to_margin(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    return rounded(masks.margin_distance(cells, grid))


def _bed() -> Column:
    return F.col("z") - F.lit(40.0) - F.lit(10.0) * F.sin(F.col("r") / 7) * F.cos(F.col("c") / 9)


def margin_blend(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    return rounded(finalize.blend_margin(cells.withColumn("bed", _bed()), grid, 30.0).select("r", "c", "thickness", "bed"))


def eikonal_migration(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    field = timed(cells, grid)
    points = migration.prepare(picks(spark, sf_dir, grid), field, grid)
    return rounded(migration.migrate(points, field, grid))


def velocity_sweep(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    field = timed(cells, grid)
    points = migration.prepare(picks(spark, sf_dir, grid), field, grid)
    return rounded(migration.velocities(points, field, grid, [0.12, 0.16]).select("pid", "velocity", "x_mig", "y_mig", "d_mig"))


def survey_units(spark, sf_dir):
    _, grid = raster(spark, sf_dir)
    kinds = ("one_way_travel_time", "two_way_travel_time", "thickness")
    return rounded(picks(spark, sf_dir, grid).select("pid", *[fn.one_way(F.col("val"), k).alias(k) for k in kinds]))


def survey_extent(spark, sf_dir):
    _, grid = raster(spark, sf_dir)
    points = picks(spark, sf_dir, grid)
    migration.check_extent(points, grid)
    return rounded(points.agg(*[f(k).alias(f"{n}{k}") for k in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]))


def unmigrated_depth(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    points = migration.prepare(picks(spark, sf_dir, grid), cells, grid)
    return rounded(migration.unmigrated(points, "one_way_travel_time"))


def stress_products(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    sine = slopes(cells, grid).select("r", "c", "sin_slope")
    points = picks(spark, sf_dir, grid)
    at = bilinear(points, sine, grid, ["sin_slope"])
    return rounded(points.join(at, "pid", "left").select("pid", fn.stress_product(F.col("val"), F.col("sin_slope")).alias("product")))


def sia_drift_standardized(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(kriging.drift_column(cells, grid))


def kriging_system(spark, sf_dir):
    """Range and sill that a kriging system takes from its samples."""
    _, grid = raster(spark, sf_dir)
    got = picks(spark, sf_dir, grid).orderBy("pid").toPandas()
    a, sill, _, _ = in_task(spark, lambda: kriging.fitted(got["x"], got["y"], got["val"]))
    return rounded(spark.createDataFrame([(a, sill, len(got))], "range double, sill double, samples long"))


def _kriged(spark, sf_dir, method, **how):
    cells, grid = outlined(spark, sf_dir)
    return rounded(kriging.krige(picks(spark, sf_dir, grid), cells, grid, method, mask="inside", **how), 4)


def kriging_ordinary(spark, sf_dir):
    return _kriged(spark, sf_dir, "ordinary")


def kriging_universal(spark, sf_dir):
    return _kriged(spark, sf_dir, "universal", drift_terms=["quadratic"], zero_boundary=True)


def kriging_sia(spark, sf_dir):
    return _kriged(spark, sf_dir, "sia_thickness")


def kriging_linear(spark, sf_dir):
    return _kriged(spark, sf_dir, "universal", drift_terms=["regional_linear"])


def kriging_plausible(spark, sf_dir):
    """The check of estimates: those of ordinary kriging pass, far or unknown ones don't."""
    cells, grid = raster(spark, sf_dir)
    points = picks(spark, sf_dir, grid)
    values = points.select("val").toPandas()["val"]
    got = kriging.krige(points, cells, grid, "ordinary", variance=False).select("z_hat").persist()
    far = got.union(spark.createDataFrame([(50_000.0,)], "z_hat double"))
    gap = got.union(spark.createDataFrame([(None,)], "z_hat double"))
    return spark.createDataFrame([(n, kriging.plausible(f, values)) for n, f in (("estimates", got), ("far", far), ("gap", gap))], "name string, plausible boolean")


def kriging_regression(spark, sf_dir):
    return _kriged(spark, sf_dir, "regression")


def _reconstructed(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    rows = slopes(cells, grid).withColumns({"product": F.lit(20.0) + F.lit(8.0) * F.sin(F.col("r") / 5) * F.cos(F.col("c") / 6), "variance": F.lit(2.0) + F.cos(F.col("c") / 8)})
    thick = fn.thickness_from_product(F.col("product"), F.col("sin_slope"), F.col("inside"), 100.0)
    var = fn.product_variance(F.col("variance"), F.col("sin_slope"), F.col("inside"))
    return rows.withColumns({"thickness": thick, "bed": F.col("z") - thick, "uncertainty": fn.uncertainty(var, F.col("inside"))}).select("r", "c", "z", "inside", "thickness", "bed", "uncertainty")


def thickness_reconstruct(spark, sf_dir):
    return rounded(_reconstructed(spark, sf_dir).select("r", "c", "thickness", "bed", "uncertainty"), 5)


def thickness_stats(spark, sf_dir):
    return rounded(finalize.summary(_reconstructed(spark, sf_dir)), 5)


def bss_sweep(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    return rounded(sweep(cells, picks(spark, sf_dir, grid), grid).select("kc", "mean_variance"), 5)


def forest_fill(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    bed = F.when((F.col("r") % 7 == 3) & (F.col("c") % 5 < 2), F.col("z")).otherwise(_bed())
    return rounded(finalize.fill_holes(cells.withColumn("bed", bed), grid).select("r", "c", "bed"), 4)


def spline_blend(spark, sf_dir):
    cells, grid = outlined(spark, sf_dir)
    points = picks(spark, sf_dir, grid).select("x", "y", F.col("val").alias("depth"))
    return rounded(finalize.blend_points(points, cells, grid, 30.0).select("r", "c", "thickness", "bed"), 4)


def _facade(spark, sf_dir, **how) -> Reconstruction:
    cells, grid = outlined(spark, sf_dir)
    outline = cells.select("r", "c", F.col("inside").cast("int").alias("v"))
    return Reconstruction(spark, cells.select("r", "c", (F.col("z") / 20).alias("z")), outline, STEP, STEP, kriging_method="ordinary", **how)


def facade_slope(spark, sf_dir):
    """The sine of the filtered slope, worked out once for a cutoff."""
    run = _facade(spark, sf_dir)
    first = run.smoothed_sine(2.0)
    if run.smoothed_sine(2.0000000001) is not first:
        raise AssertionError("the slope was filtered twice")
    return rounded(first)


def _interpolated(spark, sf_dir) -> Reconstruction:
    run = _facade(spark, sf_dir, survey_data_type="thickness")
    run.migrate(picks(spark, sf_dir, run.grid))
    run.kc = 2.0
    return run


def facade_interpolate(spark, sf_dir):
    return rounded(_interpolated(spark, sf_dir).interpolate().select("r", "c", "inside", "thickness", "bed", "var"), 4)


def facade_blend(spark, sf_dir):
    return rounded(_interpolated(spark, sf_dir).blend(25.0).select("r", "c", "thickness", "bed"), 4)


def facade_finalize(spark, sf_dir):
    """Kriging, the median of the thickness, the margin, thickness and deviation."""
    run = _interpolated(spark, sf_dir)
    return rounded(run.finalize(apply_margin_blend=True, min_gap_dist=20.0, smooth_bedrock=True, smoothing_method="gaussian", smoothing_sigma=1.5).cells.drop("z"), 4)


def facade_migrate(spark, sf_dir):
    """Travel times are kriged at one cutoff, and the picks migrated by the field that they make."""
    run = _facade(spark, sf_dir)
    run.cutoffs = [2.0]
    return rounded(run.migrate(picks(spark, sf_dir, run.grid)), 4)


def facade_optimize(spark, sf_dir):
    """The sweep without picks: every fifth cell counts as one."""
    run = _facade(spark, sf_dir)
    kc = run.optimize(4.0, 0.5, 0.5)
    return rounded(run.scores.select("kc", "mean_variance", (F.col("kc") == F.lit(kc)).alias("best")), 5)


def facade_from_config(spark, sf_dir):
    """A raster file, an outline file and a configuration file make a run."""
    cells, grid = raster(spark, sf_dir)
    dem, outline = scratch.path(spark, "dem.tif"), scratch.path(spark, "outline.geojson")
    write_dem(cells, grid, dem)
    write_bytes(spark, outline, encode_outline([corners(grid)], "geojson"))
    with tempfile.TemporaryDirectory() as folder:  # the driver reads the configuration
        path = os.path.join(folder, "own.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"inputs": {"dem_path": dem, "outline_path": outline, "survey_data_path": "picks.csv"}}, f)
        run = Reconstruction.from_config(spark, path)
    return run.cells.select("r", "c", "z", "inside", F.lit(len(run.cutoffs)).cast("long").alias("cutoffs"))


def plot_extent(spark, sf_dir):
    return spark.createDataFrame([tuple(map(float, _facade(spark, sf_dir).extent))], "minx double, maxx double, miny double, maxy double")


def plot_arrows(spark, sf_dir):
    cells, grid = raster(spark, sf_dir)
    field = timed(cells, grid)
    points = migration.prepare(picks(spark, sf_dir, grid), field, grid).persist()
    return rounded(displacements(points, migration.migrate(points, field, grid)))


def pseudo_picks(spark, sf_dir):
    return rounded(pseudo_survey(*raster(spark, sf_dir)))


def _scanned(spark, sf_dir, kind: str, **how) -> DataFrame:
    cells, grid = raster(spark, sf_dir)
    path = write_dem(cells, grid, scratch.path(spark, "dem"), kind)[0]
    back, found = read_dem(spark, path, **how)
    shape = F.struct(F.lit(found.nrows).alias("nrows"), F.lit(found.ncols).alias("ncols"), F.lit(found.dx).alias("dx"), F.lit(found.bounds[3]).alias("maxy"))
    return rounded(back.select("r", "c", "z", *[shape[k].alias(k) for k in ("nrows", "ncols", "dx", "maxy")]), 4)


def scan_geotiff(spark, sf_dir):
    """Written as GeoTIFF and read again; so are the other formats below."""
    return _scanned(spark, sf_dir, "tif")


def scan_ascii(spark, sf_dir):
    return _scanned(spark, sf_dir, "asc")


def scan_csv(spark, sf_dir):
    return _scanned(spark, sf_dir, "csv", dx=STEP)


def scan_npy(spark, sf_dir):
    return _scanned(spark, sf_dir, "npy", dx=STEP)


def scan_array(spark, sf_dir):
    """An array in memory, another spacing than its own not asked for."""
    cells, grid = raster(spark, sf_dir)
    return rounded(read_dem(spark, to_array(cells, grid), STEP)[0])


def save_all(spark, sf_dir):
    """The result's writer: all formats at once, and which files there are."""
    cells, grid = raster(spark, sf_dir)
    paths = BedMap(cells.withColumn("bed", F.col("z")), grid).save(scratch.path(spark, "bed"), "all")
    return spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.col("length") > 0).alias("filled"))


def corners(grid: Grid) -> list[list[tuple[float, float]]]:
    return [[(fx * grid.bounds[2], fy * grid.bounds[3]) for fx, fy in ring] for ring in (OUTER, HOLE)]


def _outlined_by_file(spark, sf_dir, kind: str, crs: str | None = None) -> DataFrame:
    cells, grid = raster(spark, sf_dir)
    path = scratch.path(spark, f"outline.{kind}")
    write_bytes(spark, path, encode_outline([corners(grid)], kind, crs))
    return masked(cells, replace(grid, crs="EPSG:25832"), path).select("r", "c", "inside")


def outline_geojson(spark, sf_dir):
    return _outlined_by_file(spark, sf_dir, "geojson", "urn:ogc:def:crs:EPSG::25832")


def outline_shapefile(spark, sf_dir):
    return _outlined_by_file(spark, sf_dir, "shp")


def outline_geopackage(spark, sf_dir):
    return _outlined_by_file(spark, sf_dir, "gpkg", "EPSG:25832")


def outline_rings(spark, sf_dir):
    return _outlined_by_file(spark, sf_dir, "csv")


def outline_array(spark, sf_dir):
    """A mask of the raster's shape: true above zero."""
    cells, grid = raster(spark, sf_dir)
    mask = to_array(cells.withColumn("v", (F.col("r") * 3 + F.col("c") * 5) % 7 - 3), grid, "v")
    return masked(cells, grid, mask).select("r", "c", "inside")


def outline_none(spark, sf_dir):
    """Without an outline all cells with data are inside."""
    cells, grid = raster(spark, sf_dir)
    return masked(cells.withColumn("z", F.when((F.col("r") + F.col("c")) % 4 > 0, F.col("z"))), grid).select("r", "c", "inside")


def scan_survey(spark, sf_dir):
    """Picks of a text file."""
    _, grid = raster(spark, sf_dir)
    got = picks(spark, sf_dir, grid).orderBy("pid").toPandas()
    path = scratch.path(spark, "picks.csv")
    write_bytes(spark, path, ("X,Y,Z_surf,OWTT_ns\n" + "".join(f"{x!r},{y!r},nan,{v!r}\n" for x, y, v in got[["x", "y", "val"]].itertuples(index=False))).encode())
    return rounded(read_survey(spark, path))


def config_merged(spark, sf_dir):
    """A file laid over the defaults, as (section, key, value) of what is plain."""
    return _settings(spark, {"inputs": {"dem_path": "dem.tif", "travel_times_path": "picks.csv"}, "optimization_parameters": {"kc_max": 5.0}, "finalization_parameters": {"smooth_bedrock": True}})


def config_template(spark, sf_dir):
    """The template that is written holds the defaults."""
    return _settings(spark, None)


def _settings(spark, own) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "own.json")
        if own is None:
            config.write_template(path)
        else:
            with open(path, "w", encoding="utf-8") as f:
                json.dump(own, f)
        got = config.load_config(path)
    return spark.createDataFrame([(s, k, json.dumps(v)) for s, part in got.items() for k, v in part.items() if not isinstance(v, dict)], "section string, key string, value string")


def _holds(spark, cases) -> DataFrame:
    """(name, holds): whether a check lets a case pass."""
    def passes(check) -> bool:
        try:
            check()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(name, passes(check)) for name, check in cases], "name string, holds boolean")


def config_required(spark, sf_dir):
    inputs = {"dem": {"dem_path": "a"}, "both": {"dem_path": "a", "survey_data_path": "b"}, "survey": {"survey_data_path": "b"}, "none": {}}
    return _holds(spark, [(n, lambda i=i: config.required(config.merged(config.DEFAULTS, {"inputs": i}))) for n, i in inputs.items()])


def crs_equality(spark, sf_dir):
    utm, wgs = 'PROJCS["ETRS_1989_UTM_Zone_32N",GEOGCS["GCS_ETRS_1989"]]', 'GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]'
    pairs = {"code": ("EPSG:25832", "epsg:25832"), "urn": ("EPSG:25832", "urn:ogc:def:crs:EPSG::25832"), "versioned": ("EPSG:25832", "urn:ogc:def:crs:EPSG:9.9:25832"), "address": ("EPSG:4326", "http://www.opengis.net/def/crs/EPSG/0/4326"),
             "text": ("EPSG:25832", utm), "identifier": ("EPSG:4326", wgs), "crs84": ("urn:ogc:def:crs:OGC:1.3:CRS84", "OGC:CRS84"), "unknown": (None, "EPSG:25832"),
             "other": ("EPSG:25832", "EPSG:25833"), "other text": ("EPSG:32632", utm), "axes": ("EPSG:4326", "CRS84")}
    return _holds(spark, [(n, lambda p=p: same_crs(*p)) for n, p in pairs.items()])


def survey_outside(spark, sf_dir):
    """Picks wholly off the raster and its margin of a tenth are refused."""
    _, grid = raster(spark, sf_dir)
    points = picks(spark, sf_dir, grid).persist()
    moved = lambda dx: points.withColumn("x", F.col("x") + F.lit(float(dx)))
    return _holds(spark, [(n, lambda d=d: migration.check_extent(moved(d), grid)) for n, d in (("at home", 0), ("over the edge", 200), ("in the margin", 270), ("beyond", 280), ("far west", -280))])


def polygon_repair(spark, sf_dir):
    """Rings left, and the area of the outer one, of polygons fit for masking and others."""
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)]
    cases = {"fine": [square, hole], "flat hole": [square, [(2, 2), (4, 2), (3, 2)]], "crossed hole": [square, [(2, 2), (4, 4), (4, 2), (2, 4)]], "short hole": [square, hole[:2]], "empty": [[(0, 0)]]}
    rows = []
    for name, rings in cases.items():
        got = masks.valid_polygons([[np.array(r, float) for r in rings]])
        rows.append((name, len(got[0]) if got else 0, abs(masks._area(got[0][0])) if got else 0.0))
    return spark.createDataFrame(rows, "name string, rings long, area double")


def cutoff_list(spark, sf_dir):
    """Cutoffs by step, none below zero; and by number."""
    rows = [("step", k) for k in cutoffs(2.0, -1.0, 0.25)] + [("number", k) for k in cutoffs(2.0, 0.5, None, 7)]
    return rounded(spark.createDataFrame(rows, "kind string, kc double"))


def survey_routing(spark, sf_dir):
    """Thicknesses stay as they are, times become depths, whether or not anything migrates."""
    cells, grid = raster(spark, sf_dir)
    out = None
    for kind in ("thickness", "ice_thickness", "depth", "one_way_travel_time", "twt"):
        run = Reconstruction(spark, cells, None, STEP, STEP, perform_migration=False, survey_data_type=kind)
        got = run.migrate(picks(spark, sf_dir, grid)).select("pid", F.lit(kind).alias("kind"), "d_mig")
        out = got if out is None else out.union(got)
    return rounded(out)


def final_thickness(spark, sf_dir):
    cells, _ = outlined(spark, sf_dir)
    bed = _bed() + F.lit(45.0) * (F.col("c") % 3 == 1).cast("double")
    return rounded(cells.select("r", "c", fn.final_thickness(F.col("z"), bed, F.col("inside")).alias("thickness")))


def forest_masks(spark, sf_dir):
    """Cells that a forest learns from, and those that it fills."""
    cells, _ = outlined(spark, sf_dir)
    bed = F.when(F.col("r") % 7 == 3, F.col("z") - F.lit(0.1) * (F.col("c") % 3)).when(F.col("r") % 5 > 0, _bed())
    rows = cells.withColumn("bed", bed)
    return rows.select("r", "c", finalize.known_bed().alias("known"), finalize.hole().alias("hole"))


def variogram_gaps(spark, sf_dir):
    """Points with unknown numbers are left out."""
    _, grid = raster(spark, sf_dir)
    k = F.col("pid")
    points = picks(spark, sf_dir, grid).withColumns({"val": F.when(k % 7 == 3, None).when(k % 11 == 5, F.lit(float("nan"))).otherwise(F.col("val")), "x": F.when(k % 13 == 6, None).otherwise(F.col("x"))})
    return rounded(variogram(points, 90.0), 4)


def sweep_points(spark, sf_dir):
    """The points that a sweep judges."""
    _, grid = raster(spark, sf_dir)
    k = F.col("pid")
    points = picks(spark, sf_dir, grid).withColumn("val", F.when(k % 7 == 3, None).when(k % 11 == 5, F.lit(float("nan"))).when(k % 5 == 1, -F.col("val")).otherwise(F.col("val")))
    return rounded(judged(points))


def bss_sweep_frozen(spark, sf_dir):
    """The sweep of a short list, one below zero, all judged by the first one's range."""
    cells, grid = raster(spark, sf_dir)
    return rounded(sweep(cells, picks(spark, sf_dir, grid), grid, [8.0, 4.0, 1.0, 0.0, -1.0], freeze_range=True).select("kc", "mean_variance"), 5)


def smooth_methods(spark, sf_dir):
    """The smoother by name: an even median, and a Gaussian over gaps."""
    cells, grid = raster(spark, sf_dir)
    gaps = cells.withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 3) % 11 > 0, F.col("z")))
    return rounded(smooth(cells, grid, "median", size=4).withColumnRenamed("z", "median").join(smooth(gaps, grid, "gaussian", 1.0).withColumnRenamed("z", "gaussian"), ["r", "c"]))


def reconstruction(spark, sf_dir):
    """The pipeline: picks are migrated, the slope's cutoff chosen, depths kriged, the margin blended."""
    cells, grid = raster(spark, sf_dir)
    outline = masks.inside(cells, rings(spark, grid), grid).select("r", "c", F.col("inside").cast("int").alias("v"))
    run = Reconstruction(spark, cells.withColumn("z", F.col("z") / 20), outline, STEP, STEP)
    run.migrate(picks(spark, sf_dir, grid))
    return rounded(run.finalize(apply_margin_blend=True, min_gap_dist=20.0).cells, 4)


QUERIES = {f.__name__: f for f in (
    terrain_slope, terrain_trig, fft_lowpass, post_fft_lowpass, gaussian_smooth, median_smooth, smooth_methods, variogram_bins, variogram_default_reach, variogram_gaps, variogram_models, variogram_fit,
    bilinear_sample, resample_dem, nearest_fill, mask_polygon_with_hole, mask_boundary, zero_boundary_points, distance_to_margin, margin_blend, eikonal_migration, velocity_sweep,
    survey_units, survey_extent, survey_outside, survey_routing, unmigrated_depth, stress_products, sia_drift_standardized, kriging_system, kriging_ordinary, kriging_universal, kriging_linear, kriging_sia,
    kriging_plausible, kriging_regression, thickness_reconstruct, thickness_stats, final_thickness, sweep_points, cutoff_list, bss_sweep, bss_sweep_frozen, forest_masks, forest_fill, spline_blend,
    scan_geotiff, scan_ascii, scan_csv, scan_npy, scan_array, save_all, outline_geojson, outline_shapefile, outline_geopackage, outline_rings, outline_array, outline_none, scan_survey,
    config_merged, config_template, config_required, crs_equality, polygon_repair, plot_extent, plot_arrows, pseudo_picks,
    facade_slope, facade_interpolate, facade_blend, facade_finalize, facade_migrate, facade_optimize, facade_from_config, reconstruction)}
