"""Margins, gaps and summaries of the reconstructed bed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine_taper
from ..grid import Grid, in_task
from .dense import dual
from .mask import margin_distance
from .terrain import gaussian, slopes

HOLE = 0.1


def _tapered(cells: DataFrame, grid: Grid, width: float | None) -> DataFrame:
    """``cells`` (r, c, z, inside, thickness) with the thickness tapered to the margin and ``bed``."""
    wide = 3 * grid.cell if not width or width <= 0 else float(width)
    inside = F.coalesce(F.col("inside"), F.lit(False))
    d = margin_distance(cells, grid)
    rows = cells.withColumn("thickness", F.when(inside, F.col("thickness")).otherwise(0.0)).join(d, ["r", "c"]).withColumn("weight", cosine_taper(F.col("distance"), wide))
    rows = rows.withColumn("t", F.col("thickness") * F.col("weight"))
    soft = gaussian(rows, grid, 1.0, "t").withColumnRenamed("t", "soft")
    rows = rows.join(soft, ["r", "c"])
    final = F.when(~inside, 0.0).when(F.col("weight") > 0.8, F.col("thickness")).otherwise(F.col("soft"))
    return rows.select("r", "c", "z", "inside", final.alias("thickness"), (F.col("z") - final).alias("bed"))


def blend_margin(cells: DataFrame, grid: Grid, width: float | None = None) -> DataFrame:
    """(r, c, z, inside, thickness, bed) from cells with a ``bed``: thickness falls to zero over ``width`` (three cells unless given)."""
    return _tapered(cells.select("r", "c", "z", "inside", (F.col("z") - F.col("bed")).alias("thickness")), grid, width)


def thin_plate(x, y, v, smoothing: float = 0.1):
    """Weights and plane of a thin-plate spline through (x, y, v), in scaled places."""
    p = np.column_stack([x, y])
    mid, scale = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-12) / 2
    q = (p - mid) / scale
    r2 = ((q[:, None] - q) ** 2).sum(2) * scale * scale
    n = len(p)
    k = np.zeros((n + 3, n + 3))
    k[:n, :n] = np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0) + smoothing * np.eye(n)
    k[:n, n:] = np.column_stack([np.ones(n), q])
    k[n:, :n] = k[:n, n:].T
    w = np.linalg.lstsq(k, np.append(v, np.zeros(3)), rcond=None)[0]
    return p, w, mid, scale


def _bent(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)


def _apart(x, y, u, v) -> np.ndarray:
    return (x[:, None] - u) ** 2 + (y[:, None] - v) ** 2


def thin_plate_tiled(spark, x, y, v, smoothing: float = 0.1):
    """What ``thin_plate`` gives, for any number of points that don't lie on a line.

    Less what planes through three of the points make of it, and more their product, the spline's matrix is definite; planes
    don't change the weights, whose products with planes vanish, and the plane is put right afterwards.
    """
    p = np.column_stack([x, y])
    mid, scale = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-12) / 2
    plane = np.column_stack([np.ones(len(x)), (p - mid) / scale])
    first = int(((p - mid) ** 2).sum(1).argmax())
    second = int(((p - p[first]) ** 2).sum(1).argmax())
    along = p[second] - p[first]
    third = int(np.abs((p[:, 0] - p[first, 0]) * along[1] - (p[:, 1] - p[first, 1]) * along[0]).argmax())
    held = [first, second, third]
    turn = np.linalg.inv(plane[held])
    part = plane @ turn
    to = _bent(_apart(x, y, x[held], y[held]))
    between = to[held]
    own = np.abs(between).max()

    def entries(rows, columns):
        k = _bent(_apart(x[rows], y[rows], x[columns], y[columns])) - part[rows] @ to[columns].T - to[rows] @ part[columns].T + part[rows] @ (between + own * np.eye(3)) @ part[columns].T
        if rows == columns:
            k += smoothing * np.eye(len(k))
        return k

    got = dual(spark, entries, plane, v)
    return p, np.append(got.weights, got.trend - turn @ (to.T @ got.weights)), mid, scale


def blend_points(points: DataFrame, cells: DataFrame, grid: Grid, width: float | None = None, most: int = 5000) -> DataFrame:
    """The same from points (x, y, depth): a thin-plate spline gives the thickness of every cell, blocks of cells at a time. Up to
    ``most`` points one task solves it, that of more in blocks by many tasks."""
    spark = cells.sparkSession
    got = points.select("x", "y", "depth").na.drop().orderBy("x", "y", "depth").toPandas()
    x, y, v = (got[k].to_numpy(float) for k in ("x", "y", "depth"))
    p, w, mid, scale = in_task(spark, lambda: thin_plate(x, y, v)) if len(got) <= most else thin_plate_tiled(spark, x, y, v)
    shared = spark.sparkContext.broadcast((p, w))  # three numbers a point
    at = cells.select("r", "c", grid.x(F.col("c")).alias("x"), grid.y(F.col("r")).alias("y"))
    block = max(min(2000, 10_000_000 // max(len(p), 1)), 1)
    if len(got) > most:
        at = at.repartition(-(-grid.nrows * grid.ncols // block), "r", "c")  # much work a cell

    def run(batches):
        p, w = shared.value
        for pdf in batches:
            for s in range(0, len(pdf), block):
                b = pdf.iloc[s:s + block]
                xy = b[["x", "y"]].to_numpy()
                k = _bent(_apart(xy[:, 0], xy[:, 1], p[:, 0], p[:, 1]))
                yield pd.DataFrame({"r": b["r"], "c": b["c"], "thickness": np.maximum(k @ w[:-3] + np.column_stack([np.ones(len(b)), (xy - mid) / scale]) @ w[-3:], 0)})

    thick = at.mapInPandas(run, "r long, c long, thickness double")
    return _tapered(cells.select("r", "c", "z", "inside").join(thick, ["r", "c"]), grid, width)


def known_bed() -> Column:
    """Cells that a forest may learn from: inside, with a bed and some thickness."""
    return F.coalesce(F.col("inside") & F.col("bed").isNotNull() & F.col("z").isNotNull() & (F.col("z") - F.col("bed") > HOLE), F.lit(False))


def hole() -> Column:
    """Cells inside without thickness."""
    return F.coalesce(F.col("inside") & F.col("z").isNotNull() & (F.col("z") - F.col("bed") <= HOLE), F.lit(False))


def fill_holes(cells: DataFrame, grid: Grid, trees: int = 100, depth: int = 15) -> DataFrame:
    """(r, c, z, inside, bed): cells inside without thickness get a forest's prediction from place, elevation and slope, no
    higher than the surface. With fewer than ten cells to learn from nothing is filled."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = slopes(cells, grid).select("r", "c", "z", "inside", "bed", (F.col("c") * F.lit(grid.dx)).alias("fx"), (F.col("r") * F.lit(grid.dy)).alias("fy"), F.coalesce("slope_rad", F.lit(0.0)).alias("fs"))
    fine = rows.where(known_bed())
    if fine.limit(10).count() < 10:
        return cells.select("r", "c", "z", "inside", "bed")
    features = VectorAssembler(inputCols=["fx", "fy", "z", "fs"], outputCol="features", handleInvalid="skip")
    forest = RandomForestRegressor(labelCol="bed", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=42).fit(features.transform(fine))
    filled = forest.transform(features.transform(rows.where(hole()))).select("r", "c", F.col("prediction").alias("guess"))
    return rows.join(filled, ["r", "c"], "left").select("r", "c", "z", "inside", F.least(F.coalesce("guess", "bed"), "z").alias("bed"))


def summary(cells: DataFrame) -> DataFrame:
    """(mean_thickness, max_thickness, mean_uncertainty, cells): inside, or of all cells where none is."""
    some = F.coalesce(F.max(F.col("inside").cast("int")), F.lit(0)) == 1
    masked = lambda f, k: F.when(some, f(F.when(F.col("inside"), F.col(k)))).otherwise(f(F.col(k)))
    return cells.agg(masked(F.avg, "thickness").alias("mean_thickness"), masked(F.max, "thickness").alias("max_thickness"), masked(F.avg, "uncertainty").alias("mean_uncertainty"), F.count("*").alias("cells"))
