"""Kriging: a small dense system in a task, estimates for all cells on the executors.

The estimate is a sum over samples with dual weights, so that cells need no system of their own. The
variance takes the inverse matrix and is only computed when asked for. A system of many samples is factored in
blocks by many tasks, and its inverse is never formed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ice_drift, rise
from ..grid import Grid, in_task
from .dense import Factor, dual, inverse
from .mask import zero_points
from .sampling import bilinear
from .terrain import slopes
from .variogram import hull

#: Samples of a system that one task solves and whose inverse, 200 MB, is broadcast. Those of more are factored in blocks.
MOST = 5000
BLOCK = 2000


def gamma(h: np.ndarray, model: str, a: float, sill: float, nugget: float = 0.0) -> np.ndarray:
    return np.where(h == 0, 0.0, nugget + sill * rise(h / max(a, 1e-6), model, np.exp, lambda q: np.minimum(q, 1)))


def powers(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Drift columns: constant, regional linear or quadratic."""
    one = np.ones_like(x)
    if kind == "linear":
        return np.column_stack([one, x, y])
    if kind == "quadratic":
        return np.column_stack([one, x, y, x**2, y**2, x * y])
    return one[:, None]


@dataclass
class System:
    """A solved kriging system; places are relative to ``origin`` and, for drifts, scaled by ``extent``."""

    x: np.ndarray
    y: np.ndarray
    weights: np.ndarray
    inverse: np.ndarray | None
    drift: str
    external: bool
    model: str
    range: float
    sill: float
    nugget: float
    origin: tuple[float, float]
    extent: float

    def _gamma(self, x, y, part=slice(None)):
        return gamma(np.hypot(x[:, None] - self.x[part], y[:, None] - self.y[part]), self.model, self.range, self.sill, self.nugget)

    def _drift(self, x, y, u):
        f = powers(x / self.extent, y / self.extent, self.drift)
        return np.column_stack([f, u]) if self.external else f

    def rows(self) -> int:
        """Cells of a block: ten million pairs of cell and sample, or two thousand cells."""
        return max(min(BLOCK, BLOCK * MOST // len(self.x)), 1)

    def estimate(self, x, y, u=None, variance: bool = False, first_multiplier_only: bool = False):
        x, y = x - self.origin[0], y - self.origin[1]
        g, f = self._gamma(x, y), self._drift(x, y, u)
        right = np.column_stack([g, f])
        z = right @ self.weights
        if not variance:
            return z, None
        w = right @ self.inverse.T
        n = g.shape[1]
        var = (w[:, :n] * g).sum(1) + (w[:, n] if first_multiplier_only else (w[:, n:] * f).sum(1))
        return z, np.maximum(var, 0)


@dataclass
class Tiled(System):
    """A system in blocks, of covariances: sill and nugget less semivariance, which has the same weights and multipliers."""

    factor: Factor
    bent: np.ndarray
    spread: np.ndarray

    def estimate(self, x, y, u=None, variance: bool = False, first_multiplier_only: bool = False):
        x, y = x - self.origin[0], y - self.origin[1]
        f, n, top = self._drift(x, y, u), len(self.x), self.sill + self.nugget
        z, c = f @ self.weights[n:], np.empty((n, len(x))) if variance else None
        for part in self.factor.parts:
            g = self._gamma(x, y, part)
            z += g @ self.weights[part]
            if variance:
                c[part] = (top - g).T
        if not variance:
            return z, None
        off = f - c.T @ self.bent
        multipliers = off @ self.spread.T
        var = top - self.factor.squares(c)
        var += (off * multipliers).sum(1) if not first_multiplier_only else multipliers[:, 0] - ((f - off) * multipliers).sum(1)
        return z, np.maximum(var, 0)


def widest(x: np.ndarray, y: np.ndarray) -> float:
    """The largest distance of two places: that of two corners of their hull."""
    corners = hull(np.column_stack([x, y]))
    return max((float(np.hypot(*(corners - p).T).max()) for p in corners), default=0.0)


def fitted(x, y, z) -> tuple[float, float, float, float]:
    """(range, sill, nugget, largest distance) of samples: 0.6 of the largest distance, the variance of the values and 0."""
    x, y, z = (np.asarray(k, float) for k in (x, y, z))
    top = widest(x, y) if len(x) > 1 else 100.0
    return max(0.6 * top, 1.0), (float(np.var(z)) if len(x) > 1 else 1.0) or 1.0, 0.0, top


def solve_tiled(spark, x, y, z, drift: str = "constant", external=None, model: str = "spherical", origin=(0.0, 0.0), parameters=None) -> Tiled:
    """What ``solve`` gives, for any number of samples."""
    x, y, z = np.asarray(x, float) - origin[0], np.asarray(y, float) - origin[1], np.asarray(z, float)
    *found, top = fitted(x, y, z)
    a, sill, nugget = parameters or found
    extent = max(top, 1.0)
    f = powers(x / extent, y / extent, drift)
    if external is not None:
        f = np.column_stack([f, external])

    def covariances(rows, columns):
        c = sill + nugget - gamma(np.hypot(x[rows][:, None] - x[columns], y[rows][:, None] - y[columns]), model, a, sill, nugget)
        if rows == columns:
            c -= 1e-8 * np.eye(len(c))
        return c

    got = dual(spark, covariances, f, z)
    return Tiled(x, y, np.append(-got.weights, got.trend), None, drift, external is not None, model, a, sill, nugget, tuple(origin), extent, got.factor, got.bent, got.spread)


def solved(spark, x, y, z, *how) -> System:
    """The system of samples: one task's up to MOST of them, beyond that one in blocks. ``how``: what ``solve`` takes."""
    if len(x) <= MOST:
        return in_task(spark, lambda: solve(x, y, z, *how))
    return solve_tiled(spark, x, y, z, *how)


def solve(x, y, z, drift: str = "constant", external=None, model: str = "spherical", origin=(0.0, 0.0), parameters=None) -> System:
    """``external`` is the drift at the samples; ``parameters`` (range, sill, nugget) default to 0.6 of
    the largest distance, the variance of the values and 0."""
    x, y, z = np.asarray(x, float) - origin[0], np.asarray(y, float) - origin[1], np.asarray(z, float)
    n = len(x)
    h = np.hypot(x[:, None] - x, y[:, None] - y)
    *found, top = fitted(x, y, z)
    a, sill, nugget = parameters or found
    extent = max(top, 1.0)
    f = powers(x / extent, y / extent, drift)
    if external is not None:
        f = np.column_stack([f, external])
    p = f.shape[1]
    k = np.zeros((n + p, n + p))
    k[:n, :n] = gamma(h, model, a, sill, nugget) + 1e-8 * np.eye(n)
    k[:n, n:], k[n:, :n] = f, f.T
    turned = inverse(k)
    return System(x, y, turned.T @ np.append(z, np.zeros(p)), turned, drift, external is not None, model, a, sill, nugget, tuple(origin), extent)


def predict(cells: DataFrame, grid: Grid, system: System, centers: bool = False, variance: bool = True, external: str | None = None, legacy_variance: bool = False) -> DataFrame:
    """(r, c, z_hat, var): estimates in blocks of cells; ``var`` is null when not asked for."""
    shared = cells.sparkSession.sparkContext.broadcast(system if variance else replace(system, inverse=None))  # MOST bounds the inverse
    place = (grid.x, grid.y) if centers else (grid.edge_x, grid.edge_y)
    at = cells.select("r", "c", place[0](F.col("c")).alias("x"), place[1](F.col("r")).alias("y"), (F.col(external) if external else F.lit(0.0)).alias("u"))
    block = system.rows()
    if len(system.x) > MOST:
        at = at.repartition(-(-grid.nrows * grid.ncols // block), "r", "c")  # much work a cell

    def run(batches):
        own = shared.value
        for pdf in batches:
            for s in range(0, len(pdf), block):
                b = pdf.iloc[s:s + block]
                z, var = own.estimate(b["x"].to_numpy(), b["y"].to_numpy(), b["u"].to_numpy() if own.external else None, variance, legacy_variance)
                yield pd.DataFrame({"r": b["r"], "c": b["c"], "z_hat": z, "var": np.nan if var is None else var})

    return at.mapInPandas(run, "r long, c long, z_hat double, var double").withColumn("var", F.nanvl("var", F.lit(None)))


def plausible(estimates: DataFrame, values) -> bool:
    """Whether all estimates are finite and none is far off the samples' values: within their mean and twenty times their
    span (1 at least), or ten thousand, whichever is wider."""
    values = np.asarray(values, float)
    if not len(values):
        return True
    mean, span = float(values.mean()), max(float(np.ptp(values)), 1.0)
    fine = F.coalesce(F.col("z_hat").between(min(mean - 20 * span, -1e4), max(mean + 20 * span, 1e4)), F.lit(False))
    row = estimates.agg(F.count("*").alias("n"), F.sum(fine.cast("long")).alias("fine")).first()
    return row["n"] == (row["fine"] or 0)


def _checked(draft, values, spare) -> DataFrame:
    """``draft()`` if plausible, else what ``spare()`` gives, which has no drift to run away with."""
    got = draft().persist()
    return got if plausible(got, values) else spare()


def drift_column(cells: DataFrame, grid: Grid, sine: str | None = None) -> DataFrame:
    """(r, c, u): the inverse sine of the slope, less its mean, by its deviation. Without ``sine`` the slope is that of ``z``."""
    if sine is None:
        cells, sine = slopes(cells, grid), "sin_slope"
    u = cells.select("r", "c", ice_drift(F.col(sine)).alias("u"))
    m = u.agg(F.avg("u").alias("m"), F.stddev_pop("u").alias("s")).first()
    return u.select("r", "c", ((F.col("u") - F.lit(m["m"] or 0.0)) / F.lit(max(m["s"] or 0.0, 1e-6))).alias("u"))


def _method(name: str) -> str:
    name = name.lower().replace("_kriging", "").strip()
    return "sia" if name in ("sia_thickness", "sia", "sia_drift") else name


def krige(points: DataFrame, cells: DataFrame, grid: Grid, method: str = "universal", model: str = "spherical", drift_terms=None, sine: str | None = None,
          mask: str | None = None, zero_boundary: bool = False, centers: bool = False, variance: bool = True, legacy_variance: bool = False, parameters=None) -> DataFrame:
    """(r, c, z_hat, var) from samples (x, y, val).

    Methods: ``ordinary``; ``universal`` with the drift of ``drift_terms`` (``quadratic`` unless ``regional_linear`` or
    ``sia_thickness``); ``sia`` with the inverse slope as drift; ``regression``, a forest on (x, y, z) and
    ordinary kriging of what it leaves. The method decides; drift terms only refine ``universal``.
    Fewer than four samples are kriged without drift; none give zeros. Samples with unknown numbers are left out. Estimates
    with a drift that aren't plausible are replaced by those of ordinary kriging.
    """
    kind = _method(method)
    if kind not in ("ordinary", "universal", "sia", "regression"):
        raise ValueError(f"unknown kriging method {method!r}")
    terms = [t.lower() for t in (drift_terms or [])]
    if kind == "universal" and "sia_thickness" in terms:
        kind = "sia"
    samples = points.select("x", "y", "val")
    if zero_boundary and mask:
        samples = samples.unionByName(zero_points(cells, grid, mask))
    samples = samples.where("x is not null and y is not null and val is not null and not isnan(x) and not isnan(y) and not isnan(val)")
    got = samples.orderBy("x", "y", "val").toPandas()
    if not len(got):
        return cells.select("r", "c", F.lit(0.0).alias("z_hat"), F.lit(0.0).alias("var"))
    x, y, v = got["x"].to_numpy(), got["y"].to_numpy(), got["val"].to_numpy()
    origin = (grid.bounds[0], grid.bounds[1]) if not centers else (grid.bounds[0] + grid.dx / 2, grid.bounds[1] + grid.dy / 2)
    common = {"centers": centers, "variance": variance, "legacy_variance": legacy_variance}

    def plain():
        return predict(cells, grid, solved(cells.sparkSession, x, y, v, "constant", None, model, origin, parameters), **common)

    if kind == "regression":
        return _regression(got, cells, grid, model, origin, common, parameters)
    if kind == "sia" and len(got) >= 4:
        u = drift_column(cells, grid, sine).persist()
        spark = cells.sparkSession
        spots = spark.createDataFrame(got.reset_index(names="pid")[["pid", "x", "y"]])
        at = bilinear(spots, u, grid, ["u"]).toPandas().set_index("pid")["u"].reindex(range(len(got))).fillna(0.0).to_numpy(float)
        return _checked(lambda: predict(u, grid, solved(spark, x, y, v, "constant", at, model, origin, parameters), external="u", **common), v, plain)
    drift = "constant"
    if kind == "universal" and len(got) >= 4:
        drift = "linear" if "regional_linear" in terms and "quadratic" not in terms else "quadratic"
    if drift == "constant":
        return plain()
    return _checked(lambda: predict(cells, grid, solved(cells.sparkSession, x, y, v, drift, None, model, origin, parameters), **common), v, plain)


def _regression(got: pd.DataFrame, cells: DataFrame, grid: Grid, model: str, origin, common: dict, parameters) -> DataFrame:
    """Forest on place and elevation, then ordinary kriging of the residuals; the variance is a fifth of the values'."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    spark = cells.sparkSession
    spots = spark.createDataFrame(got.reset_index(names="pid"))
    z = bilinear(spots, cells, grid, ["z"])
    mean = cells.agg(F.avg("z")).first()[0] or 0.0
    spots = spots.join(z, "pid", "left").withColumn("z", F.coalesce("z", F.lit(mean)))
    features = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features")
    forest = RandomForestRegressor(labelCol="val", numTrees=100, maxDepth=15, featureSubsetStrategy="all", seed=42).fit(features.transform(spots))
    misses = forest.transform(features.transform(spots)).select("x", "y", (F.col("val") - F.col("prediction")).alias("left")).orderBy("x", "y", "left").toPandas()
    system = solved(spark, *(misses[k].to_numpy() for k in ("x", "y", "left")), "constant", None, model, origin, parameters)
    rest = predict(cells, grid, system, common["centers"], False)
    place = (grid.x, grid.y) if common["centers"] else (grid.edge_x, grid.edge_y)
    at = cells.select("r", "c", place[0](F.col("c")).alias("x"), place[1](F.col("r")).alias("y"), F.coalesce("z", F.lit(mean)).alias("z"))
    trend = forest.transform(features.transform(at)).select("r", "c", "prediction")
    var = 0.2 * float(np.var(got["val"]))
    return trend.join(rest, ["r", "c"]).select("r", "c", (F.col("prediction") + F.col("z_hat")).alias("z_hat"), F.lit(var).alias("var"))
