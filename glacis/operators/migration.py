"""Ray migration of survey picks, and what is done with picks before and without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import displacement, is_thickness, one_way
from ..grid import Grid
from .sampling import bilinear
from .terrain import gradient

VELOCITY = 0.16


def check_extent(points: DataFrame, grid: Grid, what: str = "survey") -> None:
    """Raises where the points lie wholly outside the raster and a margin of a tenth of it (1 m at least)."""
    e = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if e[0] is None:
        return
    minx, miny, maxx, maxy = grid.bounds
    mx, my = max(0.1 * (maxx - minx), 1.0), max(0.1 * (maxy - miny), 1.0)
    if e[1] < minx - mx or e[0] > maxx + mx or e[3] < miny - my or e[2] > maxy + my:
        raise ValueError(f"the {what} lies outside of the raster: x {e[0]} to {e[1]}, y {e[2]} to {e[3]}, raster {grid.bounds}")


def prepare(points: DataFrame, cells: DataFrame, grid: Grid, kind: str = "one_way_travel_time") -> DataFrame:
    """(pid, x, y, z_surf, val): surface elevations are sampled where picks come without; two-way times are halved."""
    if "z_surf" not in points.columns:
        z = bilinear(points, cells, grid, ["z"]).withColumnRenamed("z", "z_surf")
        points = points.join(z, "pid", "left")
    return points.select("pid", "x", "y", "z_surf", one_way(F.col("val"), kind).alias("val"))


def unmigrated(points: DataFrame, kind: str, velocity: float = VELOCITY, times_above: float = 15.0) -> DataFrame:
    """Picks at their own place: thickness as it is; times turned to depths if the largest exceeds ``times_above``."""
    top = None if is_thickness(kind) else points.agg(F.max("val")).first()[0]
    depth = F.col("val") * F.lit(velocity) if top is not None and top > times_above else F.col("val")
    return points.select("pid", F.col("x").alias("x_mig"), F.col("y").alias("y_mig"), F.col("z_surf").alias("z_surf_mig"), depth.alias("d_mig"))


def rays(cells: DataFrame, grid: Grid, velocity: float = VELOCITY) -> DataFrame:
    """(r, c, z, dx, dy, dz) from cells (r, c, z, t): the displacement of a reflection at each cell."""
    out = gradient(gradient(cells, grid, "t", "tx", "ty"), grid, "z", "zx", "zy")
    dx, dy, dz = displacement(*[F.col(k) for k in ("t", "tx", "ty", "zx", "zy")], velocity)
    return out.select("r", "c", "z", dx.alias("dx"), dy.alias("dy"), dz.alias("dz"))


def migrate(points: DataFrame, cells: DataFrame, grid: Grid, velocity: float = VELOCITY) -> DataFrame:
    """(pid, x_mig, y_mig, z_surf_mig, d_mig) of picks (pid, x, y, z_surf, val) by a travel-time field ``t`` on the cells.

    Picks outside of the field stay in place; where no depth comes out, it is time times velocity.
    """
    field = rays(cells, grid, velocity)
    moved = points.join(bilinear(points, field, grid, ["dx", "dy", "dz"]), "pid", "left")
    zero = F.lit(0.0)
    depth = F.greatest(-F.coalesce("dz", zero), zero)
    moved = moved.select("pid", "z_surf", (F.col("x") + F.coalesce("dx", zero)).alias("x_mig"), (F.col("y") + F.coalesce("dy", zero)).alias("y_mig"),
                         F.when(depth > 0, depth).otherwise(F.col("val") * F.lit(velocity)).alias("d_mig"))
    z = bilinear(moved, cells, grid, ["z"], x="x_mig", y="y_mig")
    return moved.join(z, "pid", "left").select("pid", "x_mig", "y_mig", F.coalesce("z", "z_surf").alias("z_surf_mig"), "d_mig")


def velocities(points: DataFrame, cells: DataFrame, grid: Grid, values: list[float]) -> DataFrame:
    """The migration at each of several velocities, with a column ``velocity``: what an operator would try one by one."""
    out = None
    for v in values:
        one = migrate(points, cells, grid, v).withColumn("velocity", F.lit(float(v)))
        out = one if out is None else out.unionByName(one)
    return out
