"""Values of grids at points, and grids at other spacings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, index, resized
from .terrain import BAND


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid, values: list[str], key: str = "pid", x: str = "x", y: str = "y") -> DataFrame:
    """(key, values): bilinear between cell centres; null outside of them or next to a null.

    Each point goes to its four cells by an equal join; points come with a unique ``key``.
    """
    fx = (F.col(x) - F.lit(grid.bounds[0])) / F.lit(float(grid.dx)) - F.lit(0.5)
    fy = (F.col(y) - F.lit(grid.bounds[1])) / F.lit(float(grid.dy)) - F.lit(0.5)
    at = points.select(F.col(key).alias("k_"), fx.alias("fx"), fy.alias("fy"))
    at = at.where((F.col("fx") >= 0) & (F.col("fx") <= grid.ncols - 1) & (F.col("fy") >= 0) & (F.col("fy") <= grid.nrows - 1))
    at = at.withColumns({"c0": F.least(F.floor("fx"), F.lit(max(grid.ncols - 2, 0))), "r0": F.least(F.floor("fy"), F.lit(max(grid.nrows - 2, 0)))})
    at = at.withColumns({"u": F.col("fx") - F.col("c0"), "v": F.col("fy") - F.col("r0")})
    one = lambda r, c, w: F.struct((F.col("r0") + r).cast("long").alias("r"), (F.col("c0") + c).cast("long").alias("c"), w.alias("w"))
    u, v = F.col("u"), F.col("v")
    corners = F.array(one(0, 0, (1 - u) * (1 - v)), one(0, 1, u * (1 - v)), one(1, 0, (1 - u) * v), one(1, 1, u * v))
    four = at.select("k_", F.explode(corners).alias("q")).where("q.w > 0").select("k_", "q.r", "q.c", "q.w")
    met = four.join(cells.select("r", "c", *values), ["r", "c"])
    whole = F.count("*")
    sums = [F.when((F.count(v_) == whole) & (F.abs(F.sum("w") - 1) < 1e-9), F.sum(F.col("w") * F.col(v_))).alias(v_) for v_ in values]
    return met.groupBy(F.col("k_").alias(key)).agg(*sums)


def nearest(cells: DataFrame, value: str = "z") -> DataFrame:
    """Nulls of ``value`` replaced by the nearest cell's, of equals the first by (r, c): (r, c, value).

    Two passes over bands of lines carry the place of the nearest known cell: that of the same column first, then
    the best of those of the row, outwards until none can be nearer.
    """
    top = cells.agg(F.max("r").alias("m"), F.max("c").alias("n"), F.max(F.col(value).isNull().cast("int")).alias("gaps"), F.max(F.col(value).isNotNull().cast("int")).alias("some")).first()
    if not top["gaps"] or not top["some"]:
        return cells.select("r", "c", value)
    rows, columns = top["m"] + 1, top["n"] + 1

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, at = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        known = np.zeros((len(lines), rows), bool)
        known[at, pdf["r"].to_numpy()] = pdf["known"].to_numpy()
        place = np.arange(rows)
        back = np.maximum.accumulate(np.where(known, place, -4 * rows), axis=1)
        ahead = np.minimum.accumulate(np.where(known, place, 8 * rows)[:, ::-1], axis=1)[:, ::-1]
        near = np.where(place - back <= ahead - place, back, ahead)
        fine = np.repeat(known.any(1), rows)
        return pd.DataFrame({"r": np.tile(place, len(lines))[fine], "c": np.repeat(lines, rows)[fine], "near": near.ravel()[fine]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, at = np.unique(pdf["r"].to_numpy(), return_inverse=True)
        near = np.full((len(lines), columns), -1, np.int64)
        near[at, pdf["c"].to_numpy()] = pdf["near"].to_numpy()
        far = np.where(near >= 0, (near - lines[:, None]) ** 2, 1 << 60)
        best, row, column = far.copy(), np.where(near >= 0, near, rows), np.tile(np.arange(columns), (len(lines), 1))
        for k in range(1, columns):
            if k * k > best.max():
                break
            for to, of in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):  # the cell to the left, then that to the right
                d, r = far[:, of] + k * k, near[:, of]
                c = np.broadcast_to(np.arange(columns)[of], d.shape)
                b, x, y = best[:, to], row[:, to], column[:, to]
                better = (near[:, of] >= 0) & ((d < b) | (d == b) & ((r < x) | (r == x) & (c < y)))
                b[better], x[better], y[better] = d[better], r[better], c[better]
        return pd.DataFrame({"r": np.repeat(lines, columns), "c": np.tile(np.arange(columns), len(lines)), "kr": row.ravel(), "kc": column.ravel()})

    known = cells.select("r", "c", F.col(value).isNotNull().alias("known"))
    column = known.groupBy(F.expr(f"c div {BAND}").alias("band")).applyInPandas(lambda pdf: down(pdf), "r long, c long, near long")
    place = column.groupBy(F.expr(f"r div {BAND}").alias("band")).applyInPandas(lambda pdf: across(pdf), "r long, c long, kr long, kc long")
    gaps = cells.where(F.col(value).isNull()).select("r", "c").join(place, ["r", "c"])
    given = cells.where(F.col(value).isNotNull()).select(F.col("r").alias("kr"), F.col("c").alias("kc"), value)
    return cells.where(F.col(value).isNotNull()).select("r", "c", value).union(gaps.join(given, ["kr", "kc"]).select("r", "c", value))


def resample(cells: DataFrame, grid: Grid, dx: float, dy: float, value: str = "z") -> tuple[DataFrame, Grid]:
    """The grid at another spacing: bilinear at the new centres, nearest where those lie outside the old ones."""
    if abs(dx - grid.dx) < 1e-9 and abs(dy - grid.dy) < 1e-9:
        return cells.select("r", "c", value), grid
    to = resized(grid, dx, dy)
    new = index(cells.sparkSession, to).withColumns({"x": to.x(F.col("c")), "y": to.y(F.col("r")), "pid": F.col("r") * F.lit(to.ncols) + F.col("c")})
    got = bilinear(new, cells, grid, [value])
    both = new.join(got, "pid", "left").select("r", "c", value)
    return nearest(both, value), to
