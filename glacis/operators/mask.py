"""Outlines and masks: rings, cells inside, boundaries, distances to the margin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from .terrain import along


def edges(vertices: DataFrame) -> DataFrame:
    """(polygon, ring_id, outer, x0, y0, x1, y1) of rings given as ([polygon,] ring_id, seq, x, y); a polygon's first ring is its outer
    one; rings of fewer than three vertices are left out."""
    if "polygon" not in vertices.columns:
        vertices = vertices.withColumn("polygon", F.lit(0))
    w = Window.partitionBy("polygon", "ring_id")
    ordered = w.orderBy("seq")
    first = vertices.groupBy("polygon").agg(F.min("ring_id").alias("first"))
    out = vertices.select(
        "polygon", "ring_id", F.count("*").over(w).alias("n"), F.col("x").alias("x0"), F.col("y").alias("y0"),
        F.coalesce(F.lead("x").over(ordered), F.first("x").over(ordered)).alias("x1"), F.coalesce(F.lead("y").over(ordered), F.first("y").over(ordered)).alias("y1"))
    return out.where("n >= 3").join(first, "polygon").withColumn("outer", F.col("ring_id") == F.col("first")).drop("n", "first")


def inside(cells: DataFrame, vertices: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` with ``inside``: in the outer ring of a polygon and in none of its holes.

    An edge meets only the rows of cells that it crosses, and a cell only the crossings of its row, by an
    equal join; an odd number to the right is inside. All polygons take one pass.
    """
    top = F.greatest("y0", "y1")
    low = F.least("y0", "y1")
    row = lambda y: (y - F.lit(grid.bounds[1])) / F.lit(float(grid.dy)) - F.lit(0.5)
    first = F.greatest(F.ceil(row(low)), F.lit(0)).cast("long")
    last = F.least(F.ceil(row(top)) - 1, F.lit(grid.nrows - 1)).cast("long")
    e = edges(vertices).where("y0 <> y1").withColumns({"a": first, "b": last}).where("a <= b")
    y = grid.y(F.col("r"))
    crossings = e.withColumn("r", F.explode(F.sequence("a", "b"))).select("polygon", "ring_id", "outer", "r", (F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("cross"))
    x = grid.x(F.col("c"))
    hit = cells.select("r", "c").join(crossings, "r").where(F.col("cross") > x).groupBy("r", "c", "polygon", "ring_id", "outer").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    found = hit.groupBy("r", "c", "polygon").agg(F.bool_and("outer").alias("in_")).groupBy("r", "c").agg(F.bool_or("in_").alias("in_"))
    return cells.join(found, ["r", "c"], "left").withColumn("inside", F.coalesce("in_", F.lit(False))).drop("in_")


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def _crosses_itself(ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    n = len(ring)
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        p, q, c, d = a[i][None], b[i][None], a[j], b[j]
        if ((side(p, q, c) * side(p, q, d) < 0) & (side(c, d, p) * side(c, d, q) < 0)).any():
            return True
    return False


def valid_polygons(polygons: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Polygons (outer ring, holes) fit for masking: a polygon whose rings cross themselves, and one with a hole without
    area or crossing itself, is reduced to its outer ring; empty ones are left out."""
    out = []
    for rings in polygons:
        rings = [np.asarray(r, float) for r in rings if r is not None and len(r) >= 3]
        if not rings:
            continue
        bad = _crosses_itself(rings[0]) or any(abs(_area(h)) <= 0 or _crosses_itself(h) for h in rings[1:])
        out.append(rings[:1] if bad else rings)
    return out


def eroded(cells: DataFrame, grid: Grid, mask: str = "inside") -> DataFrame:
    """``cells`` with ``eroded`` and ``boundary``: a cell stays if its four neighbours are inside; beyond the array nothing is."""
    across, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    m = F.coalesce(F.col(mask), F.lit(False))
    rows = cells.withColumn("a_", m & F.lag(mask, 1, False).over(across) & F.lead(mask, 1, False).over(across))
    out = rows.withColumn("eroded", F.col("a_") & F.lag(mask, 1, False).over(down) & F.lead(mask, 1, False).over(down)).drop("a_")
    return out.withColumn("boundary", m & ~F.col("eroded"))


def zero_points(cells: DataFrame, grid: Grid, mask: str = "inside", most: int = 100) -> DataFrame:
    """Points of value 0 on the mask's boundary, every n-th in row order so that about ``most`` remain: (x, y, val).

    Numbers follow from counts by row and a window inside each row, so no task orders the whole boundary.
    """
    rim = eroded(cells, grid, mask).where("boundary").select("r", "c")
    counts = rim.groupBy("r").count().orderBy("r").toPandas()  # one count a row of the grid
    if not len(counts):
        return cells.sparkSession.createDataFrame([], "x double, y double, val double")
    counts["first"] = counts["count"].cumsum() - counts["count"]
    stride = max(1, int(counts["count"].sum()) // most)
    first = cells.sparkSession.createDataFrame(counts[["r", "first"]], "r long, first long")
    numbered = rim.join(first, "r").withColumn("i", F.col("first") + F.row_number().over(Window.partitionBy("r").orderBy("c")) - 1)
    return numbered.where(F.col("i") % stride == 0).select(grid.edge_x(F.col("c")).alias("x"), grid.edge_y(F.col("r")).alias("y"), F.lit(0.0).alias("val"))


def _down(block: np.ndarray) -> np.ndarray:
    """Squared distance along the line to the nearest cell outside (a zero)."""
    n = block.shape[1]
    at = np.arange(n)
    back = np.maximum.accumulate(np.where(block == 0, at, -np.inf), axis=1)
    ahead = np.minimum.accumulate(np.where(block == 0, at, np.inf)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(at - back, ahead - at) ** 2


def _across(block: np.ndarray) -> np.ndarray:
    """Smallest sum of ``block`` and the squared distance along the line: the lower envelope of a parabola a cell,
    whose parts are found in one pass over the line."""
    out = np.full_like(block, np.inf)
    for line, own in zip(block, out):
        places = np.flatnonzero(np.isfinite(line)).tolist()
        if not places:
            continue
        f = line.tolist()
        held, start = [places[0]], [-np.inf]  # parabolas of the envelope, and where each begins
        for q in places[1:]:
            high = f[q] + q * q
            while True:
                p = held[-1]
                s = (high - f[p] - p * p) / (2 * (q - p))
                if s > start[-1] or len(held) == 1:
                    break
                held.pop(), start.pop()
            if s <= start[-1]:
                held[-1] = q
            else:
                held.append(q), start.append(s)
        at = np.arange(len(line))
        near = np.array(held)[np.searchsorted(start, at, "left").clip(1) - 1]
        own[:] = line[near] + (at - near) ** 2
    return out


def margin_distance(cells: DataFrame, grid: Grid, mask: str = "inside") -> DataFrame:
    """(r, c, distance): from each cell inside to the nearest one outside, in mean cell sizes; 0 outside; infinite
    without any cell outside (the array's edge is none)."""
    flat = cells.select("r", "c", F.coalesce(F.col(mask), F.lit(False)).cast("double").alias("distance"))
    columns = along(flat, "c", "r", grid.nrows, "distance", _down)
    rows = along(columns, "r", "c", grid.ncols, "distance", _across)
    return rows.select("r", "c", (F.sqrt("distance") * F.lit(grid.cell)).alias("distance"))
