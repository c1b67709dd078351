"""Grids as frames: one row a cell, ``(r, c, z, ...)``, and what is known of the raster as a whole.

Row 0 is the southernmost row; readers turn north-up rasters over and writers turn them back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "r long, c long, z double"


@dataclass(frozen=True)
class Grid:
    """Topology and place of a raster; ``bounds`` are (minx, miny, maxx, maxy)."""

    nrows: int
    ncols: int
    bounds: tuple[float, float, float, float]
    dx: float = 1.0
    dy: float = 1.0
    native_dx: float | None = None
    native_dy: float | None = None
    crs: str | None = None

    @classmethod
    def of(cls, nrows: int, ncols: int, dx: float = 1.0, dy: float = 1.0, bounds=None, crs: str | None = None) -> Grid:
        """With ``bounds`` missing the raster starts at the origin."""
        return cls(nrows, ncols, tuple(bounds) if bounds else (0.0, 0.0, ncols * dx, nrows * dy), dx, dy, dx, dy, crs)

    @property
    def cell(self) -> float:
        return (self.dx + self.dy) / 2

    def x(self, c: Column) -> Column:
        """Centre of a column of cells."""
        return F.lit(float(self.bounds[0])) + (c + F.lit(0.5)) * F.lit(float(self.dx))

    def y(self, r: Column) -> Column:
        return F.lit(float(self.bounds[1])) + (r + F.lit(0.5)) * F.lit(float(self.dy))

    def edge_x(self, c: Column) -> Column:
        """Places from edge to edge, the first and last cell lying on the bounds."""
        step = (self.bounds[2] - self.bounds[0]) / max(self.ncols - 1, 1)
        return F.lit(float(self.bounds[0])) + c * F.lit(step)

    def edge_y(self, r: Column) -> Column:
        step = (self.bounds[3] - self.bounds[1]) / max(self.nrows - 1, 1)
        return F.lit(float(self.bounds[1])) + r * F.lit(step)


def index(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells of a grid: (r, c)."""
    n = spark.range(grid.nrows * grid.ncols)
    return n.select(F.expr(f"id div {grid.ncols}").alias("r"), (F.col("id") % grid.ncols).alias("c"))


def located(cells: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` with the centres' ``x`` and ``y``."""
    return cells.withColumns({"x": grid.x(F.col("c")), "y": grid.y(F.col("r"))})


def from_array(spark: SparkSession, z, dx: float = 1.0, dy: float = 1.0, bounds=None, crs: str | None = None) -> tuple[DataFrame, Grid]:
    """A frame of a 2-D array whose row 0 is in the south; NaN becomes null."""
    import numpy as np
    import pandas as pd

    z = np.asarray(z, np.float64)
    rows, cols = z.shape
    r, c = np.divmod(np.arange(z.size), cols)
    pdf = pd.DataFrame({"r": r, "c": c, "z": z.ravel()})
    return spark.createDataFrame(pdf, CELLS).withColumn("z", F.nanvl("z", F.lit(None))), Grid.of(rows, cols, dx, dy, bounds, crs)


def to_array(cells: DataFrame, grid: Grid, value: str = "z"):
    """The dense array of a column; for results and other grids that fit the driver."""
    import numpy as np

    out = np.full((grid.nrows, grid.ncols), np.nan)
    got = cells.select("r", "c", F.col(value).cast("double").alias("v")).toPandas()
    out[got["r"], got["c"]] = got["v"]
    return out


def in_task(spark: SparkSession, run):
    """The result of ``run()``, worked out by one executor task: dense algebra stays off the driver, on one thread."""
    import pandas as pd
    from pyspark import cloudpickle

    def task(batches):
        for pdf in batches:
            yield pd.DataFrame({"out": [cloudpickle.dumps(run())] * len(pdf)})

    return cloudpickle.loads(bytes(spark.range(1).coalesce(1).mapInPandas(task, "out binary").first()[0]))


def crs_name(crs: str) -> str | None:
    """One name for the forms of a reference system: authority and code, whether written so, as an URN, an
    address or the last identifier of well-known text; ``CRS84`` is ``OGC:CRS84``. Well-known text without identifiers
    is known where it names a UTM zone of WGS 84 or ETRS89, or plain WGS 84; else the result is None."""
    text = " ".join(crs.upper().split())
    if text.endswith("]"):
        ids = re.findall(r"(?:AUTHORITY|ID) ?\[ ?\"([A-Z]+)\" ?, ?\"?([0-9]+)\"? ?\]", text)
        if ids:
            return ":".join(ids[-1])
        zone = re.match(r"PROJC[A-Z]*\[ ?\"(WGS|ETRS)[^\"]*?ZONE[ _]([0-9]+)([NS])\"", text)
        if zone:  # the codes of UTM zones follow from their numbers
            return f"EPSG:{(25800 if zone[1] == 'ETRS' else 32600 if zone[3] == 'N' else 32700) + int(zone[2])}"
        return "EPSG:4326" if re.match(r"GEOGC[A-Z]*\[ ?\"(GCS_)?WGS[_ ](19)?84\"", text) else None
    m = re.fullmatch(r"(?:URN:(?:X-)?OGC:DEF:CRS:|HTTPS?://WWW\.OPENGIS\.NET/DEF/CRS/|)([A-Z]+)[:/](?:[0-9.]*[:/])?([A-Z0-9]+)", text)
    if m:
        return "OGC:CRS84" if m[2] in ("CRS84", "84") and m[1] in ("OGC", "CRS") else f"{m[1]}:{m[2]}"
    return "OGC:CRS84" if text == "CRS84" else text


def same_crs(a: str | None, b: str | None) -> None:
    """Raises where both reference systems are known and differ."""
    x, y = (crs_name(k) if k else None for k in (a, b))
    if x and y and x != y:
        raise ValueError(f"coordinate reference systems differ: {a} and {b}")


def resized(grid: Grid, dx: float, dy: float) -> Grid:
    """The grid of the same extent at another spacing; dimensions round half to even."""
    w, h = grid.bounds[2] - grid.bounds[0], grid.bounds[3] - grid.bounds[1]
    cols, rows = max(1, round(w / dx)), max(1, round(h / dy))
    return replace(grid, nrows=rows, ncols=cols, dx=dx, dy=dy, bounds=(grid.bounds[0], grid.bounds[1], grid.bounds[0] + cols * dx, grid.bounds[1] + rows * dy))
