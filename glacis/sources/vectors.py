"""Outlines (GeoJSON, shapefile, GeoPackage, CSV rings) and survey picks."""

from __future__ import annotations

import json
import sqlite3
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, same_crs
from ..operators.mask import inside, valid_polygons
from ..operators.migration import check_extent
from .rasters import _bytes, numeric_table

VERTICES = "polygon int, ring_id int, seq int, x double, y double"


def _geojson(raw: bytes):
    doc = json.loads(raw)
    crs = ((doc.get("crs") or {}).get("properties") or {}).get("name")
    parts = doc.get("features") or [doc]
    polygons = []
    for f in parts:
        g = f.get("geometry", f) or {}
        if g.get("type") == "Polygon":
            polygons.append(g["coordinates"])
        elif g.get("type") == "MultiPolygon":
            polygons += g["coordinates"]
    return [[np.array(r, float)[:, :2] for r in p] for p in polygons], crs


def _shapefile(raw: bytes):
    polygons, at = [], 100
    while at + 12 <= len(raw):
        size = struct.unpack(">i", raw[at + 4:at + 8])[0] * 2
        body, at = raw[at + 8:at + 8 + size], at + 8 + size
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        first = [*struct.unpack(f"<{parts}i", body[44:44 + 4 * parts]), points]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        for a, b in zip(first, first[1:]):
            ring = xy[a:b]
            if _turn(ring) < 0 or not polygons:  # outer rings run clockwise
                polygons.append([ring])
            else:
                polygons[-1].append(ring)
    return polygons, None


def _wkb(data: bytes, at: int = 0):
    order = "<" if data[at] else ">"
    kind = struct.unpack(order + "I", data[at + 1:at + 5])[0]
    dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    kind, at = kind % 1000, at + 5
    n = struct.unpack(order + "I", data[at:at + 4])[0]
    at += 4
    if kind == 3:
        rings = []
        for _ in range(n):
            m = struct.unpack(order + "I", data[at:at + 4])[0]
            rings.append(np.frombuffer(data, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2])
            at += 4 + 8 * m * dims
        return [rings], at
    if kind in (6, 7):
        out = []
        for _ in range(n):
            got, at = _wkb(data, at)
            out += got
        return out, at
    raise ValueError(f"geometry type {kind} isn't an outline")


def _geopackage(raw: bytes):
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    table, column, srs = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchone()
    polygons = []
    for (blob,) in db.execute(f'select "{column}" from "{table}"'):
        if blob:
            size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
            polygons += _wkb(blob, 8 + size)[0]
    db.close()
    return polygons, f"EPSG:{srs}" if srs and srs > 0 else None


def _rings(raw: bytes):
    """One polygon: rings that rows without numbers separate, the first being the outer one."""
    xy = numeric_table(raw)[:, :2]
    gap = np.isnan(xy).any(1)
    parts = np.split(np.arange(len(xy)), np.flatnonzero(gap))
    rings = [xy[p][~gap[p]] for p in parts]
    return [[r for r in rings if len(r) >= 3]], None


def encode_outline(polygons, kind: str, crs: str | None = None) -> bytes:
    """Polygons (outer ring, holes) as a file's bytes: ``geojson``, ``shp`` (without its index and table), ``gpkg`` or ``csv`` (one polygon)."""
    rings = [[np.asarray(r, "<f8") for r in p] for p in polygons]
    closed = [[np.concatenate([r, r[:1]]) for r in p] for p in rings]
    if kind in ("geojson", "json"):
        doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [r.tolist() for r in p]}} for p in closed]}
        return json.dumps(doc | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})).encode()
    if kind == "csv":
        return b"x,y\n" + b"nan,nan\n".join(b"".join(b"%r,%r\n" % (float(x), float(y)) for x, y in r) for r in rings[0])
    if kind == "shp":
        body, box = b"", lambda xy: struct.pack("<4d", *xy.min(0), *xy.max(0))
        for i, p in enumerate(closed):
            turned = [r if (_turn(r) < 0) == (k == 0) else r[::-1] for k, r in enumerate(p)]  # outer rings run clockwise
            xy, first = np.concatenate(turned), np.cumsum([0] + [len(r) for r in turned[:-1]])
            shape = struct.pack("<i", 5) + box(xy) + struct.pack("<2i", len(turned), len(xy)) + first.astype("<i4").tobytes() + xy.tobytes()
            body += struct.pack(">2i", i + 1, len(shape) // 2) + shape
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, 5) + box(np.concatenate([r for p in closed for r in p])) + b"\0" * 32 + body
    if kind == "gpkg":
        db, srs = sqlite3.connect(":memory:"), int(crs.rsplit(":", 1)[1]) if crs else 0
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
        db.execute("insert into gpkg_geometry_columns values ('outline', 'geom', 'POLYGON', ?, 0, 0)", (srs,))
        db.execute("create table outline (fid integer primary key, geom blob)")
        for p in closed:
            wkb = struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in p)
            db.execute("insert into outline (geom) values (?)", (b"GP\0\1" + struct.pack("<i", srs) + wkb,))
        db.commit()
        return bytes(db.serialize())
    raise ValueError(f"unknown outline format {kind!r}")


def _turn(ring: np.ndarray) -> float:
    """Twice the signed area; below zero clockwise."""
    return float(np.dot(ring[:-1, 0], ring[1:, 1]) - np.dot(ring[1:, 0], ring[:-1, 1]))


def vertices(spark: SparkSession, polygons) -> DataFrame:
    """(polygon, ring_id, seq, x, y): ring 0 of a polygon is its outer one, the others are holes."""
    rows = [(p, k, i, float(x), float(y)) for p, rings in enumerate(polygons) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, VERTICES)


def _projection(spark: SparkSession, path: str) -> str | None:
    """The text of the ``.prj`` beside a shapefile, if there is one."""
    beside = path.rsplit(".", 1)[0] + ".prj"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(beside)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return _bytes(spark, beside).decode("utf-8", "replace").strip() or None


def read_outline(spark: SparkSession, path: str):
    """(polygons, crs) of an outline file."""
    kind = path.rsplit(".", 1)[-1].lower()
    raw = _bytes(spark, path)
    if kind in ("geojson", "json"):
        polygons, crs = _geojson(raw)
    elif kind == "shp":
        polygons, crs = _shapefile(raw)[0], _projection(spark, path)
    elif kind == "gpkg":
        polygons, crs = _geopackage(raw)
    else:
        polygons, crs = _rings(raw)
    polygons = valid_polygons(polygons)
    if not polygons:
        raise ValueError(f"no outline in {path}")
    return polygons, crs


def masked(cells: DataFrame, grid: Grid, outline=None) -> DataFrame:
    """``cells`` with ``inside``: by an outline file, a list of polygons, an array of the grid's shape (true or above
    zero), a frame (r, c, v), or, without an outline, wherever there is data."""
    spark = cells.sparkSession
    if outline is None:
        return cells.withColumn("inside", F.col("z").isNotNull())
    if isinstance(outline, DataFrame):
        v = outline.select("r", "c", (F.col("v").cast("double") > 0).alias("inside"))
        return cells.join(v, ["r", "c"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    if isinstance(outline, np.ndarray):
        if outline.shape != (grid.nrows, grid.ncols):
            raise ValueError(f"the mask has shape {outline.shape}, the raster {(grid.nrows, grid.ncols)}")
        r, c = np.nonzero(np.nan_to_num(outline.astype(float)) > 0)
        got = spark.createDataFrame(list(zip(r.tolist(), c.tolist())), "r long, c long").withColumn("inside", F.lit(True))
        return cells.join(got, ["r", "c"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    polygons, crs = read_outline(spark, outline) if isinstance(outline, str) else (valid_polygons(outline), None)
    same_crs(grid.crs, crs)
    every = np.concatenate([r for p in polygons for r in p])
    check_extent(spark.createDataFrame(every.tolist(), "x double, y double"), grid, "outline")
    return inside(cells, vertices(spark, polygons), grid)


def read_survey(spark: SparkSession, source) -> DataFrame:
    """(pid, x, y[, z_surf], val) of a text file, an array or a frame: four columns, or three without the surface."""
    if isinstance(source, DataFrame):
        return source
    table = numeric_table(_bytes(spark, source)) if isinstance(source, str) else np.atleast_2d(np.asarray(source, float))
    names = ["x", "y", "z_surf", "val"] if table.shape[1] >= 4 else ["x", "y", "val"]
    if table.shape[1] < 3:
        raise ValueError("picks need three columns at least")
    rows = [(i, *map(float, row[: len(names)])) for i, row in enumerate(table)]
    out = spark.createDataFrame(rows, "pid long, " + ", ".join(f"{n} double" for n in names))
    return out.select("pid", *[F.nanvl(n, F.lit(None)).alias(n) for n in names])
