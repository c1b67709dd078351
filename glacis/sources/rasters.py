"""Rasters: GeoTIFF, ESRI ASCII, CSV and NPY, read into cells and written from them.

Files are read and decoded by executors, through Spark's binary reader, so any file system it knows will do. Row 0
of a frame is the southernmost; north-up files are turned over on the way in and out.
"""

from __future__ import annotations

import io
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import CELLS, Grid, from_array, to_array
from ..operators.sampling import resample

NO_DATA = -9999.0
FORMATS = ("tif", "asc", "csv", "npy")
TIFF, ASCII = ("tif", "tiff", "geotiff"), ("asc", "txt")
#: Cells that a reading task hands over together.
CELLS_AT_ONCE = 1 << 18
# Fixed values of the TIFF format: sizes of field types, and the tags used here
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_ASCII, GDAL_NODATA = 33550, 33922, 34264, 34735, 34737, 42113


def _tags(raw: bytes):
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", raw[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), raw[8:16] if big else raw[4:8])[0]
    head, entry, inline = (8, 20, 8) if big else (2, 12, 4)
    n = struct.unpack(order + ("Q" if big else "H"), raw[at:at + head])[0]
    out = {}
    for i in range(n):
        e = raw[at + head + i * entry:][:entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4:4 + (8 if big else 4)])[0]
        size = TYPE_SIZE.get(kind, 1) * count
        body = e[-inline:]
        data = body[:size] if size <= inline else raw[(p := struct.unpack(order + ("Q" if big else "I"), body)[0]):p + size]
        if kind == 2:
            out[tag] = data.split(b"\0")[0].decode("ascii", "replace")
        elif kind in TYPE_CODE:
            out[tag] = struct.unpack(f"{order}{count}{TYPE_CODE[kind]}", data)
    return order, out


def _unpack(data: bytes, how: int) -> bytes:
    if how == 1:
        return data
    if how in (8, 32946):
        return zlib.decompress(data)
    if how == 5:
        return _lzw(data)
    if how == 32773:
        out, i = bytearray(), 0
        while i < len(data):
            n = data[i]
            if n < 128:
                out += data[i + 1:i + 2 + n]
                i += n + 2
            else:
                if n > 128:
                    out += data[i + 1:i + 2] * (257 - n)
                i += 2
        return bytes(out)
    raise ValueError(f"TIFF compression {how} isn't supported")


def _lzw(data: bytes) -> bytes:
    clear, end = 256, 257
    out, table, width, bits, held, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == end:
                return bytes(out)
            if code == clear:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else before + before[:1]
            out += word
            if before:
                table.append(before + word[:1])
            before = word
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def tiff_grid(raw: bytes) -> Grid:
    """Size and place of a GeoTIFF."""
    _, tag = _tags(raw)
    w, h = tag[WIDTH][0], tag[HEIGHT][0]
    a, e, x0, y0 = _placed(tag, h)
    crs = None
    keys = tag.get(GEO_KEYS, ())
    for k in range(4, len(keys), 4):
        if keys[k] in (3072, 2048) and keys[k + 1] == 0 and keys[k + 3] not in (0, 32767):
            crs = f"EPSG:{keys[k + 3]}"
            if keys[k] == 3072:
                break
    return Grid.of(h, w, abs(a), abs(e), (x0, min(y0, y0 + e * h), x0 + a * w, max(y0, y0 + e * h)), crs)


def _placed(tag: dict, h: int) -> tuple[float, float, float, float]:
    """Width and height of a cell (negative: north up), and the outer corner of the first one."""
    if TRANSFORM in tag:
        a, _, _, x0, _, e, _, y0 = tag[TRANSFORM][:8]
        return a, e, x0, y0
    if PIXEL_SCALE in tag and TIEPOINT in tag:
        sx, sy = tag[PIXEL_SCALE][:2]
        i, j, _, x, y = tag[TIEPOINT][:5]
        return sx, -sy, x - i * sx, y + j * sy
    return 1.0, -1.0, 0.0, float(h)


def tiff_blocks(raw: bytes):
    """(first row, first column, values) of each strip or tile of band 1, rows counted and running from the south."""
    order, tag = _tags(raw)
    w, h = tag[WIDTH][0], tag[HEIGHT][0]
    bits, kind, samples = tag.get(BITS, (1,))[0], tag.get(SAMPLE_FORMAT, (1,))[0], tag.get(SAMPLES, (1,))[0]
    if bits % 8:
        raise ValueError(f"TIFF samples of {bits} bits aren't supported")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    how, predictor = tag.get(COMPRESSION, (1,))[0], tag.get(PREDICTOR, (1,))[0]
    inner = samples if tag.get(PLANAR, (1,))[0] == 1 else 1
    tiled = TILE_AT in tag
    bw, bh = (tag[TILE_WIDTH][0], tag[TILE_HEIGHT][0]) if tiled else (w, min(tag.get(STRIP_ROWS, (h,))[0], h))
    at, size = (tag[TILE_AT], tag[TILE_SIZE]) if tiled else (tag[STRIP_AT], tag[STRIP_SIZE])
    across, up = math.ceil(w / bw), _placed(tag, h)[1] < 0
    gap = tag.get(GDAL_NODATA, "").strip()
    for i in range(across * math.ceil(h / bh)):
        top, left = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - top)
        data = _unpack(raw[at[i]:at[i] + size[i]], how)
        if predictor == 3:
            block = np.frombuffer(data, np.uint8)[: rows * bw * inner * (bits // 8)].reshape(rows, -1)
            block = np.add.accumulate(block.reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, bits // 8, -1)
            block = np.ascontiguousarray(block.transpose(0, 2, 1)).view(np.dtype(f">f{bits // 8}")).reshape(rows, bw, inner)
        else:
            block = np.frombuffer(data, dtype)[: rows * bw * inner].reshape(rows, bw, inner)
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=dtype)
        own = block[: h - top, : w - left, 0].astype(float)
        if gap:
            own[own == float(gap)] = np.nan
        yield (h - top - len(own), left, own[::-1]) if up else (top, left, own)


def write_tiff(z: np.ndarray, grid: Grid) -> bytes:
    """One uncompressed band of doubles, north up, NaN for no data."""
    h, w = z.shape
    body = np.ascontiguousarray(z[::-1], "<f8").tobytes()
    sx, sy = (grid.bounds[2] - grid.bounds[0]) / w, (grid.bounds[3] - grid.bounds[1]) / h
    fields = [(WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (64,)), (COMPRESSION, "H", (1,)), (262, "H", (1,)), (STRIP_AT, "I", (8,)), (SAMPLES, "H", (1,)),
              (STRIP_ROWS, "I", (h,)), (STRIP_SIZE, "I", (len(body),)), (SAMPLE_FORMAT, "H", (3,)), (PIXEL_SCALE, "d", (sx, sy, 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, grid.bounds[0], grid.bounds[3], 0.0))]
    if grid.crs and grid.crs.upper().startswith("EPSG:"):
        code = int(grid.crs.split(":")[1])
        model = 2 if 4000 <= code < 5000 else 1
        fields.append((GEO_KEYS, "H", (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 3072 if model == 1 else 2048, 0, 1, code)))
    fields.append((GDAL_NODATA, "s", b"nan\0"))
    at = 8 + len(body)
    extra, entries = b"", []
    start = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields, key=lambda f: f[0]):
        data = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        number = {"H": 3, "I": 4, "d": 12, "s": 2}[kind]
        if len(data) <= 4:
            entries.append(struct.pack("<HHI", tag, number, len(values)) + data.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, number, len(values), start + len(extra)))
            extra += data + b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4 + extra


def read_ascii(raw: bytes) -> tuple[np.ndarray, Grid]:
    head, lines = {}, raw.decode("utf-8-sig").splitlines()
    while lines and len(lines[0].split()) == 2 and lines[0].split()[0][0].isalpha():
        k, v = lines.pop(0).split()
        head[k.lower()] = float(v)
    w, h, d = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    z = np.array(" ".join(lines).split(), float).reshape(h, w)[::-1].copy()
    z[z == head.get("nodata_value", NO_DATA)] = np.nan
    x0 = head["xllcorner"] if "xllcorner" in head else head.get("xllcenter", 0.0) - d / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head.get("yllcenter", 0.0) - d / 2
    return z, Grid.of(h, w, d, d, (x0, y0, x0 + w * d, y0 + h * d))


def write_ascii(z: np.ndarray, grid: Grid) -> str:
    h, w = z.shape
    head = f"ncols {w}\nnrows {h}\nxllcorner {grid.bounds[0]}\nyllcorner {grid.bounds[1]}\ncellsize {(grid.bounds[2] - grid.bounds[0]) / w}\nNODATA_value {NO_DATA:g}\n"
    return head + "".join(" ".join("%.4f" % v for v in row) + "\n" for row in np.where(np.isnan(z), NO_DATA, z)[::-1])


def numeric_table(raw: bytes) -> np.ndarray:
    """A matrix of numbers: without a header if that works, else the numeric columns under one; empty fields are NaN."""
    text = raw.decode("utf-8-sig")
    first = next((x for x in text.splitlines() if x.strip()), "")
    sep = "," if "," in first else ";" if ";" in first else r"\s+"
    read = lambda header: pd.read_csv(io.StringIO(text), sep=sep, header=header, comment="#", skip_blank_lines=sep != ",", engine="python" if sep == r"\s+" else "c")
    got = read(None)
    if any(got[c].dtype == object for c in got):
        got = read(0)
    return got.select_dtypes("number").to_numpy(float)


def _bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row[0])


def _array(raw: bytes, kind: str) -> np.ndarray:
    return np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False) if kind == "npy" else numeric_table(raw)).astype(float)


def _grid(raw: bytes, kind: str) -> Grid:
    if kind in TIFF:
        return tiff_grid(raw)
    return read_ascii(raw)[1] if kind in ASCII else Grid.of(*_array(raw, kind).shape)


def _scan(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, Grid]:
    """Cells and grid of a file that an executor reads and decodes; what reaches the driver is the grid."""
    from pyspark import cloudpickle

    file = spark.read.format("binaryFile").load(path).select("content")

    def head(batches):
        for pdf in batches:
            yield pd.DataFrame({"grid": [cloudpickle.dumps(_grid(bytes(raw), kind)) for raw in pdf["content"]]})

    def cells(batches):
        for pdf in batches:
            for raw in map(bytes, pdf["content"]):
                blocks = tiff_blocks(raw) if kind in TIFF else [(0, 0, read_ascii(raw)[0] if kind in ASCII else _array(raw, kind))]
                for r0, c0, z in blocks:
                    for s in range(0, len(z), lines := max(1, CELLS_AT_ONCE // max(z.shape[1], 1))):
                        own = z[s:s + lines]
                        r, c = np.divmod(np.arange(own.size), own.shape[1])
                        yield pd.DataFrame({"r": r0 + s + r, "c": c0 + c, "z": own.ravel()})

    got = file.mapInPandas(head, "grid binary").first()
    if got is None:
        raise FileNotFoundError(path)
    return file.mapInPandas(cells, CELLS).withColumn("z", F.nanvl("z", F.lit(None))), cloudpickle.loads(bytes(got[0]))


def read_dem(spark: SparkSession, source, dx: float | None = None, dy: float | None = None, bounds=None) -> tuple[DataFrame, Grid]:
    """Cells and grid of a path, an array, or a frame (r, c, z).

    For rasters with their own spacing, another ``dx`` or ``dy`` resamples; for CSV, NPY and arrays, which have
    none, they say what it is. CSV and NPY rows run south to north.
    """
    if isinstance(source, DataFrame):
        top = source.agg(F.max("r"), F.max("c")).first()
        if top[0] is None:
            raise ValueError("the raster is empty")
        return source.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.nanvl(F.col("z").cast("double"), F.lit(None)).alias("z")), Grid.of(top[0] + 1, top[1] + 1, dx or 1.0, dy or dx or 1.0, bounds)
    if not isinstance(source, str):
        return from_array(spark, source, dx or 1.0, dy or dx or 1.0, bounds)
    kind = source.rsplit(".", 1)[-1].lower()
    if kind not in (*TIFF, *ASCII, "csv", "npy"):
        raise ValueError(f"unknown raster format {kind!r}")
    cells, grid = _scan(spark, source, kind)
    if kind in ("csv", "npy"):
        return cells, Grid.of(grid.nrows, grid.ncols, dx or 1.0, dy or dx or 1.0, bounds)
    if dx or dy:
        return resample(cells, grid, dx or grid.dx, dy or grid.dy)
    return cells, grid


def encode(z: np.ndarray, grid: Grid, kind: str) -> bytes:
    """A raster file's bytes; an unknown format is an error."""
    if kind in TIFF:
        return write_tiff(z, grid)
    if kind in ASCII:
        return write_ascii(z, grid).encode()
    if kind == "csv":
        return "".join(",".join("%.18e" % v for v in row) + "\n" for row in z).encode()
    if kind == "npy":
        held = io.BytesIO()
        np.save(held, z)
        return held.getvalue()
    raise ValueError(f"unknown raster format {kind!r}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in whatever file system ``path`` names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_dem(cells: DataFrame, grid: Grid, path: str, formats=None, value: str = "z") -> list[str]:
    """Write a grid that fits the driver in one or more formats (``all``: every one); the paths written.

    Formats come from the argument, else the extension, else GeoTIFF. Grids of any size can be
    written as tables: ``cells.write.parquet``.
    """
    stem, dot, ext = path.rpartition(".")
    known = dot and "/" not in ext and ext.lower() in (*FORMATS, "tiff", "geotiff", "txt")
    if formats is None:
        kinds = [ext.lower()] if known else ["tif"]
    elif isinstance(formats, str):
        kinds = list(FORMATS) if formats.lower() == "all" else [formats.lower()]
    else:
        kinds = [f.lower() for f in formats]
    z = to_array(cells, grid, value)
    files = {f"{stem if known else path}.{k}": encode(z, grid, k) for k in kinds}
    for name, data in files.items():
        write_bytes(cells.sparkSession, name, data)
    return list(files)
