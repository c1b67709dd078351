"""Gradients and smoothing of grids.

Gradients are window functions over the rows and columns of cells. Filters are separable: each pass
groups bands of whole lines, so a task holds BAND lines whatever the size of the grid.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid

BAND = 32


def _difference(value: str, line: str, along: str, count: int, step: float) -> Column:
    """Central difference, one-sided at both ends of the line; null next to a null."""
    w = Window.partitionBy(line).orderBy(along)
    before, after, z = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    if count == 1:
        return F.lit(0.0)
    return (F.when(F.col(along) == 0, (after - z) / F.lit(float(step)))
            .when(F.col(along) == count - 1, (z - before) / F.lit(float(step)))
            .otherwise((after - before) / F.lit(2.0 * step)))


def gradient(cells: DataFrame, grid: Grid, value: str = "z", x: str = "slope_x", y: str = "slope_y") -> DataFrame:
    """``cells`` with the two derivatives of ``value``: one shuffle for each direction."""
    return (cells.withColumn(x, _difference(value, "r", "c", grid.ncols, grid.dx))
            .withColumn(y, _difference(value, "c", "r", grid.nrows, grid.dy)))


def slopes(cells: DataFrame, grid: Grid, value: str = "z") -> DataFrame:
    """The bundle of slope columns: derivatives, magnitude, angles, sines and cosines."""
    out = gradient(cells, grid, value)
    size = F.sqrt(F.col("slope_x") * F.col("slope_x") + F.col("slope_y") * F.col("slope_y"))
    ax, ay = F.atan("slope_x"), F.atan("slope_y")
    return out.withColumns({
        "slope": size, "slope_rad": F.atan(size), "slope_grad": F.degrees(F.atan(size)), "sin_x": F.sin(ax), "cos_x": F.cos(ax),
        "sin_y": F.sin(ay), "cos_y": F.cos(ay), "sin_slope": F.sin(F.atan(size))})


def along(cells: DataFrame, line: str, place: str, count: int, value: str, run) -> DataFrame:
    """Apply ``run`` (array of lines -> array of lines) to ``value``; cells that are missing are NaN."""

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, inverse = np.unique(pdf[line].to_numpy(), return_inverse=True)
        block = np.full((len(lines), count), np.nan)
        block[inverse, pdf[place].to_numpy()] = pdf[value].to_numpy(np.float64, na_value=np.nan)
        done = np.asarray(run(block), np.float64)
        return pd.DataFrame({line: np.repeat(lines, count), place: np.tile(np.arange(count), len(lines)), value: done.ravel()})

    got = cells.select(line, place, F.col(value).cast("double").alias(value)).groupBy(F.expr(f"{line} div {BAND}").alias("band")).applyInPandas(
        lambda pdf: band(pdf), f"{line} long, {place} long, {value} double")
    return got.withColumn(value, F.nanvl(value, F.lit(None)))


def _both(cells: DataFrame, grid: Grid, value: str, rows, columns) -> DataFrame:
    done = along(along(cells, "r", "c", grid.ncols, value, rows), "c", "r", grid.nrows, value, columns)
    return done.select("r", "c", value)


def transfer(kc: float, scale: float, n: int) -> np.ndarray:
    """Gaussian low pass of lines of ``n`` cells: exp(-k^2 / 2 kc^2), k = 2 pi scale f; one of zero or less lets all through."""
    k = 2 * np.pi * scale * np.fft.rfftfreq(n)
    return np.exp(-(k**2) / (2 * kc**2)) if kc > 0 else np.ones(len(k))


def _lowpass(kc: float, scale: float):
    def run(block: np.ndarray) -> np.ndarray:
        n = block.shape[1]
        return np.fft.irfft(np.fft.rfft(block, axis=1) * transfer(kc, scale, n), n, axis=1)

    return run


def lowpass(cells: DataFrame, grid: Grid, kc: float, value: str = "z", per_cell: bool = True, keep_null: bool = False) -> DataFrame:
    """Gaussian low pass of ``value``: (r, c, value).

    ``per_cell``: wavenumbers are 2 pi f times the spacing, as in sweeps of the cutoff; else true
    wavenumbers, 2 pi f over the spacing, as in smoothing of results. Nulls count as the mean and, with
    ``keep_null``, are null again afterwards. A cutoff of zero or less changes nothing else.
    """
    mean = cells.agg(F.avg(value)).first()[0]
    filled = cells.select("r", "c", F.col(value).isNull().alias("gap"), F.coalesce(value, F.lit(mean)).alias(value))
    if kc <= 0:
        done = filled.select("r", "c", value)
    else:
        sx, sy = (abs(grid.dx), abs(grid.dy)) if per_cell else (1 / grid.dx, 1 / grid.dy)
        done = _both(filled, grid, value, _lowpass(kc, sx), _lowpass(kc, sy))
    if keep_null:
        done = done.join(filled.select("r", "c", "gap"), ["r", "c"]).select("r", "c", F.when(~F.col("gap"), F.col(value)).alias(value))
    return done


def lowpass_at(points: DataFrame, cells: DataFrame, grid: Grid, cutoffs: list[float], value: str, key: str = "pid", together: int = 65536) -> DataFrame:
    """(key, values): ``value`` filtered as by ``lowpass`` at each cutoff, bilinear at the points; points beyond the cells' centres are left out.

    The filtered grids are never made. A band of lines along the longer side filters them and keeps them at the points'
    places; what its lines add to each point across is summed over bands, of which the shorter side makes few. A pass
    over the grid takes ``together`` points.
    """
    m, n = grid.nrows, grid.ncols
    mean = cells.agg(F.avg(value)).first()[0] or 0.0
    fx = (F.col("x") - F.lit(grid.bounds[0])) / F.lit(float(grid.dx)) - F.lit(0.5)
    fy = (F.col("y") - F.lit(grid.bounds[1])) / F.lit(float(grid.dy)) - F.lit(0.5)
    at = points.select(F.col(key).alias("k_"), fx.alias("fx"), fy.alias("fy")).where((F.col("fx") >= 0) & (F.col("fx") <= n - 1) & (F.col("fy") >= 0) & (F.col("fy") <= m - 1))
    if m > n:
        line, place, step = "c", "r", (abs(grid.dy), abs(grid.dx))
        m, n, at = n, m, at.select("k_", F.col("fy").alias("fx"), F.col("fx").alias("fy"))
    else:
        line, place, step = "r", "c", (abs(grid.dx), abs(grid.dy))
    kernels = [np.fft.irfft(transfer(kc, step[1], m), m) for kc in cutoffs]
    bands = cells.select(F.expr(f"{line} div {BAND}").alias("band"), F.col(line).alias("r"), F.col(place).alias("c"), F.coalesce(value, F.lit(mean)).cast("double").alias("v"))
    kind = points.schema[key].dataType.simpleString()

    def one(own: pd.DataFrame) -> DataFrame:
        shared = cells.sparkSession.sparkContext.broadcast((own["k_"].to_numpy(), own["fx"].to_numpy(), own["fy"].to_numpy()))  # ``together`` points

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            k, x, y = shared.value
            rows, place = np.unique(pdf["r"].to_numpy(), return_inverse=True)
            block = np.full((len(rows), n), mean)
            block[place, pdf["c"].to_numpy()] = pdf["v"].to_numpy()
            c, r = np.minimum(np.floor(x), max(n - 2, 0)).astype(int), np.minimum(np.floor(y), max(m - 2, 0)).astype(int)
            u, w = x - c, y - r
            right, below = np.minimum(c + 1, n - 1), np.minimum(r + 1, m - 1)
            spectrum, total = np.fft.rfft(block, axis=1), []
            for kc, kernel in zip(cutoffs, kernels):
                line = np.fft.irfft(spectrum * transfer(kc, step[0], n), n, axis=1)
                line = line[:, c] * (1 - u) + line[:, right] * u
                total.append((line * (kernel[(r - rows[:, None]) % m] * (1 - w) + kernel[(below - rows[:, None]) % m] * w)).sum(0))
            return pd.DataFrame({"k_": k, "sums": list(np.array(total).T)})

        return bands.groupBy("band").applyInPandas(lambda pdf: run(pdf), f"k_ {kind}, sums array<double>")

    parts = max(1, -(-at.count() // together))
    got = [one(at.where(F.pmod(F.xxhash64("k_"), F.lit(parts)) == p).toPandas()) for p in range(parts)]
    sums = reduce(DataFrame.union, got).select("k_", F.posexplode("sums").alias("i", "v")).groupBy("k_", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(F.col("k_").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("values"))


def largest_wavenumber(grid: Grid) -> float:
    """The next whole number above the largest wavenumber of a sweep's filter."""
    k = [2 * np.pi * abs(d) * (n // 2) / n for d, n in ((grid.dx, grid.ncols), (grid.dy, grid.nrows))]
    return float(np.ceil(np.hypot(*k)))


def gaussian_weights(sigma: float) -> np.ndarray:
    """Weights out to four sigma."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def _convolve(weights: np.ndarray):
    reach = len(weights) // 2

    def run(block: np.ndarray) -> np.ndarray:
        n = block.shape[1]
        at = np.arange(-reach, n + reach) % (2 * n)  # edges are mirrored, the outermost cell twice
        wide = block[:, np.where(at < n, at, 2 * n - 1 - at)]
        return sum(w * wide[:, k:k + n] for k, w in enumerate(weights))

    return run


def gaussian(cells: DataFrame, grid: Grid, sigma: float = 1.5, value: str = "z") -> DataFrame:
    """Gaussian smoothing by ``sigma`` cells: (r, c, value). Nulls count as the mean and stay null."""
    mean = cells.agg(F.avg(value)).first()[0]
    filled = cells.select("r", "c", F.col(value).isNull().alias("gap"), F.coalesce(value, F.lit(mean)).alias(value))
    run = _convolve(gaussian_weights(sigma))
    done = _both(filled, grid, value, run, run)
    return done.join(filled.select("r", "c", "gap"), ["r", "c"]).select("r", "c", F.when(~F.col("gap"), F.col(value)).alias(value))


def median(cells: DataFrame, grid: Grid, size: int = 3, value: str = "z") -> DataFrame:
    """Median of ``size`` by ``size`` cells, edges mirrored; of an even number the upper middle: (r, c, value).

    Bands of rows carry the rows above and below that their windows reach.
    """
    low, high = size // 2, size - 1 - size // 2
    n, m = grid.ncols, grid.nrows
    bands = F.array_distinct(F.expr(f"transform(sequence(-{high}, {low}), d -> (r + d) div {BAND})"))
    held = cells.select("r", "c", F.col(value).alias("v"), F.explode(F.filter(bands, lambda b: (b >= 0) & (b <= (m - 1) // BAND))).alias("band"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        first, last = band * BAND, min((band + 1) * BAND, m)
        a = pdf["r"].min()
        block = np.full((pdf["r"].max() - a + 1, n), np.nan)
        block[pdf["r"] - a, pdf["c"]] = pdf["v"].to_numpy(np.float64, na_value=np.nan)
        mirror = lambda i, k: np.where((j := i % (2 * k)) < k, j, 2 * k - 1 - j)
        rows = mirror(np.arange(first - low, last + high), m) - a
        cols = mirror(np.arange(-low, n + high), n)
        windows = np.lib.stride_tricks.sliding_window_view(block[np.clip(rows, 0, len(block) - 1)][:, cols], (size, size))
        done = np.sort(windows.reshape(last - first, n, -1), axis=2)[:, :, size * size // 2]
        return pd.DataFrame({"r": np.repeat(np.arange(first, last), n), "c": np.tile(np.arange(n), last - first), value: done.ravel()})

    return held.groupBy("band").applyInPandas(run, f"r long, c long, {value} double").withColumn(value, F.nanvl(value, F.lit(None)))


def smooth(cells: DataFrame, grid: Grid, method: str = "gaussian", sigma: float = 1.5, size: int = 3, kc: float | None = None, value: str = "z") -> DataFrame:
    """Smoothing of results by name; an unknown name is an error."""
    if method == "gaussian":
        return gaussian(cells, grid, sigma, value)
    if method == "median":
        return median(cells, grid, size, value)
    if method == "fft_lowpass":
        return lowpass(cells, grid, 1.0 if kc is None else kc, value, per_cell=False, keep_null=True)
    raise ValueError(f"unknown smoothing method {method!r}")
