"""Noise rasters that depend on their seed alone."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.functions.columns import drawn
from catchwater.operators.grid import Meta, Raster
from catchwater.plans.iterate import written

# Gradients by the low three bits of a hash (four diagonals, four axes).
GRADIENTS = ((1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1))


def _cells(spark: SparkSession, nx: int, ny: int):
    return spark.range(nx * ny).select(F.col("id").alias("i"), F.floor(F.col("id") / nx).alias("row"), F.pmod("id", F.lit(nx)).alias("col"))


def white(spark: SparkSession, nx: int, ny: int, amplitude: float = 1.0, seed: int = 42) -> Raster:
    """Uniform between -amplitude and amplitude."""
    return Raster(_cells(spark, nx, ny).withColumn("z", (drawn(seed, F.col("i")) * 2 - 1) * amplitude), Meta(nx, ny))


#: Rows or columns in a band, of which a task transforms one.
BAND = 64


def _bands(df: DataFrame, key: str, order: str, n: int, change: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(row, col, re, im) after `change` of the complex matrix of each band of rows (key) of n values; it gets the rows' numbers too."""
    schema = "row long, col long, re double, im double"

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(key, "ascending"), (order, "ascending")])
        lines = np.asarray(part[key]).reshape(-1, n)[:, 0]
        x = change(lines, (np.asarray(part["re"]) + 1j * np.asarray(part["im"])).reshape(-1, n)).ravel()
        return pa.table([part["row"], part["col"], pa.array(x.real), pa.array(x.imag)], names=["row", "col", "re", "im"])

    return df.withColumn("band", F.floor(F.col(key) / BAND)).groupBy("band").applyInArrow(_unbanded(run), schema)


def _unbanded(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def call(part: pa.Table) -> pa.Table:
        return run(part.drop_columns(["band"]))

    return call


def red(spark: SparkSession, nx: int, ny: int, amplitude: float = 1.0, seed: int = 42, exponent: float = 1.0) -> Raster:
    """White noise whose spectrum falls as 1 / |k|**exponent, k in cycles a cell, without mean, scaled to the amplitude.

    The transform is separable: bands of rows, then bands of columns are transformed, the spectrum is scaled while columns
    are at hand, and both are transformed back. A task holds a band of BAND lines.
    """
    base = white(spark, nx, ny, 1.0, seed).cells.select("row", "col", F.col("z").alias("re"), F.lit(0.0).alias("im"))

    def scaled(cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        ky, kx = np.fft.fftfreq(ny)[None, :], np.fft.fftfreq(nx)[cols][:, None]
        k = np.hypot(ky, kx)
        spectrum = np.fft.fft(x, axis=1) / np.where(k == 0, 1.0, k) ** exponent
        return np.fft.ifft(np.where(k == 0, 0, spectrum), axis=1)

    rows = _bands(base, "row", "col", nx, lambda _, x: np.fft.fft(x, axis=1))
    both = _bands(rows, "col", "row", ny, scaled)
    z = written(_bands(both, "row", "col", nx, lambda _, x: np.fft.ifft(x, axis=1)).select("row", "col", F.col("re").alias("z")), "noise")
    mean, low, high = z.agg(F.avg("z"), F.min("z"), F.max("z")).first()
    most = max(high - mean, mean - low, 1e-12) if mean is not None else 1.0
    return Raster(z.select((F.col("row") * nx + F.col("col")).alias("i"), "row", "col", ((F.col("z") - F.lit(mean)) * F.lit(amplitude / most)).alias("z")), Meta(nx, ny))


def autoregressive(spark: SparkSession, nx: int, ny: int, amplitude: float = 1.0, decay: float = 0.8, seed: int = 42) -> Raster:
    """First-order recurrences along rows, then along columns: x[k] = decay x[k - 1] + sqrt(1 - decay**2) e[k]."""
    base = white(spark, nx, ny, 1.0, seed).cells.select("row", "col", F.col("z").alias("re"), F.lit(0.0).alias("im"))

    def run(_: np.ndarray, x: np.ndarray) -> np.ndarray:
        out, last = np.empty_like(x), np.zeros(len(x), x.dtype)
        for k in range(x.shape[1]):
            out[:, k] = last = decay * last + x[:, k] * math.sqrt(1 - decay**2)
        return out

    out = _bands(_bands(base, "row", "col", nx, run), "col", "row", ny, run)
    return Raster(out.select((F.col("row") * nx + F.col("col")).alias("i"), "row", "col", (F.col("re") * amplitude).alias("z")), Meta(nx, ny))


def permutation(seed: int) -> list[int]:
    """0 .. 255 shuffled by a linear congruential generator, so that any engine can repeat it."""
    p, state = list(range(256)), seed & 0x7FFFFFFF
    for k in range(255, 0, -1):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        j = state % (k + 1)
        p[k], p[j] = p[j], p[k]
    return p


def _fade(t: Column) -> Column:
    return t * t * t * (t * (t * 6 - 15) + 10)


def _perlin_at(x: Column, y: Column, p: Column) -> Column:
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    at = lambda k: F.get(p, F.pmod(k, F.lit(256)).cast("int"))
    gx, gy = (F.array(*[F.lit(float(g[k])) for g in GRADIENTS]) for k in (0, 1))

    def corner(dx: int, dy: int) -> Column:
        h = F.pmod(at(at(x0 + dx) + y0 + dy), F.lit(8)).cast("int")
        return F.get(gx, h) * (fx - dx) + F.get(gy, h) * (fy - dy)

    u, v = _fade(fx), _fade(fy)
    low = corner(0, 0) + u * (corner(1, 0) - corner(0, 0))
    high = corner(0, 1) + u * (corner(1, 1) - corner(0, 1))
    return low + v * (high - low)


def perlin(spark: SparkSession, nx: int, ny: int, frequency: float = 8.0, octaves: int = 4, persistence: float = 0.5, amplitude: float = 1.0, seed: int = 42, frequency_x: float | None = None, frequency_y: float | None = None) -> Raster:
    """Octaves of gradient noise, divided by their summed amplitudes."""
    fx, fy = frequency if frequency_x is None else frequency_x, frequency if frequency_y is None else frequency_y
    p = F.array(*[F.lit(k) for k in permutation(seed)])
    cells, total, scale = _cells(spark, nx, ny).withColumn("p", p), F.lit(0.0), 0.0
    for o in range(octaves):
        strength = persistence**o
        total = total + F.lit(strength) * _perlin_at(F.col("col") * F.lit(fx * 2**o / nx), F.col("row") * F.lit(fy * 2**o / ny), F.col("p"))
        scale += strength
    return Raster(cells.select("i", "row", "col", (total * F.lit(amplitude / max(scale, 1e-12))).alias("z")), Meta(nx, ny))
