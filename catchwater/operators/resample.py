"""Resampling: halving by blocks, doubling with kept slopes, bilinear resizing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import resolved, uniform
from catchwater.operators.grid import D4, Meta, Raster, gather

METHODS = ("mean", "max", "min", "cubic")
BOUNDARIES = ("clamp", "wrap", "reflect")


def _check(boundary: str) -> None:
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {', '.join(BOUNDARIES)}")


def padded(raster: Raster) -> Raster:
    """Even shape: the last row and column repeated where they are odd."""
    nx, ny = raster.meta.nx, raster.meta.ny
    if not nx % 2 and not ny % 2:
        return raster
    repeat = lambda name, n: F.when((F.col(name) == n - 1) & F.lit(bool(n % 2)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cells = raster.cells.withColumn("dr", F.explode(repeat("row", ny))).withColumn("dc", F.explode(repeat("col", nx)))
    wide = nx + nx % 2
    cells = cells.withColumns({"row": F.col("row") + F.col("dr"), "col": F.col("col") + F.col("dc")}).drop("dr", "dc")
    return Raster(cells.withColumn("i", F.col("row") * wide + F.col("col")), replace(raster.meta, nx=wide, ny=ny + ny % 2))


def _cells(df: DataFrame, nx: int) -> DataFrame:
    return df.select((F.col("row") * nx + F.col("col")).alias("i"), "row", "col", "z")


def halve(raster: Raster, method: str = "mean", boundary: str = "clamp", block: Callable[[Raster], DataFrame] | None = None) -> Raster:
    """Blocks of 2 x 2 cells become one; odd shapes are padded. block: an own function from the padded raster to (row, col, z)."""
    if block is None and method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    _check(boundary)
    raster = padded(raster)
    meta = replace(raster.meta, nx=raster.meta.nx // 2, ny=raster.meta.ny // 2, dx=raster.meta.dx * 2)
    if block is not None:
        out = block(raster)
    elif method == "cubic":
        out = _cubic(raster, boundary)
    else:
        how = {"mean": F.avg, "max": F.max, "min": F.min}[method]
        out = raster.cells.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(how("z").alias("z"))
    return Raster(_cells(out, meta.nx), meta)


def _cubic(raster: Raster, boundary: str) -> DataFrame:
    """Catmull-Rom sample at each block's centre; a source cell is sent to the blocks that use it, so no join."""
    nx, ny = raster.meta.nx, raster.meta.ny
    weights = (-1 / 16, 9 / 16, 9 / 16, -1 / 16)
    taps = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c"), F.lit(weights[a] * weights[b]).alias("w")) for a in range(4) for b in range(4)]))
    blocks = raster.cells.sparkSession.range((nx // 2) * (ny // 2)).select(F.floor(F.col("id") / (nx // 2)).alias("row"), F.pmod("id", F.lit(nx // 2)).alias("col"), taps.alias("t"))
    r, c = resolved(F.col("row") * 2 - 1 + F.col("t.r"), ny, boundary), resolved(F.col("col") * 2 - 1 + F.col("t.c"), nx, boundary)
    wanted = blocks.select("row", "col", (r * nx + c).cast("long").alias("i"), F.col("t.w").alias("w"))
    return wanted.join(raster.cells.select("i", "z"), "i").groupBy("row", "col").agg(F.sum(F.col("z") * F.col("w")).alias("z"))


def double(raster: Raster, noise: float = 0.0, seed: int = 0, boundary: str = "clamp") -> Raster:
    """Each cell becomes 2 x 2 along its unit gradient, with seeded noise in proportion to the slope."""
    _check(boundary)
    nx, ny = raster.meta.nx, raster.meta.ny
    around = Raster(raster.cells, Meta(nx, ny, raster.meta.dx, "normal"))
    if boundary == "clamp":
        near = gather(around, "z")
    else:
        near = raster.cells
        for d, dr, dc in D4:
            at = resolved(F.col("row") + dr, ny, boundary) * nx + resolved(F.col("col") + dc, nx, boundary)
            side = raster.cells.select(F.col("i").alias(f"i_{d}"), F.col("z").alias(f"z_{d}"))
            near = near.withColumn(f"i_{d}", at.cast("long")).join(side, f"i_{d}", "left")
    z = F.col("z")
    difference = lambda a, b: F.coalesce(z - F.col(a), F.lit(0.0)) + F.coalesce(F.col(b) - z, F.lit(0.0))
    count = sum((F.col(f"z_{d}").isNotNull().cast("int") for d, _, _ in D4), F.lit(0))
    gx, gy = difference("z_l", "z_r") / F.greatest(count, F.lit(1)), difference("z_t", "z_b") / F.greatest(count, F.lit(1))
    size = F.sqrt(gx * gx + gy * gy)
    unit = lambda g: F.when(size > 1e-8, g / size).otherwise(F.lit(0.0))
    df = near.withColumns({"ux": unit(gx), "uy": unit(gy)}).withColumn("strength", (F.abs("ux") + F.abs("uy")) * 0.25)
    df = df.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    row, col = F.col("row") * 2 + F.col("b"), F.col("col") * 2 + F.col("a")
    i = row * (2 * nx) + col
    value = z + (F.col("ux") * (F.col("a") - 0.5) + F.col("uy") * (F.col("b") - 0.5)) * F.col("strength")
    if noise:
        value = value + (uniform(seed, i) * 2 - 1) * F.lit(noise * 0.1) * F.col("strength")
    return Raster(df.select(i.alias("i"), row.alias("row"), col.alias("col"), value.alias("z")), replace(raster.meta, nx=2 * nx, ny=2 * ny, dx=raster.meta.dx / 2))


def resize_to(raster: Raster, nx: int, ny: int, boundary: str = "clamp") -> Raster:
    """Bilinear at pixel centres to an exact shape."""
    _check(boundary)
    if nx < 1 or ny < 1:
        raise ValueError("a raster has at least one cell")
    sx, sy = raster.meta.nx, raster.meta.ny
    target = raster.cells.sparkSession.range(nx * ny).select(F.col("id").alias("i"), F.floor(F.col("id") / nx).alias("row"), F.pmod("id", F.lit(nx)).alias("col"))
    x, y = (F.col("col") + 0.5) * sx / nx - 0.5, (F.col("row") + 0.5) * sy / ny - 0.5
    df = target.withColumns({"x0": F.floor(x), "y0": F.floor(y), "fx": x - F.floor(x), "fy": y - F.floor(y)})
    df = df.withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    weight = F.when(F.col("t.a") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("t.b") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    source = resolved(F.col("y0") + F.col("t.b"), sy, boundary) * sx + resolved(F.col("x0") + F.col("t.a"), sx, boundary)
    taps = df.select("i", "row", "col", source.cast("long").alias("src"), weight.alias("w")).where("w <> 0")
    out = taps.join(raster.cells.select(F.col("i").alias("src"), "z"), "src").groupBy("i", "row", "col").agg(F.sum(F.col("z") * F.col("w")).alias("z"))
    return Raster(out, replace(raster.meta, nx=nx, ny=ny, dx=raster.meta.dx * sx / nx))


def resize(raster: Raster, scale: float, boundary: str = "clamp") -> Raster:
    if scale <= 0:
        raise ValueError("the scale must be positive")
    return resize_to(raster, max(1, round(raster.meta.nx * scale)), max(1, round(raster.meta.ny * scale)), boundary)


def resize_longest(raster: Raster, longest: int) -> Raster:
    """Unchanged if the longest side is short enough."""
    most = max(raster.meta.nx, raster.meta.ny)
    return raster if most <= longest else resize(raster, longest / most)
