"""Column expressions: seeded uniforms, index rules at the borders of a raster, guards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


# The 32-bit integer hash (shifts, multiplier) behind seeded resampling noise, so that seeds give known rasters.
def uniform(seed: int, index: Column) -> Column:
    """A number in [0, 1] that depends on seed and the index's lower 32 bits alone, however rows are partitioned or retried.

    For the noise of resampling; draws over many cells and rounds take drawn().
    """
    m = F.lit(_MASK)
    x = (index.cast("long") + F.lit(seed)).bitwiseAND(m)
    x = x.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = (x + F.shiftleft(x, 3)).bitwiseAND(m)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 4))
    x = (x * F.lit(0x27D4EB2D)).bitwiseAND(m)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    return x / F.lit(4294967295.0)


def drawn(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for each combination of whole keys, from 52 bits of the MD5 of seed and keys, joined by commas.

    Keys are told apart whatever their size, and any engine can repeat a draw.
    """
    text = F.concat_ws(",", F.lit(str(seed)), *(k.cast("long").cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def larger(a, b):
    """The larger of two columns or numpy arrays."""
    return F.greatest(a, b) if isinstance(a, Column) else np.maximum(a, b)


def lesser(a, b):
    """The lesser of two columns or numpy arrays."""
    return F.least(a, b) if isinstance(a, Column) else np.minimum(a, b)


def resolved(index: Column, n: int, boundary: str) -> Column:
    """The index inside 0 .. n-1 that an outside one stands for: clamp, wrap or reflect (about the border samples)."""
    if boundary == "clamp":
        return F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))
    if boundary == "wrap":
        return F.pmod(index, F.lit(n))
    if boundary == "reflect":
        if n == 1:
            return index * 0
        k = F.pmod(index, F.lit(2 * n - 2))
        return F.least(k, F.lit(2 * n - 2) - k)
    raise ValueError(f"boundary must be clamp, wrap or reflect, not {boundary!r}")


def positive_slope(a: Column, b: Column, dx: float) -> Column:
    """max(0, (a - b) / dx); 0 where b is missing."""
    return F.greatest(F.lit(0.0), F.coalesce((a - b) / F.lit(dx), F.lit(0.0)))


def sign(x: Column) -> Column:
    """1 for zero and above, else -1."""
    return F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
