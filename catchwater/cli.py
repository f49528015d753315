"""python -m catchwater.cli COMMAND IN OUT: rasters from file to file."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from catchwater.operators.resample import BOUNDARIES, METHODS, double, halve
from catchwater.sources import files


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="catchwater", description="Rasters from file to file.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("upscale", "twice the cells on each axis"), ("downscale", "half the cells on each axis"), ("to-npy", "an array file"), ("to-png", "a grey picture")):
        own = commands.add_parser(name, help=what)
        own.add_argument("source")
        own.add_argument("target")
        own.add_argument("-v", "--verbose", action="store_true")
        if name == "upscale":
            own.add_argument("-n", "--noise", type=float, default=0.0)
            own.add_argument("-s", "--seed", type=int, default=0)
        if name == "downscale":
            own.add_argument("-m", "--method", choices=METHODS, default="mean")
            own.add_argument("-b", "--boundary", choices=BOUNDARIES, default="clamp")
        if name == "to-png":
            own.add_argument("--bits", type=int, choices=(8, 16), default=8)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("catchwater").getOrCreate()
    try:
        raster = files.read_raster(spark, a.source)
        if a.command == "upscale":
            raster = double(raster, a.noise, a.seed)
        elif a.command == "downscale":
            raster = halve(raster, a.method, a.boundary)
        if a.command == "to-png":
            files.write_png(raster, a.target, a.bits)
        elif a.target.endswith(".npy") or a.command == "to-npy":
            low, high = files.write_npy(raster, a.target)
            if a.verbose:
                print(f"{raster.meta.ny} x {raster.meta.nx}, {low} to {high}")
        else:
            files.write_tiff(raster, a.target)
        return 0
    except (OSError, ValueError, PySparkException) as e:
        print(f"catchwater: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
