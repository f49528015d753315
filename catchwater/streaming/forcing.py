"""Rain gauges as a stream: volume for each cell and window of event time, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rain_totals(events: DataFrame, nx: int, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, i, rain, n) of a stream or table of (ts, row, col, amount)."""
    keyed = events.select("ts", (F.col("row") * nx + F.col("col")).cast("long").alias("i"), "amount")
    totals = keyed.withWatermark("ts", late).groupBy(F.window("ts", window), "i").agg(F.sum("amount").alias("rain"), F.count("*").alias("n"))
    return totals.select(F.col("window.start").alias("start"), "i", "rain", "n")
