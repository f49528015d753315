"""Resampling, terrain, noise, masks, walkers, files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater import cli
from catchwater.functions.columns import resolved
from catchwater.operators import masks, noise, particles, resample, scan, terrain
from catchwater.operators.grid import from_matrix
from catchwater.sources import files
from catchwater.streaming.forcing import rain_totals


def test_halving(spark):
    z = np.array([[1, 2, 5, 6], [3, 4, 7, 8], [9, 10, 13, 14], [11, 12, 15, 16]], float)
    raster = from_matrix(spark, z)
    mean, most, least = (resample.halve(raster, m).matrix("z") for m in ("mean", "max", "min"))
    assert mean.tolist() == [[2.5, 6.5], [10.5, 14.5]] and (most >= mean).all() and (mean >= least).all()
    plane = from_matrix(spark, np.add.outer(np.arange(8.0), np.arange(8.0)))
    assert np.allclose(resample.halve(plane, "cubic").matrix("z")[1:3, 1:3], [[5, 7], [7, 9]])
    odd = resample.halve(from_matrix(spark, np.ones((3, 5))))
    assert (odd.meta.ny, odd.meta.nx) == (2, 3)
    own = resample.halve(raster, block=lambda r: r.cells.where("row % 2 = 0 and col % 2 = 0").select((F.col("row") / 2).cast("long").alias("row"), (F.col("col") / 2).cast("long").alias("col"), F.lit(1.0).alias("z")))
    assert own.matrix("z").tolist() == [[1, 1], [1, 1]]
    for bad in ({"method": "median"}, {"boundary": "void"}):
        with pytest.raises(ValueError):
            resample.halve(raster, **bad)


def test_doubling(spark):
    raster = from_matrix(spark, np.arange(16.0).reshape(4, 4))
    a, b, c = (resample.double(raster, 0.5, seed).matrix("z") for seed in (42, 42, 43))
    assert (a == b).all() and (a != c).any() and a.shape == (8, 8)
    small = from_matrix(spark, np.array([[1.0, 2], [3, 4]]))
    assert (resample.double(small).matrix("z") != resample.double(small, boundary="wrap").matrix("z")).any()


def test_resizing(spark):
    plane = from_matrix(spark, np.add.outer(np.arange(4.0), np.arange(4.0)))
    assert resample.resize(plane, 0.5).matrix("z").tolist() == [[1, 3], [3, 5]]
    assert resample.resize_longest(plane, 9) is plane and resample.resize_longest(plane, 2).meta.nx == 2
    with pytest.raises(ValueError):
        resample.resize(plane, 0)


def test_index_rules(spark):
    x = spark.range(-5, 9).select("id", *[resolved(F.col("id"), 4, b).alias(b) for b in resample.BOUNDARIES], resolved(F.col("id"), 1, "reflect").alias("one"))
    for r in x.collect():
        k = r["id"]
        assert r["clamp"] == min(max(k, 0), 3) and r["wrap"] == k % 4 and r["reflect"] == min(k % 6, 6 - k % 6) and r["one"] == 0


def test_hillshade(spark):
    raster = from_matrix(spark, np.random.default_rng(0).random((6, 7)) * 9)
    shade = [r["shade"] for r in terrain.hillshade(raster, azimuths=terrain.FOUR).collect()]
    assert all(0 <= s <= 1 for s in shade)
    flat = {round(r["shade"], 9) for r in terrain.hillshade(from_matrix(spark, np.zeros((3, 3)))).collect()}
    assert flat == {round(np.cos(np.pi / 4), 9)}
    for bad in ({"azimuths": ()}, {"weights": (1, 2)}, {"weights": (-1,)}):
        with pytest.raises(ValueError):
            terrain.hillshade(raster, **bad)
    assert all(terrain.styled(raster, s).count() == 42 for s in list(terrain.STYLES)[:2])
    with pytest.raises(ValueError):
        terrain.styled(raster, "none")


def test_noise_depends_on_seed_alone(spark):
    for make in (noise.white, noise.red, noise.perlin, noise.autoregressive):
        a, b, c = (make(spark, 12, 8, seed=s).matrix("z") for s in (1, 1, 2))
        assert (a == b).all() and (a != c).any() and np.isfinite(a).all()
    assert abs(noise.red(spark, 16, 8, amplitude=3.0).matrix("z")).max() == pytest.approx(3.0)


def test_prefix_sum(spark):
    df = spark.createDataFrame(list(enumerate([3, 1, 7, 0, 4, 1, 6, 3])), "i long, x long")
    assert [r["total"] for r in scan.prefix_sum(df, block=3).orderBy("i").collect()] == [3, 4, 11, 11, 15, 16, 22, 25]


def test_masks(spark):
    raster = from_matrix(spark, np.arange(30.0).reshape(5, 6), boundaries=np.ones((5, 6)))
    assert raster.cells.where(masks.inside_polygon([(0, 0), (1, 1)], F.col("col"), F.col("row"))).count() == 0
    lasso = masks.lasso_outlets(raster, F.col("bc") == 0, [(-1, -1), (2.5, -1), (2.5, 9), (-1, 9)])
    assert lasso.cells.where("bc = 3").count() == 9  # the left column and both ends of the next two
    painted = masks.brush(raster.with_columns(p=F.lit(0.0)), "p", [(2, 3)], 2, 1.0)
    assert painted.cells.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    shared = masks.lasso_rain(raster.with_columns(p=F.lit(0.0)), "p", [(-1, -1), (9, -1), (9, 9), (-1, 9)], 3.0, additive=False)
    assert shared.cells.agg(F.sum("p")).first()[0] == pytest.approx(3.0)


def test_walkers(spark):
    raster = from_matrix(spark, np.random.default_rng(3).random((6, 8))).with_columns(h=F.lit(0.0))
    walkers = particles.placed(raster, 20, 1)
    assert particles.histogram(walkers).agg(F.sum("n")).first()[0] == 20
    wet, after = particles.collision_step(raster, walkers, 2)
    assert after.count() == 20 and wet.cells.where("h < 0").count() == 0


def test_files(spark, tmp_path):
    z = np.random.default_rng(1).random((6, 4)).astype(np.float32)
    np.save(tmp_path / "a.npy", z)
    assert np.allclose(files.read_raster(spark, str(tmp_path / "a.npy")).matrix("z"), z)
    raster = from_matrix(spark, z, dx=2.0)
    files.write_tiff(raster, str(tmp_path / "a.tif"))
    back = files.read_raster(spark, str(tmp_path / "a.tif"))
    assert back.meta.dx == 2.0 and (back.matrix("z") == z).all()
    files.write_cells(raster, str(tmp_path / "cells"))
    assert files.read_cells(spark, str(tmp_path / "cells")).meta == raster.meta
    files.write_png(raster, str(tmp_path / "a.png"), 16)
    assert (tmp_path / "a.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"


def test_commands(spark, tmp_path, capsys):
    np.save(tmp_path / "a.npy", np.array([[1.0, 2], [3, 4]]))
    up, down = str(tmp_path / "up.tif"), str(tmp_path / "down.npy")
    assert cli.main(["upscale", str(tmp_path / "a.npy"), up], spark) == 0
    assert cli.main(["downscale", up, down, "-m", "max", "-v"], spark) == 0
    assert np.load(down).shape == (2, 2) and "2 x 2" in capsys.readouterr().out
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    assert cli.main(["to-png", str(tmp_path / "bad.npy"), down], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["upscale"], spark)


def test_streamed_rain(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 0, 1, 1.5), ("2024-01-01 00:04:00", 0, 1, 0.5), ("2024-01-01 00:12:00", 2, 3, 1.0)]
    spark.createDataFrame(rows, "ts string, row int, col int, amount double").selectExpr("cast(ts as timestamp) ts", "row", "col", "amount").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, row int, col int, amount double").parquet(str(tmp_path / "in"))
    q = rain_totals(stream, 10).writeStream.format("memory").queryName("rain").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["i"], r["rain"], r["n"]) for r in spark.table("rain").collect()) == [(1, 2.0, 2), (23, 1.0, 1)]
