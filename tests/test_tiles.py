"""Surfaces by tile: windows, frames, and what a scan leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.operators import tiles
from tetrafield.plans import config
from tetrafield.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """50 x 30 nodes of 10 m, z = x + 100 y in the raster's coordinates, turned by 30 degrees; one node is missing."""
    at = str(tmp_path_factory.mktemp("tiles") / "dem.surface")
    c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
    nodes = spark.range(1500).select((F.col("id") % 50).alias("ix"), F.floor(F.col("id") / 50).alias("iy")).withColumn("z", F.when(F.col("ix") * F.col("iy") != 100, F.col("ix") * 10.0 + F.col("iy") * 1000.0))
    tiles.write(nodes, at, (50, 30), (0.0, 0.0), (10.0, 10.0), [[c, s, -1000.0], [-s, c, 500.0]], tile=16)
    return at


@pytest.mark.parametrize("name", ["surface_window", "surface_rotated"])
def test_queries(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


def test_frame_and_its_inverse(spark, path):
    own = tiles.read(spark, path)
    for x, y in own.corners:
        fx, fy = own.place(x, y)
        assert min(abs(fx), abs(fx - 490)) < 1e-6 and min(abs(fy), abs(fy - 290)) < 1e-6
    with pytest.raises(ValueError):
        tiles.write(spark.range(4).selectExpr("id % 2 AS ix", "id div 2 AS iy", "1.0 AS z"), path + "2", (2, 2), frame=[[1, 1, 0], [1, 1, 0]])


def test_samples(spark, path):
    own = tiles.read(spark, path)
    probes = [(3.5, 7.25), (489.9, 289.9), (160.0, 159.999), (50.0, 205.0), (-5.0, 10.0), (500.0, 300.0)]
    inverse = np.asarray(own.inverse)
    rows = [(n, *map(float, inverse @ (fx, fy, 1.0))) for n, (fx, fy) in enumerate(probes)]
    points = spark.createDataFrame([*rows, (9, None, 1.0)], "n int, x double, y double")
    got = {r.n: r.s for r in own.sample(points, "s").collect()}
    assert [got[n] for n in range(3)] == pytest.approx([fx + 100 * fy for fx, fy in probes[:3]]) and got[3] is None and got[4] is None and got[9] is None
    got = {r.n: r.s for r in own.sample(points, "s", extrapolate=True, outline=own.corners.tolist()).collect()}
    assert got[4] == pytest.approx(1000.0) and got[5] == pytest.approx(490 + 29_000)


def test_a_window_reads_its_tiles_only(spark, path):
    own = tiles.read(spark, path)
    inverse = np.asarray(own.inverse)
    outline = [tuple(inverse @ (x, y, 1.0)) for x in (20.0, 40.0) for y in (180.0, 200.0)]
    nodes = own.window(outline)
    assert own.numbers(outline) == ((0, 6), (16, 22))
    assert {(r.ix, r.iy) for r in nodes.collect()} == {(i, j) for i in range(6) for j in range(16, 22)}
    for frame in (nodes, own.sample(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), outline=outline)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(tile_x" in plan and "(tile_x" in plan and "Window" not in plan
    files = {r[0] for r in own.cells(*own.numbers(outline)).select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1 and "tile_x=0/tile_y=1" in files.pop()
    blocks = own.window(outline, spacing=40.0).orderBy("ix", "iy").collect()
    assert {(r.ix, r.iy) for r in blocks} == {(i, j) for i in range(3) for j in range(3, 7)}
    first = next(r for r in blocks if (r.ix, r.iy) == (0, 4))
    assert own.place(first.x, first.y) == pytest.approx((15.0, 175.0)) and first.z == pytest.approx(15 + 17_500)
    assert own.value_range(outline).first().lowest == 16_000


def test_degrees(spark):
    outline = tiles.degrees_outline(-43.6, -43.5, 172.5, 172.7)
    assert len(outline) == 84 and all(1.5e6 < x < 1.6e6 and 5.1e6 < y < 5.3e6 for x, y in outline)


def test_a_request_on_a_tiled_surface(spark, path):
    own = tiles.read(spark, path)
    x, y = np.asarray(own.inverse) @ (200.0, 100.0, 1.0)
    grid = {"type": "regular", "surface": path, "extent_x": 20.0, "extent_y": 20.0, "thickness": 10.0, "resolution_x": 10.0, "resolution_y": 10.0, "resolution_z": 5.0, "orientation": {"origin_x": float(x), "origin_y": float(y)}}
    made = config.run(spark, config.Request(grid, [{"type": "constant", "vs": 1.0, "alpha": 1.0}]))
    fx, fy = own.to_frame(F.col("x"), F.col("y"))
    assert made.filter(F.abs(F.col("z") - F.col("depth") - (fx + 100 * fy)) > 1e-6).isEmpty() and made.count() == 27
