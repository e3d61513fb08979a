"""Which models meet a domain, turned or not."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.operators import footprints, grids, meshes
from tetrafield.plans import config
from tetrafield.queries import QUERIES, SQL
from tetrafield.sinks import formats
from tetrafield.sources import tables

MODELS = "model_id int, name string, priority int, vertical string, model_type int"


def test_query(spark):
    assert_same(QUERIES["models_in_turned_domain"](spark, SF), SQL["models_in_turned_domain"])
    own = QUERIES["models_in_turned_domain"](spark, SF).count()
    assert 0 < own < spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_no_model_that_meets_is_left_out(spark):
    """Clouds of points against turned rectangles, lines and points: a footprint's polygon holds its cloud, and polygons that are apart by more than its corners can add are found apart."""
    rng = np.random.default_rng(3)
    clouds = rng.uniform(-1, 1, (60, 12, 2)) * rng.uniform(0.2, 2, (60, 1, 1)) + rng.uniform(-8, 8, (60, 1, 2))
    rows = spark.createDataFrame([(m, float(x), float(y)) for m, own in enumerate(clouds) for x, y in own], "model_id int, x double, y double")
    own = footprints.footprints(rows, 0.0).persist()
    for turn, half in ((0.3, (4.0, 1.0)), (1.1, (3.0, 0.0)), (0.0, (0.0, 0.0)), (2.4, (0.5, 5.0))):
        r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        outline = [tuple(map(float, r @ p)) for p in ((-half[0], -half[1]), (half[0], -half[1]), half, (-half[0], half[1]))]
        kept = {m for (m,) in footprints.prune(own, outline).select("model_id").collect()}
        for m, cloud in enumerate(clouds):
            local = np.abs(cloud @ r) - half
            inside = (local.max(axis=1) <= 0).any()
            far = np.hypot(*np.maximum(local, 0).T).min() > 2 * np.ptp(cloud, axis=0).max() + 0.1
            assert m in kept if inside else not (far and m in kept)


def test_meshes_that_miss_are_not_read(spark, tmp_path):
    for name, x0 in (("near", 0.0), ("far", 1e6)):
        v, t = meshes.grid_mesh(spark, 0, (x0, 0, 0), (1, 1, 1), (2, 2, 2), rho=1.0, vp=2.0, vs=1.0, qp=1.0, qs=1.0)
        formats.write_mesh(spark.createDataFrame([(0, name, 200, "elevation", 1)], MODELS), v, t, f"{tmp_path}/{name}.mesh")
    for file in os.listdir(tmp_path / "far.mesh/vertices"):
        if file.endswith(".parquet"):
            raw = (tmp_path / "far.mesh/vertices" / file).read_bytes()
            (tmp_path / "far.mesh/vertices" / file).write_bytes(b"x" * 32 + raw[32:])  # its footer is whole, its values aren't
            (tmp_path / "far.mesh/vertices" / f".{file}.crc").unlink(missing_ok=True)
    paths = [f"{tmp_path}/{n}.mesh" for n in ("near", "far")]
    outline = [(0.5, -1.0), (3.0, 1.5), (0.5, 4.0), (-2.0, 1.5)]
    models, vertices, tets = tables.read_meshes(spark, paths, lambda m: footprints.prune(m, outline))
    assert [r.name for r in models.collect()] == ["near"] and vertices.count() == 8 and tets.count() > 0
    assert {r.model_id for r in vertices.select("model_id").distinct().collect()} == {r.model_id for r in models.collect()}
    assert not any("far.mesh/vertices" in f or "far.mesh/tets" in f for f in vertices.inputFiles() + tets.inputFiles())
    # a mesh without a stored footprint gets one from its vertices
    bare = spark.read.parquet(f"{paths[0]}/models").drop("footprint")
    bare.write.parquet(f"{tmp_path}/bare.mesh/models")
    for table in ("vertices", "tets"):
        spark.read.parquet(f"{paths[0]}/{table}").write.parquet(f"{tmp_path}/bare.mesh/{table}")
    both = tables.read_meshes(spark, [f"{tmp_path}/bare.mesh", paths[1]], lambda m: footprints.prune(m, outline))
    assert [r.name for r in both[0].collect()] == ["near"]


def test_domain_of_a_turned_request(spark):  # nodes begin half a cell before the middle
    frame = grids.Frame(100.0, 50.0, 30.0)
    points = grids.regular(spark, lambda rows, name: rows.withColumn(name, F.lit(2.0)), 8.0, 4.0, 1.0, 1.0, 1.0, 1.0, frame)
    outline, ground = config.looked_at(points, frame)
    want = {tuple(np.round((frame.matrix @ [sx * 4 - 0.5, sy * 2 - 0.5, 1])[:2], 6)) for sx in (-1, 1) for sy in (-1, 1)}
    assert {tuple(np.round(p, 6)) for p in outline} == want and ground == pytest.approx((2.0, 2.0))
