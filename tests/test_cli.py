"""Commands from a synthetic world's inputs to a sampled model."""

import pytest
from pyspark.sql import functions as F

from tetrafield import cli
from tetrafield.functions import crs, synthetic
from tetrafield.plans import construction
from tetrafield.sources import tables

REQUEST = """
[grid]
type = "regular"
surface = "$WORLD/surface.parquet"
extent_x = 4000.0
extent_y = 4000.0
thickness = 600.0
resolution_x = 1000.0
resolution_y = 1000.0
resolution_z = 200.0
[grid.orientation]
origin_lon = 172.15
origin_lat = -43.70
azimuth = 0.0
[[layers]]
type = "query"
model_path = "$WORLD/meshes"
model_globs = ["*.mesh"]
"""


def test_from_inputs_to_a_model(spark, tmp_path, monkeypatch):
    world = tmp_path / "world"
    assert cli.main(["synthetic", str(world), "--spacing", "2000"]) == 0
    assert cli.main(["tomography", f"{world}/tomography.txt", f"{world}/meshes/tomography.mesh"]) == 0
    assert cli.main(["basin", f"{world}/gully.geojson", f"{world}/basins.parquet", f"{world}/meshes/gully.mesh", "--name", "gully", "--bottom", "gully", "--ground", "ground", "--model", f"{world}/profile.txt", "--tolerance", "60", "--max-edge", "6000", "--no-pad-top"]) == 0
    assert cli.main(["validate", f"{world}/meshes/tomography.mesh", f"{world}/meshes/gully.mesh"]) == 0
    assert cli.main(["validate", f"{world}/meshes/gully.mesh", "--least-volume", "1e18"]) == 1
    models, vertices, _ = tables.read_mesh(spark, f"{world}/meshes/gully.mesh")
    assert [(r["name"], r["vertical"], len(r["profile"])) for r in models.collect()] == [("gully-0", "depth", 5)]
    low, high = vertices.agg(F.min("z"), F.max("z")).first()
    assert abs(low) < 1e-6 and 700 < high < 960  # the bowl is 900 m deep

    monkeypatch.setenv("WORLD", str(world))
    (tmp_path / "r.toml").write_text(REQUEST)
    assert cli.main(["generate", str(tmp_path / "r.toml"), str(tmp_path / "out.parquet")]) == 0
    made = spark.read.parquet(str(tmp_path / "out.parquet")).collect()
    near = [r for r in made if r["depth"] == 0]
    assert len(made) == 5 * 5 * 4 and len(near) == 25
    assert all(r["alpha"] == 1 for r in made) and {round(r["vs"]) for r in near} == {round(synthetic.PROFILE[0][1] * 1000)}


def test_upright_surface_and_models_by_text(spark, tmp_path):
    synthetic.raster(spark, 13, 9).write.parquet(str(tmp_path / "r.parquet"))
    made = construction.upright_surface(spark, str(tmp_path / "r.parquet"), "z", 4000.0, flip=True)
    x, y = crs.TransverseMercator().point(172.3, -43.6)
    here = min(made.filter("z IS NOT NULL").collect(), key=lambda r: abs(r["x"] - x) + abs(r["y"] - y))
    assert abs(-here["z"] - 250.0) < 160  # u is a half there: a slope of 1000 over the width, and ridges
    assert construction.model_of(spark, "rho=2,vp=3,vs=1,qp=5,qs=4", [10.0, 30.0]).count() == 2
    for spec, bottoms in (("rho=2,vp=3", None), ("a.txt", [1.0]), ("rho=2,vp=3,vs=1,qp=5,qs=4", [3.0, 1.0])):
        with pytest.raises(ValueError):
            construction.model_of(spark, spec, bottoms)
