"""Requests that refuse what they can't do, from a file on."""

import json

import pytest

from tetrafield.operators import meshes
from tetrafield.plans import config
from tetrafield.sinks import formats
from tetrafield.sources import tables

CONSTANT = [{"type": "constant", "rho": 1.0, "vp": 2.0, "vs": 1.0, "qp": 1.0, "qs": 1.0, "alpha": 1.0}]
BOREHOLE = {"type": "borehole", "surface": 0.0, "depth": 50.0, "resolution_z": 25.0}
EMOD3D = {"type": "emod3d", "surface": 300.0, "nx": 3, "ny": 3, "nz": 5, "resolution": 100.0}
SITES = [{"longitude": 172.62, "latitude": -43.53, "site": "CACS", "rank": 1}, {"longitude": 171.0, "latitude": -44.0, "site": "B", "rank": 2.5}]


def loaded(tmp_path, grid, layers=CONSTANT, **more):
    (tmp_path / "r.json").write_text(json.dumps({"grid": grid, "layers": layers, **more}))
    return config.load(tmp_path / "r.json")


def test_levels_that_fold_are_refused(spark, tmp_path):
    with pytest.raises(config.ConfigError, match="fold"):
        config.run(spark, loaded(tmp_path, EMOD3D | {"decay": {"type": "linear", "length": 50.0}}))
    made = config.run(spark, loaded(tmp_path, EMOD3D | {"decay": {"type": "linear", "length": 500.0}}))
    assert made.count() == 45 and made.filter("depth < 0").isEmpty()
    blocks = {"a": {"resolution": 50.0, "bottom": 200.0}, "b": {"resolution": 100.0, "bottom": 600.0}}
    with pytest.raises(config.ConfigError, match="fold"):  # the ground lies below the first block's flat bottom
        config.run(spark, loaded(tmp_path, {"type": "sw4", "surface": 250.0, "extent_x": 200.0, "extent_y": 200.0, "refinements": blocks}))
    assert config.run(spark, loaded(tmp_path, {"type": "sw4", "surface": -250.0, "extent_x": 200.0, "extent_y": 200.0, "refinements": blocks})).count() > 0


def test_no_model_left_is_an_error(spark, tmp_path):
    v, t = meshes.grid_mesh(spark, 0, (1e6, 1e6, 0), (1, 1, 1), (2, 2, 2), rho=1.0, vp=2.0, vs=1.0, qp=1.0, qs=1.0)
    models = spark.createDataFrame([(0, "far", 200, "elevation", 1)], "model_id int, name string, priority int, vertical string, model_type int")
    formats.write_mesh(models, v, t, str(tmp_path / "far.mesh"))
    grid = {"type": "regular", "surface": 0.0, "extent_x": 2.0, "extent_y": 2.0, "thickness": 1.0, "resolution_x": 1.0, "resolution_y": 1.0, "resolution_z": 1.0}
    request = loaded(tmp_path, grid, [{"type": "query", "model_path": str(tmp_path)}])
    with pytest.raises(config.ConfigError, match="none of the 1 models"):
        config.run(spark, request)
    near = loaded(tmp_path, grid | {"orientation": {"origin_x": 1e6, "origin_y": 1e6}}, [{"type": "query", "model_path": str(tmp_path)}])
    assert not config.run(spark, near).filter("alpha = 1").isEmpty()


def test_sites_in_the_request(spark, tmp_path):
    made = config.run(spark, loaded(tmp_path, BOREHOLE | {"sites": SITES, "projection": {"crs": 2193}}))
    rows = made.orderBy("i", "k").collect()
    assert [(r.i, r.k, r.site, r["rank"]) for r in rows] == [(i, k, s, n) for i, (s, n) in enumerate((("CACS", 1.0), ("B", 2.5))) for k in range(3)]
    assert "site" not in config.run(spark, loaded(tmp_path, BOREHOLE | {"sites": SITES, "keep_extra_columns": False})).columns
    assert tables.inline_sites(spark, SITES).schema["rank"].dataType.simpleString() == "double"


@pytest.mark.parametrize("sites", [[], [{"longitude": 1.0}], [{"longitude": 999.0, "latitude": 0.0}], [{"longitude": 0.0, "latitude": 200.0}], [SITES[0], {"longitude": 1.0, "latitude": 1.0}], [{"longitude": 1.0, "latitude": 1.0, "depth": 3}], [{"longitude": 1.0, "latitude": 1.0, "a": [1]}], ["CACS"], 7])
def test_odd_sites_are_refused(tmp_path, sites):
    with pytest.raises(config.ConfigError):
        loaded(tmp_path, BOREHOLE | {"sites": sites})


@pytest.mark.parametrize("orientation", [{"origin_lon": 999.0, "origin_lat": 0.0}, {"origin_lon": 172.0, "origin_lat": 200.0}, {"origin_lon": 172.0}, {"origin_x": "a", "origin_y": 1.0}, {"azimuth": float("inf")}, {"crs": 4326}])
def test_orientation_out_of_range(tmp_path, orientation):
    with pytest.raises(config.ConfigError):
        loaded(tmp_path, EMOD3D | {"decay": {"type": "squashed"}, "orientation": orientation})


def test_metadata(tmp_path):
    grid = BOREHOLE | {"sites": SITES}
    texts = {k: "x" for k in config.METADATA_TEXTS}
    assert len(config.METADATA) == 18
    assert loaded(tmp_path, grid, metadata=texts | {"keywords": ["a"], "authors": [], "references": ["b", "c"]}).metadata["creator_name"] == "x"
    for odd in ({"summary": "x"}, {"keywords": "a"}, {"title": 3}, {"authors": [1]}):
        with pytest.raises(config.ConfigError):
            loaded(tmp_path, grid, metadata=odd)
    with pytest.raises(config.ConfigError):
        loaded(tmp_path, BOREHOLE | {"sites": SITES, "depth": 10.0})
