import json
import math

import pytest
from pyspark.sql import functions as F

from tetrafield import cli
from tetrafield.operators import bands, basins
from tetrafield.sources import tables
from tests.compare import SF, assert_same
from tetrafield.queries import QUERIES, SQL

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def outline(spark, ring, basin=0):
    return spark.createDataFrame([(basin, n, x, y) for n, (x, y) in enumerate(ring)], "basin long, n int, x double, y double")


def land(spark, *rings):
    return spark.createDataFrame([(str(r), n, x, y) for r, ring in enumerate(rings) for n, (x, y) in enumerate(ring)], "ring string, n int, x double, y double")


@pytest.mark.parametrize("name", ["basin_layers", "basin_band"])
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


def area(rings):
    return {r["basin"]: r["area"] for r in basins.areas(rings).collect()}


def test_a_band_all_round_and_one_of_water_only(spark):
    both = outline(spark, SQUARE).unionByName(outline(spark, [(x + 20, y) for x, y in SQUARE], 1))
    round_about = area(bands.grown(both, 1.0, 0.125))
    assert round_about[0] == pytest.approx(32 + math.pi, abs=0.1) and round_about[1] == pytest.approx(round_about[0])
    shore = land(spark, [(-50.0, -50.0), (50.0, -50.0), (50.0, 1.03), (-50.0, 1.03)])
    assert area(bands.grown(both, 1.0, 0.125, shore))[0] == pytest.approx(16 + 4 + 2 * 2.97 + math.pi / 2, abs=0.1)
    # with land all around nothing grows, a lake inside the basin being too far from other water
    lake = land(spark, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)], [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)])
    assert area(bands.grown(both, 1.0, 0.125, lake))[0] == pytest.approx(16, abs=0.1)


def test_water_cut_off_by_land_isnt_kept(spark):
    # a spit of land a quarter wide parts the basin's right side from the water behind it
    spit = land(spark, [(4.25, -9.0), (4.5, -9.0), (4.5, 9.0), (4.25, 9.0)])
    grown = bands.grown(outline(spark, SQUARE), 1.0, 0.0625, spit)
    assert grown.agg(F.max("x")).first()[0] == pytest.approx(4.25, abs=0.07)


def test_basins_too_small_for_the_lattice_are_refused(spark):
    with pytest.raises(ValueError):
        bands.grown(outline(spark, [(0.3, 0.3), (0.6, 0.3), (0.6, 0.6)]), 1.0, 1.0, land(spark, [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)]))
    for metres, step in ((0.0, 1.0), (1.0, 0.0), (1.0, 2.0)):
        with pytest.raises(ValueError):
            bands.grown(outline(spark, SQUARE), metres, step)
    assert bands.grown(outline(spark, SQUARE).limit(0), 1.0, 0.5).count() == 0


def test_opacity_of_odd_places(spark):
    rows = [(0, 2.0, 2.0, 1.0), (0, 5.0, 2.0, 0.5), (0, 7.0, 8.0, 0.0), (0, 90.0, 2.0, 0.0), (0, 4.0, 5.0, 0.5), (1, 2.0, 2.0, 0.0), (0, None, 2.0, None)]
    places = spark.createDataFrame(rows + rows[:1], "basin long, x double, y double, want double")
    got = bands.opacity(places, outline(spark, SQUARE), 2.0).collect()
    assert len(got) == 8 and all(r["alpha"] == r["want"] for r in got)


def test_layers_end_with_their_models_and_the_first_is_raised(spark):
    triangles = spark.createDataFrame([(0, 0, c, c, float(c % 2), float(c // 2)) for c in range(3)], "basin long, tri long, corner int, vid long, x double, y double")
    columns = triangles.select("basin", "vid", "x", "y", F.lit(0.0).alias("a"), F.when(F.col("vid") == 0, -5.0).otherwise(30.0).alias("b"), F.lit(80.0).alias("c"))
    vertices, tets = basins.layered(triangles, columns, ["a", "b", "c"], ends=[20.0, 60.0], pad=50.0)
    z = {(r["model_id"], r["vid"]): r["z"] for r in vertices.collect()}
    assert [z[0, n] for n in range(6)] == [-5.0, -5.0, -50.0, 20.0, -50.0, 20.0]  # a bottom above the top takes it along, and isn't raised
    assert [z[1, n] for n in range(6)] == [-5.0, 60.0, 30.0, 60.0, 30.0, 60.0]
    assert tets.count() == 6
    with pytest.raises(ValueError):
        basins.layered(triangles, columns, ["a"])


def test_layers_with_a_band_from_files(spark, tmp_path):
    ring = [(3000.0, 3000.0), (7000.0, 3000.0), (7000.0, 7000.0), (3000.0, 7000.0)]
    shore = [(-1e5, -1e5), (5000.0, -1e5), (5000.0, 1e5), (-1e5, 1e5)]
    for name, r in (("basin", ring), ("land", shore)):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [[*r, r[0]]]}))
    nodes = spark.range(21 * 21).select((F.col("id") % 21 * 500.0).alias("x"), (F.floor(F.col("id") / 21) * 500.0).alias("y"))
    nodes.select("x", "y", F.lit(-20.0).alias("ground"), (F.col("x") / 100).alias("shelf"), (F.col("x") / 50 + 100).alias("floor")).write.parquet(f"{tmp_path}/nodes.parquet")
    uniform = "rho=1000,vp=2000,vs=500,qp=100,qs=50"
    said = ["basin", f"{tmp_path}/basin.geojson", f"{tmp_path}/nodes.parquet", f"{tmp_path}/out.mesh", "--name", "b", "--bottom", "shelf", "floor", "--ground", "ground", "--tolerance", "5"]
    assert cli.main([*said, "--model", uniform, uniform.replace("500", "900"), "--priority", "4", "5", "--smoothing", "1000", "--coastline", f"{tmp_path}/land.geojson"]) == 0
    models, vertices, tets = tables.read_mesh(spark, f"{tmp_path}/out.mesh")
    assert {(r["name"], r["priority"], r["profile"][0]["vs"]) for r in models.collect()} == {("b-0-0", 4, 500.0), ("b-0-1", 5, 900.0)}
    got = vertices.collect()
    assert min(r["z"] for r in got) == -50.0  # raised
    assert max(r["x"] for r in got) == pytest.approx(8000, abs=260) and min(r["x"] for r in got) == pytest.approx(3000, abs=260)
    for r in got:
        far = math.hypot(max(3000 - r["x"], 0, r["x"] - 7000), max(3000 - r["y"], 0, r["y"] - 7000))
        assert r["alpha"] == pytest.approx(1 - min(far / 1000, 1), abs=1e-6)
    assert cli.main(["validate", f"{tmp_path}/out.mesh"]) == 0
    with pytest.raises(SystemExit):
        cli.main([*said, "--model", uniform])
