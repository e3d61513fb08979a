import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrafield.functions import crs, synthetic
from tetrafield.operators import coastline, grids, layers, meshes, sites, surfaces
from tetrafield.plans import config, plugins
from tetrafield.schema import TOMOGRAPHY
from tetrafield.sinks import formats
from tetrafield.sources import tables
from tetrafield.streaming import points as streaming


def raster(spark, hole=None):
    rows = [(i, j, float("nan") if (i, j) == hole else float(i + 10 * j)) for i in range(5) for j in range(5)]
    return spark.createDataFrame(rows, "ix int, iy int, z double")


def look(spark, nodes, at, **options):
    p = spark.createDataFrame([(float(at[0]), float(at[1]))], "x double, y double")
    return surfaces.bilinear(p, nodes, (5, 5), **options).first()["surface"]


def test_raster_goldens(spark):
    for at, want in {(10, 2): 24, (10, 2.5): 29, (2, -7): 2, (1.5, -7): 1.5, (-3, 9): 40, (1e6, 1e6): 44}.items():
        assert look(spark, raster(spark), at, extrapolate=True) == pytest.approx(want)
        assert look(spark, raster(spark), at) is None
    holed = raster(spark, (2, 2))
    for at, want in {(1, 1): 11, (1, 1.5): 16, (3, 2): 23, (1.5, 1): 11.5, (1.5, 2): None, (2.5, 2.5): None}.items():
        got = look(spark, holed, at)
        assert got is None if want is None else got == pytest.approx(want)
    assert look(spark, raster(spark), (1.5, 2.0), axes=([0, 1, 2, 3, 4], [0, 1, 2, 3, 4])) == pytest.approx(21.5)


def coast(spark, rings, at, size=None):
    rows = [(n, k, float(x), float(y)) for n, r in enumerate(rings) for k, (x, y) in enumerate([*r, r[0]])]
    lines = coastline.segments(spark.createDataFrame(rows, "ring int, n int, x double, y double"))
    p = spark.createDataFrame([(float(a), float(b)) for a, b in at], "x double, y double")
    made = coastline.signed_distance(p, lines, size=size)
    found = {(r.x, r.y): r.coastline for r in made.collect()}
    return [found[float(a), float(b)] for a, b in at]


@pytest.mark.parametrize("size", [None, 0.02])
def test_coast_goldens(spark, size):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert coast(spark, [square], [(0.5, 0.5), (0.25, 0.5), (-1, 0.5), (2, 0.5), (0.5, 2)], size) == pytest.approx([-0.5, -0.25, 1, 1, 1])
    donut = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]
    got = coast(spark, donut, [(5, 5), (2, 2)], size)
    assert got[0] > 0 > got[1]
    got = coast(spark, [[(0, -1), (2, 0), (0, 1)]], [(1, 0), (-1, 0), (3, 0)], size)
    assert got[0] < 0 < min(got[1:])


def test_no_coast_is_all_sea(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    empty = spark.createDataFrame([], "sid long, ax double, ay double, bx double, by double")
    assert coastline.signed_distance(p, empty).first()["coastline"] == math.inf


def test_site_goldens(spark):
    cases = {"a": [400] * 5, "b": [200, 400, 800, 1200, 3000], "c": [200, 400, 1000, 2000, 2500], "d": [1500, 1200, 1800, 2600, 3000]}
    rows = [(s, 10.0 * k, float(v)) for s, vs in cases.items() for k, v in enumerate(vs)] + [("e", d, v) for d, v in ((0.0, 300.0), (50.0, 600.0), (100.0, 900.0))]
    got = {r.station: r for r in sites.summarise(spark.createDataFrame(rows, "station string, depth double, vs double")).collect()}
    assert got["a"].vs30 == pytest.approx(400) and got["a"].z1p0 is None and got["a"].z2p5 is None
    assert got["b"].vs30 == pytest.approx(30 / (10 / 200 + 10 / 400 + 10 / 800)) and (got["b"].z1p0, got["b"].z2p5) == (30, 40)
    assert (got["c"].z1p0, got["c"].z2p5) == (20, 40) and (got["d"].z1p0, got["d"].z2p5) == (0, 30)
    assert got["e"].vs30 == pytest.approx(300)
    with pytest.raises(ValueError):
        sites.unique(spark.createDataFrame([("x",), ("x",)], "station string"))


def test_scattered_points_golden(spark):
    rows = [(n, 1_570_000.0 + 500 * n, 0.0, float(z)) for n, z in enumerate((400, -200, 0, 850))]
    p = spark.createDataFrame(rows, "i int, x double, y double, z double")
    ground = lambda rows, name: rows.withColumn(name, -100 - 0.05 * (F.col("x") - 1_570_000))
    assert [round(r.depth, 6) for r in grids.scattered(p, ground).orderBy("i").collect()] == [500, 0, 150, 1025]


def test_grid_checks(spark):
    with pytest.raises(ValueError):
        grids.check_refinements({"a": (1, 2), "b": (3, 4)})
    with pytest.raises(ValueError):
        grids.check_labels(["vs"])
    assert grids.levels_to(2.1, 0.3) == 8 and grids.nodes_along(10, 2.5) == 5
    assert not grids.folded_levels(spark, -2500, 400, list(range(0, 5001, 10)), "linear", length=5000.0).count()


def test_tomography_and_meshes(spark):
    i = F.col("id")
    p = spark.range(60).select(F.floor(i / 15).cast("double").alias("x"), (F.floor(i / 5) % 3).cast("double").alias("y"), (i % 5).cast("double").alias("z"))
    p = p.withColumns({"vs": 1 + 0.1 * F.col("x"), "vp": 2 + 0.5 * F.col("x"), "rho": 2.5 + 0.01 * F.col("x")}).orderBy(F.rand(3))
    v, t = meshes.tomography_mesh(spark, p)
    assert v.count() == 60 and t.count() == 5 * 3 * 2 * 4
    r = v.filter("x = 2 AND y = 1 AND z = 3").first()
    assert r.vs == pytest.approx(1200) and r.qs == pytest.approx(60) and r.qp == pytest.approx(120)
    with pytest.raises(ValueError):
        meshes.rectilinear(p.limit(59))
    again_v, again_t = meshes.in_z_order(v, t, 1.0)
    assert again_t.count() == t.count() and again_v.select("vid").distinct().count() == 60
    total = meshes.gather(again_t, again_v, ("x", "y", "z")).agg(F.sum(meshes.volume())).first()[0]
    assert total == pytest.approx(3 * 2 * 4)
    with pytest.raises(ValueError):
        meshes.repair_interfaces(spark.createDataFrame([(None, None)], "top double, bottom double"))


def test_profile_mesh(spark):
    cols = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 40.0), (1, 1000.0, 0.0, 0.0, 500.0), (2, 0.0, 1000.0, 0.0, 500.0), (3, 1000.0, 1000.0, 0.0, 500.0)], "vid int, x double, y double, top double, bottom double")
    tri = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "tri int, a int, b int, c int")
    layer = spark.createDataFrame([(0.0, 100.0, 1800.0, 1500.0, 400.0, 40.0, 20.0), (100.0, 200.0, 2000.0, 2000.0, 800.0, 80.0, 40.0), (300.0, 1e6, 2200.0, 2500.0, 1200.0, 120.0, 60.0)], "z double, thickness double, rho double, vp double, vs double, qp double, qs double")
    v, t, _ = meshes.profile_mesh(cols, tri, layer, 0)
    assert t.count() == 6
    assert {r.z: r.vs for r in v.collect()} == {0.0: 400, 40.0: 400, 500.0: 1200}


def test_crs_round_trip(spark):
    t = crs.TransverseMercator()
    df = spark.createDataFrame([(172.5, -43.6), (178.0, -38.0), (166.5, -46.9)], "lon double, lat double")
    e, n = t.forward(F.col("lon"), F.col("lat"))
    back = t.inverse(F.col("e"), F.col("n"))
    for r in df.select("lon", "lat", e.alias("e"), n.alias("n")).select("*", back[0].alias("a"), back[1].alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)
        assert t.point(r.lon, r.lat) == (pytest.approx(r.e, abs=1e-6), pytest.approx(r.n, abs=1e-6))
    assert t.point(173.0, 0.0) == (pytest.approx(1_600_000), pytest.approx(10_000_000))
    assert t.convergence(173.0, -40.0) == pytest.approx(0, abs=1e-6)


def test_synthetic_goldens(spark):
    at = lambda f, lon, lat: spark.range(1).select(f(F.lit(lon), F.lit(lat))).first()[0]
    assert at(synthetic.elevation, 172.0, -43.6) == pytest.approx(550.0)
    assert at(synthetic.elevation, 172.5, -43.6) == pytest.approx(-283.3333, abs=1e-3)
    assert at(synthetic.vs30, 172.6, -43.6) == 200.0


def model(spark):
    rows = [("g", "s%d" % i, i, j, k, float(i), float(j), float(k), float(k), float(k), 2000.0 + i, 3000.0, 1500.0 + k, 100.0, 50.0, 1.0) for i in range(2) for j in range(3) for k in range(4)]
    return spark.createDataFrame(rows, "grid string, site string, i int, j int, k int, x double, y double, z double, depth double, nominal_depth double, rho double, vp double, vs double, qp double, qs double, alpha double")


def test_sinks(spark, tmp_path):
    formats.write(model(spark), str(tmp_path / "m.parquet"))
    assert formats.read_back(spark, str(tmp_path / "m.parquet")).count() == 24
    formats.write(model(spark), str(tmp_path / "m.csv"))
    assert spark.read.csv(str(tmp_path / "m.csv"), header=True).columns[:6] == ["grid", "site", "i", "j", "k", "x"]
    formats.write(model(spark), str(tmp_path / "solver"))
    raw = np.fromfile(tmp_path / "solver" / "vs3dfile.s", "<f4").reshape(3, 4, 2)
    assert raw[0, 3, 0] == pytest.approx(1.503) and raw.size == 24
    formats.write(model(spark), str(tmp_path / "m.sfile"))
    assert spark.read.parquet(str(tmp_path / "m.sfile" / "material")).count() == 24
    with pytest.raises(ValueError):
        formats.write(model(spark), str(tmp_path / "m.csv"), quantise=True)
    with pytest.raises(ValueError):
        formats.of_path("x.unknown")
    with pytest.raises(ValueError):
        formats.register("csv")(lambda m, p: None)


def test_mesh_round_trip_and_pruning(spark, tmp_path):
    v, t = meshes.grid_mesh(spark, 0, (0, 0, 0), (1, 1, 1), (2, 2, 2), rho=1.0)
    m = spark.createDataFrame([(0, "a", 1, "elevation", 1)], "model_id int, name string, priority int, vertical string, model_type int")
    for n in ("a", "b"):
        formats.write_mesh(m, v, t, str(tmp_path / f"{n}.mesh"))
    found = tables.read_meshes(spark, [str(p) for p in layers.discover(tmp_path, ["*.mesh"])])
    assert found[0].count() == 2 and found[2].count() == 10
    with pytest.raises(FileNotFoundError):
        layers.discover(tmp_path, ["*.none"])
    bounds = m.join(meshes.bounds(v), "model_id")
    assert layers.prune(bounds, (0, 1), (0, 1)).count() == 1 and layers.prune(bounds, (5, 6), (0, 1)).count() == 0
    with pytest.raises(ValueError):
        meshes.validate(m.withColumn("model_type", F.lit(9)), t)


def test_sources(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("site,longitude,latitude\nA,172.5,-43.5\nB,172.6,-43.6\n")
    got = tables.read_sites(spark, str(tmp_path / "sites.csv")).orderBy("i").collect()
    assert [(r.i, r.site) for r in got] == [(0, "A"), (1, "B")]
    with pytest.raises(ValueError):
        tables.read_sites(spark, str(tmp_path / "sites.txt"))
    (tmp_path / "tomo.txt").write_text("a title\nLatitude Longitude x(km) y(km) Depth(km_BSL) Density Vp Vs\n-43 172 1 2 3 2.5 5 3\n")
    assert tables.read_tomography(spark, str(tmp_path / "tomo.txt")).first().asDict() == {"x": 1.0, "y": 2.0, "z": 3.0, "rho": 2.5, "vp": 5.0, "vs": 3.0}
    (tmp_path / "fd.txt").write_text("DEF HST\n1.8 0.5 1.81 100 50 0.1\n# note\n2.1 0.68 1.95 120 60 0.3\n")
    assert [(r.z, r.thickness) for r in tables.read_profile(spark, str(tmp_path / "fd.txt")).orderBy("z").collect()] == [(0.0, 100.0), (100.0, pytest.approx(200.0))]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    (tmp_path / "p.wkb.gz").write_bytes(gzip.compress(wkb))
    assert coastline.segments(tables.read_outlines(spark, str(tmp_path / "p.wkb.gz"))).count() == 3
    (tmp_path / "o.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert tables.read_geojson(spark, str(tmp_path / "o.geojson")).count() == 4
    assert tables.uniform_profile(spark, "rho=2,vp=3,vs=1,qp=5,qs=4", 100.0).first().vp == 3


def test_requests(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[grid]\ntype = "regular"\nsurface = "flat"\nextent_x = 2\nextent_y = 2\nthickness = 1\nresolution_x = 1\nresolution_y = 1\nresolution_z = 0.5\n[[layers]]\ntype = "clamp"\n[layers.clamps.vs]\nmin = 700\n[[layers]]\ntype = "constant"\nrho = 2000\nvp = 3000\nvs = 500\nqp = 100\nqs = 50\nalpha = 1\n')
    request = config.load(tmp_path / "r.toml")
    made = config.run(spark, request, lambda rows, name: rows.withColumn(name, F.lit(0.0)))
    assert made.count() == 27 and made.select("vs").distinct().first()[0] == 700
    for bad in ({"type": "none"}, {"type": "regular"}, dict(request.grid, extra=1), dict(request.grid, extent_x=-1)):
        with pytest.raises(config.ConfigError):
            config.Request(bad, [])
    with pytest.raises(config.ConfigError):
        config.Request(request.grid, [{"type": "ely", "vs30": "v"}])
    assert plugins.listing(spark).filter("kind = 'layer'").count() >= 7


def test_stream(spark, tmp_path):
    from tests.test_location import cubes, points

    index = cubes(spark, (0, 5, 1))
    points(spark, (0.5, 0.5, 0.5, 0), (9, 9, 9, 9)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, x double, y double, z double, depth double").parquet(str(tmp_path / "in"))
    got = []
    streaming.composite(stream, index, lambda rows, n: got.extend(rows.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.n, r.q.rho) for r in got) == [(0, 5.0), (1, 0.0)]


def test_adaptive_tin(spark):
    from tetrafield.operators import tin

    n = 21
    xs, ys = np.meshgrid(np.linspace(0, 10, n), np.linspace(0, 10, n))
    samples = np.column_stack([xs.ravel(), ys.ravel()])
    values = np.column_stack([np.maximum(0, 5 - np.hypot(xs - 5, ys - 5)).ravel(), (xs + ys).ravel()])
    ring = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)
    v, t = tin.triangulate(ring, samples, values, 0.05)
    area = tin._turn(v, t) / 2
    assert (area > 0).all() and area.sum() == pytest.approx(100) and len(t) > 20
    flat_v, flat_t = tin.triangulate(ring, samples, values[:, 1:], 0.05)
    assert len(flat_t) == 2
    _, short = tin.triangulate(ring, samples, values[:, 1:], 0.05, max_edge=3.0)
    assert len(short) > len(flat_t)
    notch = np.array([[0, 0], [10, 0], [10, 10], [5, 2], [0, 10]], float)
    v, t = tin.triangulate(notch, samples[:0], values[:0], 0.05)
    area = tin._turn(v, t) / 2
    assert area.sum() == pytest.approx(60)
    outlines = spark.createDataFrame([(b, k, float(x), float(y)) for b in "ab" for k, (x, y) in enumerate(ring)], "basin string, n int, x double, y double")
    rows = spark.createDataFrame([(b, float(x), float(y), float(z)) for b in "ab" for (x, y), z in zip(samples, values[:, 0])], "basin string, x double, y double, z double")
    got = tin.adaptive_tins(outlines, rows, ["z"], 0.1).groupBy("basin").count().collect()
    assert len(got) == 2 and got[0]["count"] == got[1]["count"]


def test_resample_and_rewrite(spark):
    i = F.col("id")
    nodes = spark.range(81).select(F.floor(i / 9).alias("j"), (i % 9).alias("k"), (i % 9).cast("double").alias("x"), F.floor(i / 9).cast("double").alias("y")).withColumn("value", F.col("x") + 10 * F.col("y"))
    made = surfaces.resample_upright(spark, nodes)
    assert made.count() == 81 and made.filter("abs(z - (x + 10 * y)) > 1e-9 OR z IS NULL").count() == 0
    v, _ = meshes.grid_mesh(spark, 0, (0, 0, 0), (1, 1, 100), (2, 2, 5), vs=3000.0, vp=5000.0, rho=2500.0, qp=1.0, qs=1.0)
    got = meshes.rewrite_top(v, F.col("x") == 0, 350.0, F.lit(400.0), F.lit(4000.0), F.lit(2000.0), {"vs": 999.0})
    assert {(r.x, r.z): r.vs for r in got.collect()}[0.0, 0.0] == pytest.approx(200) and got.filter("x = 1 AND z = 0").first().vs == 999 and got.filter("z = 400").first().vs == 3000
    assert grids.grid_azimuth(30.0, 173.0, -41.0) == pytest.approx(30.0, abs=1e-6)


@pytest.mark.parametrize("size", [0.1, None])
def test_coast_keeps_points_without_a_place(spark, size):
    """Fine and coarse cells: a point with a coordinate that is null or no number stays, without a distance."""
    ring = [(1, n, x, y) for n, (x, y) in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)])]
    lines = coastline.segments(spark.createDataFrame(ring, "ring int, n int, x double, y double"))
    points = spark.createDataFrame([(1, 4.0, 1.0), (2, None, 1.0), (3, 4.0, None), (4, None, None), (4, None, None), (5, float("nan"), 1.0), (6, 1.0, float("inf"))], "id int, x double, y double")
    made = coastline.signed_distance(points, lines, size=size)
    assert sorted(((r.id, r.coastline) for r in made.collect()), key=str) == [(1, -1.0), (2, None), (3, None), (4, None), (4, None), (5, None), (6, None)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_outlines_of_several_features(spark, tmp_path):
    tri = lambda dx: [[[dx, 0], [dx + 1, 0], [dx, 1], [dx, 0]]]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": tri(0)}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [tri(6), tri(9)]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": tri(20)}))
    rings = tables.read_rings(spark, f"{tmp_path}/*.geojson")
    assert rings.select("ring").distinct().count() == 4 and rings.count() == 16
    lengths = coastline.segments(rings).selectExpr("hypot(bx - ax, by - ay) AS d").collect()
    assert len(lengths) == 12 and max(r.d for r in lengths) < 1.5


def test_columns_keep_rows_that_look_like_a_header(spark, tmp_path):
    (tmp_path / "t.txt").write_text("title\n1 2\n# note\n1 2\n3 4\n1 2\n")
    got = tables.read_columns(spark, str(tmp_path / "t.txt"), skip=1, header=True).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (3.0, 4.0), (1.0, 2.0)]


def _request(tmp_path, surface, **orientation):
    import tomllib

    lines = [f"{k} = {v!r}" for k, v in orientation.items()]
    return config.Request(**tomllib.loads(f"""
[metadata]
title = "a model"
[grid]
type = "regular"
surface = {surface!r}
extent_x = 4.0
extent_y = 4.0
thickness = 2.0
resolution_x = 1.0
resolution_y = 1.0
resolution_z = 1.0
[grid.orientation]
{chr(10).join(lines)}
[[layers]]
type = "coastline"
coastline = {str(tmp_path / 'c.geojson')!r}
[[layers]]
type = "ely"
vs30 = {str(tmp_path / 'vs30.parquet')!r}
depth_t = 1.5
[[layers]]
type = "constant"
rho = 2000.0
vp = 3000.0
vs = 1000.0
qp = 100.0
qs = 50.0
alpha = 1.0
"""))


def test_requests_read_their_paths(spark, tmp_path):
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [[[-9, -9], [9, -9], [9, 9], [-9, 9], [-9, -9]]]}))
    lattice = [(float(x), float(y), 10.0 * x + y, 400.0) for x in range(6, -7, -1) for y in range(-6, 7)]  # x runs down
    nodes = spark.createDataFrame(lattice, "x double, y double, s double, v double")
    nodes.selectExpr("x", "y", "s AS z").write.parquet(str(tmp_path / "dem.parquet"))
    nodes.selectExpr("x", "y", "v AS z").write.parquet(str(tmp_path / "vs30.parquet"))
    request = _request(tmp_path, str(tmp_path / "dem.parquet"), origin_x=0.5, origin_y=0.0, azimuth=0.0)
    made = config.run(spark, request).collect()
    assert len(made) == 75 and all(abs(r.z - r.depth - (10 * r.x + r.y)) < 1e-9 for r in made)
    # as the constant layer answers for basins too, the taper shows below them only
    chain = config.build_chain(spark, request, config.resources_of(spark, request))
    ground = layers.evaluate(chain, config.build_points(spark, request, config.surface_of(spark, request.grid["surface"])), TOMOGRAPHY).collect()
    assert {round(r.vs) for r in ground if r.depth > 1.5} == {1000} and all(r.vs < 1000 for r in ground if r.depth == 0)
    with pytest.raises(config.ConfigError):
        config.run(spark, _request(tmp_path, "dem.zarr", origin_x=0.0, origin_y=0.0))


def test_origins_and_nested_keys(tmp_path):
    frame = config.frame_of({"origin_lon": 172.3, "origin_lat": -43.6, "azimuth": 10.0})
    east, north = crs.TransverseMercator().point(172.3, -43.6)
    assert (frame.origin_x, frame.origin_y) == (east, north) and 10 < frame.azimuth < 11 or 9 < frame.azimuth < 10
    assert config.frame_of({"origin_x": 1.0, "origin_y": 2.0, "azimuth": 30.0}) == grids.Frame(1.0, 2.0, 30.0)
    for wrong in ({"origin_lon": 1.0}, {"origin": 1.0}, {"origin_x": 1.0, "origin_y": 1.0, "origin_lon": 1.0, "origin_lat": 1.0}, {"crs": "EPSG:3857"}):
        with pytest.raises(config.ConfigError):
            _request(tmp_path, 0.0, **wrong)
    base = {"type": "regular", "surface": 0.0, "extent_x": 1.0, "extent_y": 1.0, "thickness": 1.0, "resolution_x": 1.0, "resolution_y": 1.0, "resolution_z": 1.0}
    for grid, own, about in (({"chunks": {"q": 1}}, [], {}), ({}, [{"type": "clamp", "clamps": {"vs": {"least": 1.0}}}], {}), ({}, [{"type": "coastline", "coastline": "c"}, {"type": "offshore", "model": [{"vp": 1.0}], "basin_depth": []}], {}), ({}, [], {"colour": "red"})):
        with pytest.raises(config.ConfigError):
            config.Request(base | grid, own, about)


def test_turned_frames():
    """An azimuth turns the grid clockwise: its north side points east at 90 degrees."""
    turned = grids.Frame(10.0, 20.0, 90.0)
    assert np.allclose(turned.outline(2, 4, 1.0, 1.0), [(8.0, 21.0), (8.0, 19.0), (12.0, 19.0), (12.0, 21.0)])


def test_folds_raise(spark):
    with pytest.raises(ValueError, match="fold"):
        grids.check_folds(spark, -4.0, 2.0, [k * 0.25 for k in range(16)], "linear", length=1.0)
    grids.check_folds(spark, -4.0, 0.5, [k * 0.25 for k in range(16)], "linear", length=1.0)
