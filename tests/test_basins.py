import numpy as np
import pytest

from tetrafield.operators import basins, coastline, grids, surfaces, tin


def test_outlines_are_cleaned_turned_and_sifted(spark):
    rows = [("a", 0, 0.0, 0.0), ("a", 1, 0.0, 2.0), ("a", 2, 0.0, 2.0), ("a", 3, 2.0, 2.0), ("a", 4, 2.0, 0.0), ("a", 5, 0.0, 0.0), ("b", 0, 0.0, 0.0), ("b", 1, 0.1, 0.0), ("b", 2, 0.0, 0.1), ("c", 0, None, 1.0)]
    outlines = spark.createDataFrame(rows, "basin string, n int, x double, y double")
    kept = basins.cleaned(outlines, least_area=1.0)
    assert {r["basin"] for r in kept.collect()} == {"a"}
    assert [tuple(r) for r in basins.areas(kept).collect()] == [("a", 4.0, 4)]


def test_points_within_overlapping_outlines(spark):
    rows = [(b, n, x + b, y) for b in (0, 1) for n, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    outlines = spark.createDataFrame(rows, "basin int, n int, x double, y double")
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (1.5, 1.5), (9.0, 1.0), (None, 1.0)], "x double, y double")
    assert sorted((r["basin"], r["x"]) for r in basins.within(points, outlines, 0.5).collect()) == [(0, 0.5), (0, 1.5), (0, 1.5), (1, 1.5), (1, 1.5)]
    assert basins.within(points.limit(0), outlines, 0.5).count() == 0


def test_depth_bounds(spark):
    made = basins.depth_bounds(spark.createDataFrame([(0, 0.0, 100.0)], "model_id int, minz double, maxz double"), -30.0, 5.0).first()
    assert (made["minz"], made["maxz"]) == (-80.0, 155.0)


def test_triangles_meet_a_bent_surface_within_metres():
    x, y = (a.ravel() for a in np.meshgrid(np.linspace(0, 4, 17), np.linspace(0, 4, 17)))
    samples, values = np.c_[x, y], (x * x + y * y)[:, None]
    ring = np.array([[0.0, 0.0], [4, 0], [4, 4], [0, 4]])
    v, t = tin.triangulate(ring, samples, values, 0.0, metres=[0.5])
    home, weights = tin._locate(samples, v[t])
    assert (home >= 0).all()
    fitted = (weights * (v[t[home]] ** 2).sum(2)).sum(1)
    assert np.abs(fitted - values[:, 0]).max() <= 0.5 + 1e-9


def test_far_points_have_their_distance_too(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0)], "sid long, ax double, ay double, bx double, by double")
    far = spark.createDataFrame([(3e6, 4e6), (-3e6, -4e6), (0.5, 0.0)], "x double, y double")
    got = {r.x: r.coastline for r in coastline.signed_distance(far, lines, size=1.0).collect()}
    assert got[3e6] == pytest.approx(5e6 - 7, abs=0.01) and got[-3e6] == pytest.approx(5e6) and got[0.5] == 0


def test_unknown_solver_is_refused():
    with pytest.raises(ValueError):
        grids.solver_coordinate("guessed")


def test_samples_and_cells_of_a_large_raster_are_not_broadcast(spark):
    """A raster of 1.2 million nodes, planned only: neither its samples nor its cells pass the driver, and each surface's nodes aren't put in order by themselves."""
    nodes = spark.range(1_200_000).selectExpr("id % 40 AS ix", "id div 40 AS iy", "id * 1.0D AS a", "id * 2.0D AS b", "id * 3.0D AS c")
    outlines = spark.createDataFrame([(0, n, *map(float, p)) for n, p in enumerate(((1, 1), (9, 1), (9, 9)))], "basin long, n int, x double, y double")
    triangles = spark.createDataFrame([(0, 0, n, n, *map(float, p)) for n, p in enumerate(((1, 1), (9, 1), (9, 9)))], "basin long, tri long, corner int, vid long, x double, y double")
    names = ["a", "b", "c"]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (
        basins.within(basins.lattice(nodes, names, (0.0, 0.0), (1.0, 1.0)), outlines, 1.0), basins.at_vertices(triangles, nodes, (40, 30_000), names),
    )]
    assert all("BroadcastExchange" not in p for p in plans)
    assert all(sum("Window [lead" in line for line in p.splitlines()) <= 6 for p in plans)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_several_surfaces_at_once_are_each_ones_own(spark, monkeypatch, bound):
    monkeypatch.setattr(surfaces, "BROADCAST_VALUES", bound)
    nodes = spark.range(30).selectExpr("id % 6 AS ix", "id div 6 AS iy", "id * id * 1.0D AS a", "IF(id % 11 = 3, double('NaN'), id * 2.0D) AS b", "IF(id % 7 = 1, NULL, id * 3.0D) AS c")
    places = spark.range(400).selectExpr("id", "id % 20 / 3.0D - 0.5D AS x", "id div 20 / 4.0D - 0.25D AS y")
    got = surfaces.bilinear_stack(places, nodes, (6, 5), ["a", "b", "c"], (0.5, 0.25), (1.0, 0.75)).orderBy("id").collect()
    for name in "abc":
        want = surfaces.bilinear(places, nodes, (6, 5), (0.5, 0.25), (1.0, 0.75), name="v", value=name).orderBy("id").collect()
        assert [r[name] for r in got] == [r["v"] for r in want] and any(r["v"] is not None for r in want)
