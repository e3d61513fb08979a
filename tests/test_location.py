import pytest
from pyspark.sql import functions as F

from tetrafield.operators import layers, locate, meshes
from tetrafield.schema import ALL, BASINS, COMPONENTS, TOMOGRAPHY, ModelRange

MODEL = "model_id int, name string, priority int, vertical string, model_type int"


def cubes(spark, *models, vertical="elevation"):
    """Unit cubes of one value: (priority, value, alpha)."""
    rows, vertices, tets = [], None, None
    for n, (priority, value, alpha) in enumerate(models):
        rows.append((n, f"m{n}", priority, vertical if isinstance(vertical, str) else vertical[n], 1))
        v, t = meshes.grid_mesh(spark, n, (0, 0, 0), (1, 1, 1), (2, 2, 2), **{c: float(value) for c in COMPONENTS[:-1]}, alpha=alpha)
        vertices, tets = (v, t) if vertices is None else (vertices.unionByName(v), tets.unionByName(t))
    return locate.build_index(spark.createDataFrame(rows, MODEL), vertices, tets)


def points(spark, *xyzd):
    return spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(xyzd)], "n int, x double, y double, z double, depth double")


def sample(spark, index, models=ALL, at=(0.5, 0.5, 0.5, 0.5)):
    return locate.composite(points(spark, at), index, models, miss_zero=False).first()["q"]


def test_priority_and_opacity(spark):
    assert sample(spark, cubes(spark, (1, 10, 1), (0, 5, 1))).rho == 5
    q = sample(spark, cubes(spark, (0, 4, 0.5), (1, 10, 1)))
    assert q.rho == 7 and q.alpha == 1
    both = cubes(spark, (10, 5, 1), (200, 99, 1))
    assert sample(spark, both, BASINS).rho == 5 and sample(spark, both, TOMOGRAPHY).rho == 99
    one = cubes(spark, (10, 5, 1))
    for lo, hi, hit in ((10, 10, True), (10, 20, True), (0, 10, True), (11, 20, False), (0, 9, False)):
        assert (sample(spark, one, ModelRange(lo, hi)) is not None) == hit


def test_verticals(spark):
    index = cubes(spark, (0, 5, 1), (1, 9, 1), vertical=("depth", "elevation"))
    for at, want in (((0.5, 0.5, 0.5, 0.5), 5), ((0.5, 0.5, 0.5, 5), 9), ((0.5, 0.5, 50, 0.5), 5), ((0.5, 0.5, 50, 5), None)):
        q = sample(spark, index, at=at)
        assert (q and q.rho) == want


def test_miss_is_zeros(spark):
    r = locate.composite(points(spark, (5, 5, 5, 5)), cubes(spark, (0, 5, 1))).first()["q"]
    assert tuple(r) == (0,) * 6


def test_linear_field_and_brute_force(spark):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    v, t = meshes.grid_mesh(spark, 0, (0, 0, 0), (1, 1, 1), (4, 4, 4), rho=2 * x + 3 * y - z, vp=1.0, vs=1.0, qp=1.0, qs=1.0)
    index = locate.build_index(spark.createDataFrame([(0, "m", 0, "elevation", 1)], MODEL), v, t)
    probes = points(spark, (1, 1, 1, 0), (1, 1.5, 2, 0), (2, 2, 1.5, 0), (1.5, 1, 1, 0), (0.5, 1, 2.5, 0), (2.99, 0.01, 1.7, 0), (3.00005, 1, 1, 0))
    for r in locate.composite(probes, index).filter("n < 6").collect():
        assert r.q.rho == pytest.approx(2 * r.x + 3 * r.y - r.z)
    rows = index.samples
    brute = probes.join(rows, locate.inside(probes.x, probes.y, probes.z)).select("n", "tid")
    assert {tuple(r) for r in locate.hits(probes, index).select("n", "tid").collect()} == {tuple(r) for r in brute.collect()}


def test_explain_and_stats(spark):
    index = cubes(spark, (0, 5, 1), (1, 9, 1))
    r = locate.explain(points(spark, (0.5, 0.5, 0.5, 0.5), (9, 9, 9, 9)), index).orderBy("n").collect()
    assert [c.model_id for c in r[0].contributions] == [0, 1] and r[0].termination == 0 and r[0].output.rho == 5
    assert r[1].contributions == [] and r[1].termination is None
    s = locate.query_stats(points(spark, (0.5, 0.5, 0.5, 0.5)), index).first()
    assert s.hit_count == 2 and s.held >= 2 and s.candidates >= s.tested >= s.held


def test_stats_with_their_output_are_those_of_the_composite(spark):
    index = cubes(spark, (0, 5, 1), (1, 9, 0.5))
    asked = points(spark, (0.5, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.5), (9, 9, 9, 9), (0.25, 0.75, 0.5, 0))
    asked = asked.unionByName(asked.limit(1).withColumns({"x": F.lit(None).cast("double"), "n": F.lit(9).cast(asked.schema["n"].dataType)}))
    for models in (locate.ALL, locate.ModelRange(9, 9)):
        got = {r["n"]: r for r in locate.query_stats(asked, index, models, output="q").collect()}
        want = {r["n"]: r for r in locate.composite(asked, index, models).collect()}
        assert len(got) == len(want) == 5 and all(got[n]["q"] == want[n]["q"] for n in want)
        assert got[9]["candidates"] == got[9]["hit_count"] == 0
    plain = locate.query_stats(asked, index).columns
    assert [c for c in locate.query_stats(asked, index, output="q").columns if c != "q"] == plain


def test_totals_of_the_pass_itself(spark, tmp_path):
    index = cubes(spark, (0, 5, 1), (1, 9, 1))
    asked = points(spark, (0.5, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.5), (9, 9, 9, 9))
    rows, totals = locate.measured(asked, index)
    found = totals.timed(lambda: rows.write.parquet(str(tmp_path / "out")))
    want = locate.query_stats(asked, index).agg(*(F.sum(c).alias(c) for c in ("candidates", "held", "hit_count"))).first()
    assert found["points"] == 3 and found["hit_count"] == 4 and all(found[c] == want[c] for c in ("candidates", "held", "hit_count"))
    assert found["elapsed"] > 0 and spark.read.parquet(str(tmp_path / "out")).count() == 3
    rows, totals = locate.measured(asked.limit(0), index)
    assert totals.timed(rows.collect)["points"] == 0
    rows, totals = locate.measured(points(spark, (9, 9, 9, 9), (0.9, 1.2, 0.5, 0)), index)
    assert totals.timed(rows.collect)["held"] == 0  # where nothing is hit the points are counted all the same
    assert totals.counts()["points"] == 2


def test_plan_is_a_hash_join(spark):
    index = cubes(spark, (0, 5, 1))
    plan = locate.composite(points(spark, (0.5, 0.5, 0.5, 0.5)), index)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan


def test_empty_points(spark):
    assert locate.composite(points(spark, (0, 0, 0, 0)).limit(0), cubes(spark, (0, 5, 1))).count() == 0


def grid(spark, levels, name="g"):
    return spark.createDataFrame([(name, 0, 0, k, 0.0, 0.0, float(z), float(z)) for k, z in enumerate(levels)], "grid string, i int, j int, k int, x double, y double, z double, depth double")


def test_backus_goldens(spark):
    upper, lower = dict(rho=1800.0, vp=2000.0, vs=800.0, qp=80.0, qs=40.0, alpha=1.0), dict(rho=2600.0, vp=5000.0, vs=2900.0, qp=300.0, qs=150.0, alpha=1.0)

    @layers.functional
    def halves(p, models):
        return p.withColumn("q", F.struct(*(F.when(F.col("depth") < 150, upper[c]).otherwise(lower[c]).alias(c) for c in COMPONENTS)))

    got = layers.evaluate(layers.Backus(halves(), 2), grid(spark, [0, 100, 200, 300])).orderBy("k").collect()
    assert got[0].vs == pytest.approx(800) and got[3].vs == pytest.approx(2900) and all(r.alpha == 1 for r in got)
    one = layers.evaluate(layers.Backus(halves(), 3), grid(spark, [40])).first()
    assert one.rho == pytest.approx(1800)


def test_sentinel_and_order(spark):
    with pytest.raises(RuntimeError):
        layers.evaluate(layers.Backus(layers.Layer(), 1), grid(spark, [0, 1]))
    with pytest.raises(ValueError):
        layers.check_order([layers.Ely, layers.Coastline])
    layers.check_order([layers.Coastline, layers.Ely])


def test_offshore_golden(spark):
    body = [layers.OffshoreLayer(1000.0, 2000.0, 1500.0, 777.0, 80.0, 40.0)]
    chain = layers.Offshore(layers.Constant(rho=2500.0, vp=6000.0, vs=3333.0, qp=1.0, qs=1.0, alpha=0.0), [(0.0, 1000.0)], body)
    p = grid(spark, [100, 2000]).withColumn("coastline", F.lit(5000.0))
    got = layers.evaluate(chain, p).orderBy("k").collect()
    assert got[0].vs == pytest.approx(777) and got[1].vs == pytest.approx(3333)
    trimmed = layers.Offshore(layers.Layer(), [(0.0, 500.0)], [layers.OffshoreLayer(b, 2000.0, 1500.0, v, 1.0, 1.0) for b, v in ((100, 100), (300, 300), (600, 600), (900, 900))])
    assert trimmed.tops == [0.0, 100, 300]


def test_repeated_and_null_points_stay_rows(spark):
    index = cubes(spark, (0, 5, 1))
    at = [(0.5, 0.5, 0.5, 0.5)] * 3 + [(None, 0.5, 0.5, 0.5), (0.5, 0.5, None, None)]
    rows = spark.createDataFrame(at, "x double, y double, z double, depth double")
    got = locate.composite(rows, index).collect()
    assert [r.q.rho for r in got if r.x and r.z] == [5.0] * 3 and [r.q.rho for r in got if r.x is None or r.z is None] == [0.0] * 2
    # two exchanges in all: of the distinct places and of the points, by the same hash; folding needs none
    plan = locate.composite(rows, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_place") == 2


def test_shuffled_cells_give_the_same(spark, monkeypatch):
    index = cubes(spark, (0, 5, 1), (1, 9, 1))
    rows = spark.range(200).selectExpr("id AS n", "id % 7 / 5.0D AS x", "id % 11 / 9.0D AS y", "id % 5 / 4.0D AS z", "id % 5 / 4.0D AS depth")
    want = sorted(map(str, locate.composite(rows, index).collect()))
    monkeypatch.setattr(locate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, locate.composite(rows, index).collect())) == want


def test_one_large_tetrahedron_among_small_ones(spark):
    """Each stands at the level of its own size, in eight cells at most, and the large one is found everywhere it reaches."""
    v, t = meshes.grid_mesh(spark, 0, (0, 0, 0), (1, 1, 1), (4, 4, 4), vp=1.0, vs=1.0, qp=1.0, qs=1.0, rho=7.0)
    far = spark.createDataFrame([(0, 1000 + n, *map(float, at), 9.0, 1.0, 1.0, 1.0, 1.0, 1.0) for n, at in enumerate(((0, 0, 0), (1e5, 0, 0), (0, 1e5, 0), (0, 0, 1e5)))], v.schema)
    big = spark.createDataFrame([(0, 10_000, 1000, 1001, 1002, 1003)], t.schema)
    index = locate.build_index(spark.createDataFrame([(0, "m", 0, "elevation", 1)], MODEL), v.unionByName(far), t.unionByName(big))
    assert index.rows.groupBy("model_id", "tid").count().agg(F.max("count")).first()[0] <= 8 and index.count < 8 * 140
    got = locate.composite(points(spark, (0.5, 0.5, 0.5, 0), (20_000.0, 30_000.0, 40_000.0, 0), (2e4, 3e4, 6e4, 0)), index).orderBy("n").collect()
    assert [r.q.rho for r in got] == [7.0, pytest.approx(9.0), 0.0]
    assert {r.tid for r in locate.hits(points(spark, (0.5, 0.5, 0.5, 0)), index).collect()} >= {10_000}


def test_tetrahedra_with_the_same_planes_are_tested_once_and_count_each(spark):
    v, t = meshes.grid_mesh(spark, 0, (0, 0, 0), (1, 1, 1), (2, 2, 2), rho=1.0, vp=1.0, vs=1.0, qp=1.0, qs=1.0)
    copies = spark.range(1, 50).select(F.col("id").alias("n"))
    # the same places under other numbers, and with values of their own
    v = v.unionByName(v.join(copies).withColumns({"vid": F.col("vid") + F.col("n") * 8, "rho": F.lit(9.0)}).drop("n"))
    t = t.unionByName(t.join(copies).withColumns({"tid": F.col("tid") + F.col("n") * 5, **{f"v{k}": F.col(f"v{k}") + F.col("n") * 8 for k in range(4)}}).drop("n"))
    index, plain = locate.build_index(spark.createDataFrame([(0, "m", 0, "elevation", 1)], MODEL), v, t), cubes(spark, (0, 1, 1))
    assert index.rows.count() == plain.rows.count() and index.tets == 250
    asked = points(spark, (0.5, 0.5, 0.5, 0), (5, 5, 5, 0))
    want = {r["n"]: r["tid"] for r in locate.hits(asked, plain).collect()}
    got = locate.hits(asked, index).orderBy("tid").collect()
    assert [(r["n"], r["tid"]) for r in got] == [(0, want[0] + 5 * k) for k in range(50)] and [r["q"]["rho"] for r in got] == [1] + [9] * 49
    for counts in (locate.COUNTS, ("held",)):
        made = {r["n"]: r for r in locate.query_stats(asked, index, output="q", counts=counts).collect()}
        assert made[0]["held"] == 50 and made[0]["hit_count"] == 1 and made[0]["q"]["rho"] == 1
        assert made[1]["held"] == 0 and made[1]["hit_count"] == 0 and tuple(made[1]["q"]) == (0,) * 6
    assert made[0].asDict().keys() == {*asked.columns, "q", "held", "hit_count"}
    assert locate.composite(asked, index).filter("n = 0").first()["q"]["rho"] == 1
