import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetrafield.functions import algebra, numeric
from tetrafield.schema import COMPONENTS, quality


def blend(spark, a, b):
    r = spark.range(1).select(algebra.over(quality(**a), quality(**b)).alias("q")).first()["q"]
    return {c: r[c] for c in COMPONENTS}


def test_known_blends(spark):
    even = dict(vp=1000.0, vs=500.0, rho=1.0, qs=1.0)
    assert blend(spark, even | dict(qp=100.0, alpha=0.5), even | dict(qp=300.0, alpha=0.5))["qp"] != 0
    got = blend(spark, dict(vs=300.0, qs=15.0, qp=1.0, vp=1.0, alpha=0.5), dict(vs=2900.0, qs=145.0, qp=1.0, vp=1.0, alpha=1.0))
    assert got["qs"] == pytest.approx(80)
    got = blend(spark, dict(vs=0.0, qs=100.0, qp=1.0, vp=1.0, alpha=0.5), dict(vs=0.0, qs=300.0, qp=1.0, vp=1.0, alpha=1.0))
    assert got["qs"] == pytest.approx(150)
    same = dict(rho=2000.0, vp=4000.0, vs=2000.0, qp=100.0, qs=50.0, alpha=0.5)
    assert blend(spark, same, same)["alpha"] == 0.75


def test_transparent_leaves_the_other(spark):
    under = dict(rho=1.0, vp=2.0, vs=3.0, qp=4.0, qs=5.0, alpha=0.25)
    assert blend(spark, dict(alpha=0.0), under) == under
    assert blend(spark, under, dict(alpha=0.0)) == under


positive = st.floats(1.0, 1e4, allow_nan=False)
alpha = st.floats(0.0, 1.0, allow_nan=False)
sample = st.fixed_dictionaries({c: positive for c in COMPONENTS[:-1]} | {"alpha": alpha})


def test_properties(spark):
    """Blends stay between their parts, are at least as opaque, and keep Q in proportion to velocity."""
    cases = []

    @settings(max_examples=60, database=None, suppress_health_check=list(HealthCheck))
    @given(sample, sample)
    def collect(a, b):
        cases.append((a, b))

    collect()
    schema = "a struct<rho:double,vp:double,vs:double,qp:double,qs:double,alpha:double>, b struct<rho:double,vp:double,vs:double,qp:double,qs:double,alpha:double>"
    df = spark.createDataFrame([(tuple(a[c] for c in COMPONENTS), tuple(b[c] for c in COMPONENTS)) for a, b in cases], schema)
    for r in df.select("a", "b", algebra.over(F.col("a"), F.col("b")).alias("q")).collect():
        assert r.q.alpha >= max(r.a.alpha, r.b.alpha) * (1 - 1e-9) or min(r.a.alpha, r.b.alpha) < 2e-7
        for c in COMPONENTS[:-1]:
            lo, hi = sorted((r.a[c], r.b[c]))
            assert lo * (1 - 1e-6) <= r.q[c] <= hi * (1 + 1e-6)


def test_ely_golden(spark):
    want = {0: (200.0, 832.00635, 1091.9526), 30: (660.222, 2150.552, 1969.374), 175: (1531.8615, 3492.5498, 2317.0644), 350: (2000.0, 4000.0, 2393.344)}
    for depth, (vs, vp, rho) in want.items():
        q = spark.range(1).select(numeric.ely_profile(F.lit(float(depth)), F.lit(400.0), F.lit(4000.0), F.lit(2000.0), 350.0).alias("q")).first()["q"]
        assert (q.vs, q.vp, q.rho) == (pytest.approx(vs, rel=1e-5), pytest.approx(vp, rel=1e-5), pytest.approx(rho, rel=1e-5))
        assert q.qs == pytest.approx(0.05 * q.vs) and q.qp == pytest.approx(0.1 * q.vs)


def test_numbers(spark):
    row = spark.range(1).select(
        numeric.clip(F.lit(5.0), 1, 3).alias("a"), numeric.clip(F.lit(None).cast("double"), 1, 3).alias("b"), numeric.clip(F.lit(0.0), 4, 3).alias("c"),
        numeric.interpolate(F.lit(1.5), [0, 1, 2], [0, 10, 30]).alias("d"), numeric.step(F.lit(2.0), [0, 1, 2], [5, 6, 7]).alias("e"), numeric.step(F.lit(-1.0), [0, 1, 2], [5, 6, 7]).alias("f"),
        numeric.morton(F.lit(1), F.lit(1), F.lit(1)).alias("g"), numeric.decay_weight("sleve", F.lit(0.0), F.lit(-5.0), scale=1000.0, length=5000.0).alias("h"),
    ).first()
    assert tuple(row) == (3.0, None, 3.0, 20.0, 7.0, 5.0, 7, 1.0)
    weights = [spark.range(1).select(numeric.decay_weight("tapered", F.lit(float(a)), F.lit(-1000.0), ratio=2.0)).first()[0] for a in (0, 1000, 2000, 3000)]
    assert weights == [1, 0.5, 0, 0] and math.isfinite(sum(weights))
