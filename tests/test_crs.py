"""Reference systems by number."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.functions import crs
from tetrafield.plans import config
from tetrafield.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["crs_forward", "crs_zones"])
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


def test_numbers():
    assert crs.of("epsg:2193") == crs.of(2193) == crs.of("2193") == crs.NZTM
    assert [crs.of(c).lon0 for c in (32601, 32660, 32760, 2133, 2135, 25832, 26923, 28356, 7846, 7859)] == [-177, 177, 177, 165, 177, 9, -45, 153, 93, 171]
    assert crs.of(32632).northing0 == 0 and crs.of(32732).northing0 == crs.of(2133).northing0 == 1e7
    for wrong in (3857, 32600, 32661, 32761, "EPSG:", "abc", True, 25827, 2136):
        with pytest.raises(ValueError):
            crs.of(wrong)
    assert config.crs_name(2193) == config.crs_name("epsg:2193") == "EPSG:2193"


def test_published_points(spark):
    """On the meridian of a zone, a degree from the equator: the arc's length by the ellipsoid's series, times the scale."""
    f = 1 / crs.WGS84.inverse_flattening
    e2, lat = f * (2 - f), math.radians(1)
    steps = 20_000
    arc = sum(crs.WGS84.a * (1 - e2) / (1 - e2 * math.sin(lat * (k + 0.5) / steps) ** 2) ** 1.5 * lat / steps for k in range(steps))
    assert crs.of(32631).point(3.0, 1.0) == pytest.approx((500_000, 0.9996 * arc), abs=1e-4)
    # The example of the public guidance note on map projections: the grid of Great Britain.
    grid = crs.TransverseMercator(-2.0, 0.9996012717, 400_000.0, -100_000.0, 6_377_563.396, 299.3249646, lat0=49.0)
    assert grid.point(0.5, 50.5) == pytest.approx((577_274.99, 69_740.50), abs=0.02)
    row = spark.range(1).select(*grid.inverse(F.lit(577_274.99), F.lit(69_740.50))).first()
    assert tuple(row) == pytest.approx((0.5, 50.5), abs=1e-6)
    assert replace(grid, lat0=0.0).point(0.5, 50.5)[1] > 5e6


def test_rows_without_a_place_or_zone(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (180.0, 10.0), (-180.0, 10.0), (539.0, 10.0)], "lon double, lat double")
    got = rows.select(*(c.alias(n) for n, c in zip(("code", "e", "n"), crs.utm(F.col("lon"), F.col("lat"))))).collect()
    assert got[0].e is None and got[1].n is None and [r.code for r in got[2:]] == [32601, 32601, 32660]
    assert got[2].e == pytest.approx(got[3].e) and got[2].n == pytest.approx(got[3].n)
    back = spark.createDataFrame([(2193, 1.6e6, 1e7), (32661, 5e5, 1e6), (None, 5e5, 1e6)], "c int, e double, n double").select(*crs.from_utm(F.col("c"), F.col("e"), F.col("n"))).collect()
    assert all(tuple(r) == (None, None) for r in back)


def test_requests_in_a_zone(spark):
    own = {"origin_lon": 174.0, "origin_lat": -41.0, "azimuth": 20.0}
    frame, world = config.frame_of(own | {"crs": 32760}), config.frame_of(own)
    assert (frame.origin_x, frame.origin_y) == pytest.approx(crs.of(32760).point(174.0, -41.0)) and frame != world
    grid = {"type": "borehole", "surface": 0.0, "depth": 1.0, "resolution_z": 1.0, "sites": [{"longitude": 174.0, "latitude": -41.0}], "projection": "EPSG:32760"}
    made = config.run(spark, config.Request(grid, [{"type": "constant", "vs": 1.0, "alpha": 1.0}])).first()
    assert (made.x, made.y) == pytest.approx(crs.of(32760).point(174.0, -41.0))
    for wrong in ({"projection": 3857}, {"sites_crs": "EPSG:2193"}, {"projection": {"crs": "north"}}):
        with pytest.raises(config.ConfigError):
            config.Request(grid | wrong, [])
