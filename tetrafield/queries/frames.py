"""Frames, limits and fits; joining meshes and interfaces; which stations and models are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import footprints, layers, meshes, sites, surfaces
from ..sources import tables
from . import chains, points, rasters

QUERIES, SQL = {}, {}
KEY = "p_partkey"
ORIGIN, TURN = (1_600_000.0, 5_000_000.0), 140.0


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the world in a model's mirrored and turned frame, in kilometres."""
    frame = numeric.model_frame(*ORIGIN, TURN, reflect=True).tolist()
    local = numeric.affine(frame, F.col(KEY) * 100.0, F.col("p_size") * 1000.0, F.col(KEY) % 9 * 50.0)
    return _part(spark, sf_dir).select("p_partkey", *(F.round(c, 6).alias(a) for a, c in zip("xyz", local, strict=True)))


QUERIES["model_frame"] = model_frame
SQL["model_frame"] = """WITH s AS (SELECT p_partkey, -(p_partkey * 100.0::DOUBLE - 1600000) / 1000 AS u, (p_size * 1000.0::DOUBLE - 5000000) / 1000 AS v, p_partkey % 9 * 0.05::DOUBLE AS z,
  cos(radians(140)) AS c, sin(radians(140)) AS s FROM part)
SELECT p_partkey, round(c * u - s * v, 6) AS x, round(s * u + c * v, 6) AS y, round(z, 6) AS z FROM s"""


def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world's bounds of five meshes whose vertices are in the model's frame."""
    own = _part(spark, sf_dir).select((F.col(KEY) % 5).alias("model_id"), F.col("p_size").cast("double").alias("x"), (F.col(KEY) % 100).cast("double").alias("y"), (F.col(KEY) % 7).cast("double").alias("z"))
    made = meshes.world_bounds(own, numeric.model_frame(*ORIGIN, TURN, reflect=True).tolist(), pad=0.5)
    return made.select("model_id", *(F.round(f"{n}{a}", 4).alias(f"{n}{a}") for n in ("min", "max") for a in "xyz"))


QUERIES["world_bounds"] = world_bounds
SQL["world_bounds"] = """WITH t AS (SELECT p_partkey % 5 AS model_id, p_size::DOUBLE AS u, (p_partkey % 100)::DOUBLE AS v, (p_partkey % 7)::DOUBLE AS w, cos(radians(140)) AS c, sin(radians(140)) AS s FROM part),
p AS (SELECT model_id, -1000 * (c * u + s * v) + 1600000 AS x, 1000 * (c * v - s * u) + 5000000 AS y, 1000 * w AS z FROM t)
SELECT model_id, round(min(x) - 0.5, 4) AS minx, round(min(y) - 0.5, 4) AS miny, round(min(z) - 0.5, 4) AS minz, round(max(x) + 0.5, 4) AS maxx, round(max(y) + 0.5, 4) AS maxy, round(max(z) + 0.5, 4) AS maxz
FROM p GROUP BY model_id"""


def diff_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the greatest difference of two ranges' composites."""
    return surfaces.limits(points.model_diff(spark, sf_dir), ["d_vs", "d_rho", "log_vs"])


QUERIES["diff_limits"] = diff_limits
SQL["diff_limits"] = f"""WITH d AS ({points.SQL["model_diff"]})
SELECT 'd_vs' AS component, min(d_vs) AS lowest, max(d_vs) AS highest, count(d_vs) AS n FROM d
UNION ALL SELECT 'd_rho', min(d_rho), max(d_rho), count(d_rho) FROM d UNION ALL SELECT 'log_vs', min(log_vs), max(log_vs), count(log_vs) FROM d"""


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = rasters.raster(spark, sf_dir)
    j, k = F.col("iy"), F.col("ix")
    return nodes.select(j.alias("j"), k.alias("k"), (k * 2 + j / 4 + F.col("z") / 64).alias("x"), (j * 3 - k / 8).alias("y"))


SQL_BENT = f"{rasters.SQL_RASTER.format(value='z')}, n AS (SELECT iy AS j, ix AS k, ix * 2 + iy / 4.0::DOUBLE + z / 64 AS x, iy * 3 - ix / 8.0::DOUBLE AS y FROM ras)"


def index_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear guess of a node's numbers by its place, over a bent grid."""
    made = surfaces.index_fit(_bent(spark, sf_dir))
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


QUERIES["index_fit"] = index_fit
SQL["index_fit"] = f"""WITH {SQL_BENT}, m AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(j) AS cj, avg(k) AS ck, avg(x * x) - avg(x) ** 2 AS xx, avg(y * y) - avg(y) ** 2 AS yy, avg(x * y) - avg(x) * avg(y) AS xy,
  avg(j * x) - avg(j) * avg(x) AS ax, avg(j * y) - avg(j) * avg(y) AS ay, avg(k * x) - avg(k) * avg(x) AS bx, avg(k * y) - avg(k) * avg(y) AS bz FROM n), d AS (SELECT *, xx * yy - xy * xy AS det FROM m)
SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(cj, 6) AS cj, round(ck, 6) AS ck, round((ax * yy - ay * xy) / det, 6) AS jx, round((ay * xx - ax * xy) / det, 6) AS jy,
  round((bx * yy - bz * xy) / det, 6) AS kx, round((bz * xx - bx * xy) / det, 6) AS ky FROM d"""


def median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance of neighbours in a row of the bent grid."""
    own = _bent(spark, sf_dir).select(F.col("k").alias("ix"), F.col("j").alias("iy"), "x", "y")
    return surfaces.median_spacing(own).select(F.round("spacing", 6).alias("spacing"))


QUERIES["median_spacing"] = median_spacing
SQL["median_spacing"] = f"""WITH {SQL_BENT}, s AS (SELECT sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS step FROM n WINDOW w AS (PARTITION BY j ORDER BY k))
SELECT round(quantile_cont(step, 0.5), 6) AS spacing FROM s"""


def valid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest window that holds all nodes of large parts in the middle; other nodes have no value."""
    own, _ = rasters.raster(spark, sf_dir)
    nodes = own.withColumn("z", F.when((F.col("z") > 40) & F.col("ix").between(7, 31), F.col("z")).otherwise(F.lit(float("nan"))))
    return surfaces.window(nodes, *surfaces.valid_window(nodes)).select("ix", "iy", numeric.not_nan(F.col("z")).alias("z"))


QUERIES["valid_window"] = valid_window
SQL["valid_window"] = f"""WITH {rasters.SQL_RASTER.format(value='CASE WHEN z > 40 AND key % 40 BETWEEN 7 AND 31 THEN z END')}, b AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM ras WHERE v IS NOT NULL)
SELECT ix, iy, v AS z FROM ras, b WHERE ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1"""


def stacked_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers between four interfaces a column."""
    own = _part(spark, sf_dir).select(F.floor(F.col(KEY) / 4).alias("vid"), (F.col(KEY) % 4).alias("interface"), (F.col("p_size") + F.col(KEY) % 4 * 64.0).alias("depth"))
    return meshes.stacked(own)


QUERIES["stacked_interfaces"] = stacked_interfaces
SQL["stacked_interfaces"] = """WITH i AS (SELECT p_partkey // 4 AS vid, p_partkey % 4 AS layer, p_size + p_partkey % 4 * 64.0::DOUBLE AS top FROM part),
s AS (SELECT *, lead(top) OVER (PARTITION BY vid ORDER BY layer) AS bottom FROM i) SELECT * FROM s WHERE bottom IS NOT NULL"""


def fade_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opacity across a band of 25, and across none."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = F.col("l_quantity") - 10
    return rows.select("l_orderkey", "l_linenumber", F.round(meshes.fade(d, 25.0), 9).alias("wide"), meshes.fade(d, 0.0).alias("none"))


QUERIES["fade_band"] = fade_band
SQL["fade_band"] = "SELECT l_orderkey, l_linenumber, round(1 - least(greatest(l_quantity - 10, 0), 25) / 25.0::DOUBLE, 9) AS wide, 1.0::DOUBLE AS none FROM lineitem"


def concat_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of a mesh in one: the corners of every tetrahedron by their places."""
    own = _part(spark, sf_dir)
    vertices = own.select(F.lit(0).alias("model_id"), F.col(KEY).alias("vid"), *(c.cast("double").alias(a) for a, c in zip("xyz", (F.col("p_size"), F.col(KEY) % 11, F.col(KEY) % 13), strict=True)))
    last = own.agg(F.max("p_partkey")).first()[0]
    tets = own.filter(F.col(KEY) <= last - 3).select(F.lit(0).alias("model_id"), F.col(KEY).alias("tid"), *((F.col(KEY) + n).alias(f"v{n}") for n in range(4)))
    made = meshes.gather(*reversed(meshes.concatenated(*[(vertices, tets)] * 3)), ("x", "y", "z"))
    return made.select("tid", *(f"v{n}" for n in range(4)), *(F.col(f"c{n}.x").alias(f"x{n}") for n in range(4)))


QUERIES["concat_meshes"] = concat_meshes
SQL["concat_meshes"] = """WITH m AS (SELECT max(p_partkey) + 1 AS nv, max(p_partkey) - 2 AS nt FROM part), t AS (SELECT p_partkey AS k, c, nv, nt FROM part, m, generate_series(0, 2) g(c) WHERE p_partkey < nt),
s AS (SELECT p_partkey AS k, p_size::DOUBLE AS s FROM part)
SELECT t.k + c * nt AS tid, t.k + c * nv AS v0, t.k + 1 + c * nv AS v1, t.k + 2 + c * nv AS v2, t.k + 3 + c * nv AS v3, a.s AS x0, b.s AS x1, d.s AS x2, e.s AS x3
FROM t JOIN s a ON a.k = t.k JOIN s b ON b.k = t.k + 1 JOIN s d ON d.k = t.k + 2 JOIN s e ON e.k = t.k + 3"""


def top_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of four vertices tapered from their own tops; small parts have no site velocity of their own and take constants."""
    place = {"model_id": F.lit(0), "vid": F.col(KEY), "x": F.floor(F.col(KEY) / 4).cast("double"), "y": F.lit(0.0), "z": (F.col(KEY) % 4) * 100.0 + F.floor(F.col(KEY) / 4) % 7}
    values = {"rho": 2400.0, "vp": 4000.0, "vs": 2000.0, "qp": 200.0, "qs": 100.0, "alpha": 1.0}
    own = _part(spark, sf_dir).select(*(c.alias(n) for n, c in place.items()), *(F.lit(v).alias(n) for n, v in values.items()), "p_size")
    made = meshes.rewrite_top(own, F.col("p_size") > 10, 250.0, 200.0 + F.col("p_size") * 8, F.lit(4000.0), F.lit(2000.0), {"rho": 1800.0, "vp": 1600.0, "vs": 300.0, "qp": 60.0, "qs": 30.0})
    return made.select("vid", *(F.round(c, 5).alias(c) for c in ("rho", "vp", "vs", "qp", "qs")))


_N = "(d / 250)"
QUERIES["top_rewrite"] = top_rewrite
SQL["top_rewrite"] = f"""WITH v AS (SELECT p_partkey AS vid, p_size, p_partkey // 4 AS c, p_partkey % 4 * 100.0::DOUBLE + p_partkey // 4 % 7 AS z, 200.0::DOUBLE + p_size * 8 AS vs30 FROM part),
w AS (SELECT *, z - min(z) OVER (PARTITION BY c) AS d FROM v),
f AS (SELECT *, {_N} + ({_N} - {_N} * {_N}) * (2 / 3.0::DOUBLE) AS f, 0.5 - 5 * {_N} + 1.5 * {_N} * {_N} + 3 * sqrt({_N}) AS g FROM w),
e AS (SELECT *, d < 250 AS near, f * 2000 + g * vs30 AS evs, f * 4000 + g * ({chains._poly(numeric.VP_OF_VS, 'vs30')}) AS evp FROM f)
SELECT vid, {', '.join(f"round(CASE WHEN near AND p_size > 10 THEN {made} WHEN near THEN {out}::DOUBLE ELSE {under}::DOUBLE END, 5) AS {c}" for c, made, out, under in (
    ("rho", chains._poly(numeric.RHO_OF_VP, "evp"), 1800, 2400), ("vp", "evp", 1600, 4000), ("vs", "evs", 300, 2000), ("qp", "0.1::DOUBLE * evs", 60, 200), ("qs", "0.05::DOUBLE * evs", 30, 100)))} FROM e"""


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("station"), (key * 37 % 101).alias("ordinal"))


def site_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty stations of a list, as a run with a limit takes them."""
    return sites.first(_stations(spark, sf_dir), 50)


def site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was made for stations, with their place in the list."""
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("station")).agg(F.count(F.lit(1)).alias("n"))
    return sites.in_order(made, _stations(spark, sf_dir)).select("station", "ordinal", "n")


def site_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that a list of orders names more than once."""
    return sites.repeated(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("station")))


QUERIES |= {"site_first": site_first, "site_order": site_order, "site_repeats": site_repeats}
SQL["site_first"] = "SELECT c_custkey AS station, c_custkey * 37 % 101 AS ordinal FROM customer ORDER BY ordinal, station LIMIT 50"
SQL["site_order"] = "SELECT c_custkey AS station, c_custkey * 37 % 101 AS ordinal, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
SQL["site_repeats"] = "SELECT o_custkey AS station, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1"


def models_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose bounds meet a rectangle; those without bounds stay."""
    k, bounded = F.col("s_suppkey"), F.col("s_suppkey") % 7 > 0
    box = {"minx": k % 50 * 2.0, "maxx": k % 50 * 2.0 + 3, "miny": k % 5 * 1.0, "maxy": k % 5 + 0.5}
    models = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("model_id"), *(F.when(bounded, c).alias(n) for n, c in box.items()))
    return layers.prune(models, (10.0, 20.0), (1.5, 3.0)).select("model_id", "minx", "miny")


QUERIES["models_in_domain"] = models_in_domain
SQL["models_in_domain"] = """WITH m AS (SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 50 * 2.0::DOUBLE END AS minx, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 5)::DOUBLE END AS miny FROM supplier)
SELECT * FROM m WHERE minx IS NULL OR (minx <= 20 AND minx + 3 >= 10 AND miny <= 3 AND miny + 0.5 >= 1.5)"""


TURNED = [(30.0, 5.0), (70.0, 30.0), (60.0, 46.0), (20.0, 21.0)]  # a rectangle across the axes


def models_in_turned_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of three corners each whose footprints meet a turned rectangle; many whose boxes meet its own box don't."""
    k = F.col("s_suppkey")
    x, y, s = k * 7 % 101 * 1.0, k * 3 % 53 * 1.0, k % 6 + 0.5
    corner = F.explode(F.array(*(F.struct((x + a * s).alias("x"), (y + b * s).alias("y")) for a, b in ((0, 0), (1, 0), (0, 1))))).alias("p")
    vertices = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("long").alias("model_id"), corner).select("model_id", "p.*")
    return footprints.prune(footprints.footprints(vertices, pad=0.0), TURNED).select("model_id", F.round(F.col("footprint")[0], 6).alias("east"), F.round(F.col("footprint")[4], 6).alias("north"))


QUERIES["models_in_turned_domain"] = models_in_turned_domain


def _overlap_sql(u: float, v: float) -> str:
    """Whether the shadows of a model and of the rectangle on an axis have a point in common."""
    own, at = [f"({x}) * {u!r}::DOUBLE + ({y}) * {v!r}::DOUBLE" for x, y in (("x", "y"), ("x + s", "y"), ("x", "y + s"))], [a * u + b * v for a, b in TURNED]
    return f"greatest({', '.join(own)}) >= {min(at)!r}::DOUBLE AND least({', '.join(own)}) <= {max(at)!r}::DOUBLE"


# The axes across a model's three sides and along the rectangle's two.
SQL["models_in_turned_domain"] = f"""WITH m AS (SELECT s_suppkey::BIGINT AS model_id, (s_suppkey * 7 % 101)::DOUBLE AS x, (s_suppkey * 3 % 53)::DOUBLE AS y, s_suppkey % 6 + 0.5::DOUBLE AS s FROM supplier)
SELECT model_id, round(x + s, 6) AS east, round(y + s, 6) AS north FROM m WHERE {" AND ".join(_overlap_sql(u, v) for u, v in ((1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (40.0, 25.0), (-10.0, 16.0)))}"""


def uniform_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rock in layers that end at depths from a table of a few dozen rows."""
    bottoms = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(((F.col("n_nationkey") + 1) * 100.0).alias("b")).orderBy("b").collect()]
    return tables.uniform_profile(spark, "rho=2000, vp=1800, vs=600, qp=60, qs=30", bottoms)


QUERIES["uniform_layers"] = uniform_layers
SQL["uniform_layers"] = """SELECT 1800.0::DOUBLE AS vp, 600.0::DOUBLE AS vs, 2000.0::DOUBLE AS rho, 60.0::DOUBLE AS qp, 30.0::DOUBLE AS qs, n_nationkey * 100.0::DOUBLE AS z,
  (n_nationkey + 1) * 100.0::DOUBLE AS bottom, 100.0::DOUBLE AS thickness FROM nation"""
