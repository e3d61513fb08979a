"""Rasters, coastlines and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import synthetic
from ..operators import coastline, grids, surfaces
from . import world

QUERIES, SQL = {}, {}
NX = 40  # columns of the raster made of part


def raster(spark: SparkSession, sf_dir: str, holes: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """part as nodes: 40 to a row, with part's size as value; where its last row is short, nodes are missing."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey") - p_first(p)
    ny = -(-p.count() // NX)
    value = F.col("p_size").cast("double")
    value = F.when(key % 11 != 0, value).otherwise(F.lit(float("nan"))) if holes else value
    return p.select((key % NX).alias("ix"), F.floor(key / NX).alias("iy"), value.alias("z")), (NX, ny)


def p_first(p: DataFrame) -> int:
    return p.agg(F.min("p_partkey")).first()[0]


SQL_RASTER = """pk AS (SELECT p_partkey - min(p_partkey) OVER () AS key, p_size::DOUBLE AS z, (count(*) OVER () + 39) // 40 AS ny FROM part),
ras AS (SELECT key % 40 AS ix, key // 40 AS iy, z, ny, {value} AS v FROM pk)"""
SQL_LOOKUP = """ats AS (SELECT p.*, ny, greatest(least(floor(x * 8), 38), 0) AS jx, greatest(least(floor(y), ny - 2), 0) AS jy FROM pts p, (SELECT max(ny) AS ny FROM ras)),
tt AS (SELECT *, x * 8 - jx AS tx, y - jy AS ty FROM ats),
uu AS (SELECT *, least(greatest(tx, 0), 1) AS u, least(greatest(ty, 0), 1) AS w,
  tx < -1e-9 OR tx > 1 + 1e-9 OR ty < -1e-9 OR ty > 1 + 1e-9 AS outside FROM tt),
zz AS (SELECT uu.*, CASE WHEN (1-u)*(1-w) = 0 THEN 0 ELSE (1-u)*(1-w) * a.v END + CASE WHEN u*(1-w) = 0 THEN 0 ELSE u*(1-w) * b.v END
  + CASE WHEN (1-u)*w = 0 THEN 0 ELSE (1-u)*w * c.v END + CASE WHEN u*w = 0 THEN 0 ELSE u*w * d.v END AS zs
  FROM uu LEFT JOIN ras a ON a.ix = jx AND a.iy = jy LEFT JOIN ras b ON b.ix = jx + 1 AND b.iy = jy
  LEFT JOIN ras c ON c.ix = jx AND c.iy = jy + 1 LEFT JOIN ras d ON d.ix = jx + 1 AND d.iy = jy + 1)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.lineitem_points(spark, sf_dir).select(*world.POINT, "z", "x", "y")


def bilinear_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, shape = raster(spark, sf_dir)
    made = surfaces.bilinear(_points(spark, sf_dir), nodes, shape, spacing=(0.125, 1.0), extrapolate=True)
    return made.select(*world.POINT, "z", F.round("surface", 6).alias("surface"))


def bilinear_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, shape = raster(spark, sf_dir, holes=True)
    made = surfaces.bilinear(_points(spark, sf_dir), nodes, shape, spacing=(0.125, 1.0))
    return made.select(*world.POINT, "z", F.round("surface", 6).alias("surface"))


QUERIES |= {"bilinear_clamp": bilinear_clamp, "bilinear_nan": bilinear_nan}
_HEAD = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, "
SQL["bilinear_clamp"] = f"WITH {world.SQL_POINTS}, {SQL_RASTER.format(value='z')}, {SQL_LOOKUP} {_HEAD} round(zs, 6) AS surface FROM zz"
SQL["bilinear_nan"] = f"WITH {world.SQL_POINTS}, {SQL_RASTER.format(value='CASE WHEN key % 11 <> 0 THEN z END')}, {SQL_LOOKUP} {_HEAD} round(CASE WHEN NOT outside THEN zs END, 6) AS surface FROM zz"


def raster_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, shape = raster(spark, sf_dir, holes=True)
    return surfaces.coarsen(nodes, 2, shape).select("ix", "iy", F.round("z", 6).alias("z"))


QUERIES["raster_coarsen"] = raster_coarsen
SQL["raster_coarsen"] = f"""WITH {SQL_RASTER.format(value='CASE WHEN key % 11 <> 0 THEN z END')}
SELECT ix // 2 AS ix, iy // 2 AS iy, round(avg(v), 6) AS z FROM ras WHERE ix // 2 < 20 AND iy // 2 < ny // 2 GROUP BY ALL"""


def surface_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.value_range(raster(spark, sf_dir, holes=True)[0])


QUERIES["surface_range"] = surface_range
SQL["surface_range"] = f"WITH {SQL_RASTER.format(value='CASE WHEN key % 11 <> 0 THEN z END')} SELECT min(v) AS lowest, max(v) AS highest, count(v) AS n FROM ras"


def depth_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points' z as depth below the raster."""
    nodes, shape = raster(spark, sf_dir)
    made = surfaces.depth_below(_points(spark, sf_dir), nodes, shape, spacing=(0.125, 1.0))
    return made.select(*world.POINT, "z", F.round("depth", 6).alias("depth"))


QUERIES["depth_below"] = depth_below
SQL["depth_below"] = f"WITH {world.SQL_POINTS}, {SQL_RASTER.format(value='z')}, {SQL_LOOKUP} {_HEAD} round(z - zs, 6) AS depth FROM zz"


def quad_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheared grid of 9 by 9 nodes over the points: the value is linear in x and y, so the lookup must give it back."""
    n = F.col("id")
    j, k = F.floor(n / 9), n % 9
    nodes = spark.range(81).select(j.alias("j"), k.alias("k"), (k + j / 4 - 1).alias("x"), (j + k / 8 - 1).alias("y")).withColumn("value", 3 * F.col("x") - 2 * F.col("y") + 5)
    made = surfaces.in_quads(_points(spark, sf_dir), nodes, 1)
    return made.select(*world.POINT, "z", F.round("value", 6).alias("value"))


QUERIES["quad_lookup"] = quad_lookup
SQL["quad_lookup"] = f"""WITH {world.SQL_POINTS}, s AS (SELECT *, (x + 1 - (y + 1) / 4) / (1 - 1 / 32.0::DOUBLE) AS k FROM pts), r AS (SELECT *, y + 1 - k / 8 AS j FROM s)
{_HEAD} round(CASE WHEN k >= -1e-9 AND k <= 8 + 1e-9 AND j >= -1e-9 AND j <= 8 + 1e-9 THEN 3 * x - 2 * y + 5 END, 6) AS value FROM r"""

RINGS = [(0, [(1, 1), (7, 1), (7, 6), (4, 4), (1, 7)]), (1, [(2, 2), (2, 3), (3, 3), (3, 2)])]  # land, and a lake in it


def lines(spark: SparkSession) -> DataFrame:
    rows = [(ring, n, float(x), float(y)) for ring, points in RINGS for n, (x, y) in enumerate([*points, points[0]])]
    return coastline.segments(spark.createDataFrame(rows, "ring int, n int, x double, y double"))


SQL_LINES = "seg(ax, ay, bx, bz) AS (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for _, p in RINGS for a, b in zip(p, [*p[1:], p[0]])) + ")"


def sql_coast(points: str) -> str:
    """CTE `coast` (x, y, d, odd)."""
    return f"""{SQL_LINES}, cxy AS (SELECT DISTINCT x, y FROM {points}),
cst AS (SELECT x, y, ax, ay, bx, bz, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)), 0), 1) AS t FROM cxy, seg),
coast AS (SELECT x, y, sqrt(min((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (bz - ay)) ** 2)) AS d,
  count(*) FILTER (least(ay, bz) <= y AND y < greatest(ay, bz) AND ax + (y - ay) * (bx - ax) / (bz - ay) > x) % 2 AS odd FROM cst GROUP BY x, y)"""


def coast_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = coastline.signed_distance(_points(spark, sf_dir), lines(spark))
    return made.select(*world.POINT, "z", F.round("coastline", 6).alias("coastline"))


def coast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With cells far finer than the segments."""
    made = coastline.signed_distance(_points(spark, sf_dir), lines(spark), size=0.25)
    return made.select(*world.POINT, "z", F.round(F.abs("coastline"), 6).alias("distance"))


def coast_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = coastline.signed_distance(_points(spark, sf_dir), lines(spark))
    return made.select(*world.POINT, "z", (F.col("coastline") < 0).alias("on_land"))


def coast_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coast with a segment for each order, closed by three long ones; customers as points, some without a place or far off."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    height = 64 + F.col("o_custkey") * 7 % 128 / 4
    own = orders.select((F.col("o_orderkey") / 4).alias("ax"), height.alias("ay"), "o_orderkey")
    after = own.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    last = own.agg(F.min_by("ay", "o_orderkey").alias("y0"), F.max_by("ay", "o_orderkey").alias("y1"), F.min("ax").alias("x0"), F.max("ax").alias("x1"))
    corner = lambda *of: F.struct(*((F.col(v) if isinstance(v, str) else F.lit(float(v))).alias(c) for c, v in zip(("ax", "ay", "bx", "by"), of)))
    ends = last.select(F.explode(F.array(corner("x0", "y0", "x0", 0), corner("x0", 0, "x1", 0), corner("x1", 0, "x1", "y1"))).alias("s")).select("s.*")
    line = own.join(after, "o_orderkey").select("ax", "ay", "bx", "by").unionByName(ends)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = F.when(F.col("c_custkey") % 50 == 7, F.lit(float("nan"))).when(F.col("c_custkey") % 50 != 8, F.col("c_custkey") * 131 % 4096 - 128 + 0.125)
    y = F.col("c_custkey") * 17 % 256 / 2 + 0.0625 + F.when(F.col("c_custkey") % 50 == 9, 100_000.0).otherwise(0.0)
    made = coastline.signed_distance(c.select("c_custkey", x.alias("x"), y.alias("y")), line)
    return made.select("c_custkey", "y", F.round("coastline", 6).alias("coastline"))


QUERIES["coast_many"] = coast_many
SQL["coast_many"] = """WITH o AS (SELECT o_orderkey, o_orderkey / 4.0::DOUBLE AS x, 64 + o_custkey * 7 % 128 / 4.0::DOUBLE AS y FROM orders),
seg AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM o a JOIN o b ON b.o_orderkey = a.o_orderkey + 1
  UNION ALL SELECT min(x), arg_min(y, o_orderkey), min(x), 0.0 FROM o UNION ALL SELECT min(x), 0.0, max(x), 0.0 FROM o UNION ALL SELECT max(x), 0.0, max(x), arg_max(y, o_orderkey) FROM o),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 50 NOT IN (7, 8) THEN c_custkey * 131 % 4096 - 128 + 0.125::DOUBLE END AS x,
             c_custkey * 17 % 256 / 2.0::DOUBLE + 0.0625 + CASE WHEN c_custkey % 50 = 9 THEN 100000.0::DOUBLE ELSE 0 END AS y FROM customer),
t AS (SELECT c_custkey, x, y, ax, ay, bx, bz, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)), 0), 1) AS t FROM p, seg WHERE x IS NOT NULL),
d AS (SELECT c_custkey, sqrt(min((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (bz - ay)) ** 2)) AS d,
  count(*) FILTER (least(ay, bz) <= y AND y < greatest(ay, bz) AND ax + (y - ay) * (bx - ax) / (bz - ay) > x) % 2 AS odd FROM t GROUP BY c_custkey)
SELECT p.c_custkey AS c_custkey, y, round(CASE WHEN odd = 1 THEN -d ELSE d END, 6) AS coastline FROM p LEFT JOIN d USING (c_custkey)"""
QUERIES |= {"coast_signed": coast_signed, "coast_distance": coast_distance, "coast_contains": coast_contains}
_COAST = f"WITH {world.SQL_POINTS}, {sql_coast('pts')} {_HEAD}"
SQL["coast_signed"] = f"{_COAST} round(CASE WHEN odd = 1 THEN -d ELSE d END, 6) AS coastline FROM pts JOIN coast USING (x, y)"
SQL["coast_distance"] = f"{_COAST} round(d, 6) AS distance FROM pts JOIN coast USING (x, y)"
SQL["coast_contains"] = f"{_COAST} odd = 1 AND d > 0 AS on_land FROM pts JOIN coast USING (x, y)"


def hill(x: Column, y: Column) -> Column:
    """A surface (positive down) in closed form: a ridge above the sea in the west, a trough in the east."""
    return (x * x - y) / 16


def surface(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, hill(F.col("x"), F.col("y")))


def grid_out() -> list:
    return ["grid", "i", "j", "k", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "depth", "nominal_depth"))]


_OUT = "i, j, k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(depth, 6) AS depth, round(a, 6) AS nominal_depth"
_S = "(x * x - y) / 16"


def ground(spark: SparkSession, sf_dir: str) -> tuple[grids.Surface, int]:
    """The raster of parts as a surface about the sea, and how many rows it has: grids below are as long as it."""
    nodes, shape = raster(spark, sf_dir)
    return (lambda rows, name: surfaces.bilinear(rows, nodes, shape, spacing=(0.125, 1.0), extrapolate=True, name=name).withColumn(name, (F.col(name) - 25) / 16)), shape[1]


def _ground_sql(ni: int, nj: str, rx: float, ry: float) -> str:
    """CTE `gr` (i, j, x, y, s): columns of a grid of ni by nj (of ny, the raster's rows) and the ground there."""
    return f"""{SQL_RASTER.format(value='z')}, pts AS (SELECT i, j, (i - {ni / 2}::DOUBLE) * {rx}::DOUBLE AS x, (j - ({nj}) / 2.0::DOUBLE) * {ry}::DOUBLE AS y
  FROM generate_series(0, {ni - 1}) a(i), (SELECT rows AS ny_, unnest(generate_series(0, ({nj.replace('ny', 'rows')}) - 1)) AS j FROM (SELECT max(ny) AS rows FROM ras)) b, (SELECT max(ny) AS ny FROM ras) c), {SQL_LOOKUP},
gr AS (SELECT i, j, x, y, (zs - 25) / 16 AS s FROM zz)"""


def grid_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, ny = ground(spark, sf_dir)
    return grids.regular(spark, own, 8.0, float(ny), 2.0, 0.5, 0.25, 0.25).select(*grid_out())


QUERIES["grid_regular"] = grid_regular
SQL["grid_regular"] = f"""WITH {_ground_sql(17, 'ny * 4 + 1', 0.5, 0.25)}, p AS (SELECT *, k * 0.25::DOUBLE AS a FROM gr, generate_series(0, 8) g(k))
SELECT 'grid' AS grid, {_OUT} FROM (SELECT *, s + a AS z, a AS depth FROM p)"""


def grid_sw4(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, ny = ground(spark, sf_dir)
    return grids.sw4(spark, own, 8.0, float(ny), {"top": (0.25, 1.0), "middle": (0.5, 3.0), "bottom": (1.0, 8.0)}).select(*grid_out())


def _sw4_sql(name: str, r: float, stride: int, top: float, bottom: float, first: bool) -> str:
    weight = f"least(greatest(1 - a / {bottom}::DOUBLE, 0), 1)" if first else "0.0::DOUBLE"
    return f"""SELECT '{name}' AS grid, {_OUT} FROM (SELECT *, a + w * s AS z, a + (w * s - s) AS depth FROM (SELECT *, {weight} AS w
  FROM (SELECT *, {top}::DOUBLE + k * {r}::DOUBLE AS a FROM (SELECT * FROM gr WHERE i % {stride} = 0 AND j % {stride} = 0), generate_series(0, {round((bottom - top) / r)}) g(k))))"""


QUERIES["grid_sw4"] = grid_sw4
_BLOCKS = [_sw4_sql("top", 0.25, 1, 0.0, 1.0, True), _sw4_sql("middle", 0.5, 2, 1.0, 3.0, False), _sw4_sql("bottom", 1.0, 4, 3.0, 8.0, False)]
SQL["grid_sw4"] = f"WITH {_ground_sql(33, 'ny * 4 + 1', 0.25, 0.25)} {' UNION ALL '.join(_BLOCKS)}"


def _emod3d(decay: str, weight: str, **options: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, ny = ground(spark, sf_dir)
        return grids.emod3d(spark, own, 12, 2 * ny, 9, 0.5, decay, **options).select(*grid_out())

    sql = f"""WITH {_ground_sql(12, 'ny * 2', 0.5, 0.5)}, p AS (SELECT *, k * 0.5::DOUBLE AS a FROM gr, generate_series(0, 8) g(k)), q AS (SELECT *, {weight} AS w FROM p)
SELECT 'grid' AS grid, {_OUT} FROM (SELECT *, a + CASE WHEN w = 0 THEN 0 ELSE w * s END AS z, a + (CASE WHEN w = 0 THEN 0 ELSE w * s END - s) AS depth FROM q)"""
    return query, sql


for _name, _args in {
    "grid_emod3d": ("squashed", "1.0::DOUBLE", {}), "decay_linear": ("linear", "least(greatest(1 - a / 3.0::DOUBLE, 0), 1)", {"length": 3.0}),
    "decay_tapered": ("tapered", "CASE WHEN -s > 0 THEN least(greatest(1 - a / (2.5::DOUBLE * -s), 0), 1) ELSE 1.0 END", {"ratio": 2.5}),
    "decay_sleve": ("sleve", "exp(greatest(3.5::DOUBLE - a, 0) / 2 - 3.5::DOUBLE / 2) * (exp(-greatest(3.5::DOUBLE - a, 0)) - 1) / (exp(-3.5::DOUBLE) - 1)", {"scale": 2.0, "length": 3.5}),
}.items():
    QUERIES[_name], SQL[_name] = _emod3d(_args[0], _args[1], **_args[2])


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 16 / 2).alias("x"), (F.floor(F.col("s_suppkey") / 16) % 16 / 2).alias("y"), F.col("s_name").alias("station"))


def grid_borehole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.borehole(_sites(spark, sf_dir), surface, 3.0, 0.5, ["station"]).select(*grid_out(), "station")


QUERIES["grid_borehole"] = grid_borehole
_SITES = "(SELECT s_suppkey AS i, 0::BIGINT AS j, s_suppkey % 16 / 2.0::DOUBLE AS x, s_suppkey // 16 % 16 / 2.0::DOUBLE AS y, s_name AS station FROM supplier)"
SQL["grid_borehole"] = f"SELECT 'grid' AS grid, {_OUT}, station FROM (SELECT *, s + a AS z, a AS depth FROM (SELECT *, {_S} AS s, k * 0.5::DOUBLE AS a FROM {_SITES}, generate_series(0, 6) g(k)))"


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = c.select(F.col("c_custkey").alias("i"), (F.col("c_custkey") % 64 / 8).alias("x"), (F.col("c_nationkey") / 4).alias("y"), (F.col("c_custkey") % 9 - 4.0).alias("z"))
    return grids.scattered(own, surface).select(*grid_out())


QUERIES["grid_points"] = grid_points
SQL["grid_points"] = f"""WITH p AS (SELECT c_custkey AS i, 0::BIGINT AS j, 0::BIGINT AS k, c_custkey % 64 / 8.0::DOUBLE AS x, c_nationkey / 4.0::DOUBLE AS y, c_custkey % 9 - 4.0::DOUBLE AS z0 FROM customer)
SELECT 'grid' AS grid, {_OUT} FROM (SELECT *, z - s AS depth, z - s AS a FROM (SELECT *, greatest(z0, s) AS z FROM (SELECT *, {_S} AS s FROM p)))"""


def grid_fold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where levels cross, as the ground lies deeper than the taper is long."""
    r = surfaces.value_range(raster(spark, sf_dir)[0]).first()
    return grids.folded_levels(spark, (r.lowest - 25) / 16, (r.highest - 25) / 16, [k * 0.25 for k in range(16)], "linear", length=1.0).select("surface", "level")


QUERIES["grid_fold_check"] = grid_fold_check
_W = lambda a: f"least(greatest(1 - {a}, 0), 1)"
SQL["grid_fold_check"] = f"""WITH e AS (SELECT (min(p_size) - 25) / 16.0::DOUBLE AS low, (max(p_size) - 25) / 16.0::DOUBLE AS high FROM part), s AS (SELECT low + i * ((high - low) / 64) AS surface, k * 0.25::DOUBLE AS level FROM e, generate_series(0, 64) g(i), generate_series(0, 14) h(k))
SELECT surface, level FROM s WHERE level + 0.25 + ({_W('(level + 0.25)')}) * surface - (level + ({_W('level')}) * surface) <= 0"""


def synthetic_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic.raster(spark, 25, 17)
    lon, lat = F.col("lon"), F.col("lat")
    return made.select("ix", "iy", F.round("z", 6).alias("z"), F.round(synthetic.vs30(lon, lat), 6).alias("vs30"), F.round(synthetic.sediment(synthetic.GULLY, lon, lat), 6).alias("gully"), F.round(synthetic.basement(synthetic.TERRACE, lon, lat), 6).alias("basement"))


QUERIES["synthetic_world"] = synthetic_world
SQL["synthetic_world"] = """WITH p AS (SELECT ix, iy, 172.0::DOUBLE + (172.6::DOUBLE - 172.0::DOUBLE) * ix / 24 AS lon, -43.8::DOUBLE + (-43.4::DOUBLE - -43.8::DOUBLE) * iy / 16 AS lat FROM generate_series(0, 24) a(ix), generate_series(0, 16) b(iy)),
e AS (SELECT *, 1000 * (0.75::DOUBLE - (lon - 172) / (172.6::DOUBLE - 172)) + 200 * sin(3 * pi() * (lat + 43.8::DOUBLE) / (43.8::DOUBLE - 43.4::DOUBLE)) AS z,
  ((lon - 172.15::DOUBLE) / 0.08::DOUBLE) ** 2 + ((lat + 43.70::DOUBLE) / 0.06::DOUBLE) ** 2 AS rg, ((lon - 172.30::DOUBLE) / 0.09::DOUBLE) ** 2 + ((lat + 43.53::DOUBLE) / 0.07::DOUBLE) ** 2 AS rt FROM p)
SELECT ix, iy, round(z, 6) AS z, round(200 + 500 * least(greatest(z / 800, 0), 1), 6) AS vs30, round(900 * greatest(1 - rg, 0), 6) AS gully, round(z - 500 * greatest(1 - rt, 0), 6) AS basement FROM e"""
