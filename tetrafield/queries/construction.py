"""Building meshes: cells, prisms, volumes, thinning, layers and interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, numeric
from ..operators import meshes
from ..schema import COMPONENTS

QUERIES, SQL = {}, {}


NJ, NK = 5, 4  # nodes of the mesh of parts along y and z; along x it has as many as the parts fill


def part_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, vertices, tets): parts as the nodes of a grid, moved from their places by size and number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    ni = -(-p.count() // (NJ * NK))
    own = p.select((F.col("p_partkey") - p.agg(F.min("p_partkey")).first()[0]).alias("vid"), (F.col("p_size") / 128).alias("dx"), (F.col("p_partkey") % 8 / 32).alias("dy"))
    nodes = spark.range(ni * NJ * NK).select(F.col("id").alias("vid")).join(own.hint("merge"), "vid", "left")  # a part has few bytes on disk, more in a broadcast
    place = {"x": F.floor(F.col("vid") / (NJ * NK)) + F.coalesce("dx", F.lit(0.0)), "y": F.floor(F.col("vid") / NK) % NJ + F.coalesce("dy", F.lit(0.0)), "z": (F.col("vid") % NK).cast("double")}
    vertices = nodes.select(F.lit(0).alias("model_id"), "vid", *(v.alias(k) for k, v in place.items()), *(F.lit(1.0).alias(c) for c in COMPONENTS))
    tets = meshes.five_tets(meshes.grid_cells(spark, ni, NJ, NK), NJ, NK).select(F.lit(0).alias("model_id"), "tid", "v0", "v1", "v2", "v3")
    return spark.createDataFrame([(0, "parts", 7, "elevation", 1)], "model_id int, name string, priority int, vertical string, model_type int"), vertices, tets


_PATTERN = ", ".join(f"({parity}, {slot}, {', '.join(d for corner in row for d in corner)})" for parity, rows in ((0, meshes.EVEN), (1, meshes.ODD)) for slot, row in enumerate(rows))
_EDGE = [[f"(c{n}.{a} - c3.{a})" for a in "xyz"] for n in range(3)]
_DET = " + ".join(f"{_EDGE[0][a]} * ({_EDGE[1][b]} * {_EDGE[2][c]} - {_EDGE[1][c]} * {_EDGE[2][b]})" for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
SQL_PARTS = f"""pk AS (SELECT p_partkey - min(p_partkey) OVER () AS key, p_size, p_partkey FROM part),
nd AS (SELECT n AS vid, n // {NJ * NK} + coalesce(p_size, 0) / 128.0::DOUBLE AS x, n // {NK} % {NJ} + coalesce(p_partkey % 8, 0) / 32.0::DOUBLE AS y, (n % {NK})::DOUBLE AS z
  FROM (SELECT unnest(generate_series(0, (SELECT (count(*) + {NJ * NK - 1}) // {NJ * NK} * {NJ * NK} - 1 FROM part))) AS n) r LEFT JOIN pk ON key = n),
pat(parity, slot, {', '.join(f'd{a}{n}' for n in range(4) for a in 'ijk')}) AS (VALUES {_PATTERN}),
cl AS (SELECT i, j, k FROM (SELECT unnest(generate_series(0, (SELECT max(vid) // {NJ * NK} - 1 FROM nd))) AS i) a, generate_series(0, {NJ - 2}) b(j), generate_series(0, {NK - 2}) d(k)),
tt AS (SELECT ((i * {NJ - 1} + j) * {NK - 1} + k) * 5 + slot AS tid, {', '.join(f'(i + di{n}) * {NJ * NK} + (j + dj{n}) * {NK} + (k + dk{n}) AS v{n}' for n in range(4))} FROM cl JOIN pat ON parity = (i + j + k) % 2),
tv AS (SELECT tt.*, abs({_DET}) / 6 AS volume FROM tt {' '.join(f'JOIN nd c{n} ON c{n}.vid = v{n}' for n in range(4))})"""


def tet5_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_mesh(spark, sf_dir)[2]


QUERIES["tet5_mesh"] = tet5_mesh
SQL["tet5_mesh"] = f"WITH {SQL_PARTS} SELECT 0 AS model_id, tid, v0, v1, v2, v3 FROM tt"


def tet_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vertices, tets = part_mesh(spark, sf_dir)
    return meshes.gather(tets, vertices, ("x", "y", "z")).select("model_id", "tid", F.round(meshes.volume(), 9).alias("volume"))


QUERIES["tet_volume"] = tet_volume
SQL["tet_volume"] = f"WITH {SQL_PARTS} SELECT 0 AS model_id, tid, round(volume, 9) AS volume FROM tv"


def mesh_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's bounds and least volume."""
    models, vertices, tets = part_mesh(spark, sf_dir)
    meshes.validate(models, tets)
    made = meshes.report(vertices, tets).join(meshes.bounds(vertices), "model_id").join(models.select("model_id", "name", "priority"), "model_id")
    return made.select("model_id", "name", "priority", "n_tets", F.round("min_volume", 9).alias("min_volume"), "ok", *(f"{m}{a}" for m in ("min", "max") for a in "xyz"))


QUERIES["mesh_catalog"] = mesh_catalog
SQL["mesh_catalog"] = f"""WITH {SQL_PARTS}, b AS (SELECT {', '.join(f'{m}({a}) AS {m}{a}' for m in ('min', 'max') for a in 'xyz')} FROM nd)
SELECT 0 AS model_id, 'parts' AS name, 7 AS priority, count(*) AS n_tets, round(min(volume), 9) AS min_volume, min(volume) >= 1e-6 AS ok, {', '.join(f'{m}{a}' for m in ('min', 'max') for a in 'xyz')} FROM tv, b GROUP BY ALL"""


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("tri"), F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % 1000 + 100_000).alias("b"), ((F.col("p_partkey") * 13 + 5) % 1000 + 50_000_000).alias("c"))


def prism_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.prisms(_triangles(spark, sf_dir))


QUERIES["prism_mesh"] = prism_mesh
SQL["prism_mesh"] = """WITH t AS (SELECT p_partkey AS tri, list_sort([p_partkey, (p_partkey * 7 + 3) % 1000 + 100000, (p_partkey * 13 + 5) % 1000 + 50000000]) AS s FROM part),
u AS (SELECT tri, 2 * s[1] AS i, 2 * s[2] AS j, 2 * s[3] AS k FROM t)
SELECT tri, 0 AS slot, i AS v0, i + 1 AS v1, j + 1 AS v2, k + 1 AS v3 FROM u UNION ALL
SELECT tri, 1, i, j, j + 1, k FROM u UNION ALL SELECT tri, 2, i, j + 1, k, k + 1 FROM u"""


def cull_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger tetrahedra of the mesh of parts stay, with vertices numbered anew."""
    _, vertices, tets = part_mesh(spark, sf_dir)
    return meshes.cull(vertices, tets, 0.2)[1]


QUERIES["cull_mesh"] = cull_mesh
SQL["cull_mesh"] = f"""WITH {SQL_PARTS}, kept AS (SELECT * FROM tv WHERE volume > 0.2),
used AS (SELECT DISTINCT unnest([v0, v1, v2, v3]) AS vid FROM kept),
num AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM used)
SELECT 0 AS model_id, tid, {', '.join(f'n{n}.new AS v{n}' for n in range(4))} FROM kept
{' '.join(f'JOIN num n{n} ON n{n}.vid = kept.v{n}' for n in range(4))}"""


def layer_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' layers by nation: bottoms are running counts, tops the bottom before."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 1.0).alias("bottom"))
    return meshes.layer_tops(s, ("s_nationkey",))


QUERIES["layer_tops"] = layer_tops
SQL["layer_tops"] = """SELECT s_nationkey, s_suppkey, s_suppkey::DOUBLE AS bottom, coalesce(lag(s_suppkey::DOUBLE) OVER w, 0) AS top,
       s_suppkey::DOUBLE - coalesce(lag(s_suppkey::DOUBLE) OVER w, 0) AS thickness FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    top = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 8.0)
    bottom = F.when((F.col("p_partkey") % 7 == 0) | (F.col("p_partkey") % 5 != 0), F.col("p_partkey") % 64 * 8.0)
    return p.select(F.col("p_partkey").alias("vid"), top.alias("top"), bottom.alias("bottom"))


_COLUMNS = """cols AS (SELECT p_partkey AS vid, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 8.0::DOUBLE END AS top,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 <> 0 THEN p_partkey % 64 * 8.0::DOUBLE END AS bottom FROM part),
fixed AS (SELECT vid, least(coalesce(top, bottom), coalesce(bottom, top)) AS top, coalesce(bottom, top) AS bottom FROM cols)"""


def interface_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.repair_interfaces(_columns(spark, sf_dir))


QUERIES["interface_repair"] = interface_repair
SQL["interface_repair"] = f"WITH {_COLUMNS} SELECT vid, top, bottom FROM fixed"


def layer_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spark.createDataFrame([(n, 64.0 * n, 64.0) for n in range(6)], "layer int, z double, thickness double")
    return meshes.slice_layers(meshes.repair_interfaces(_columns(spark, sf_dir), strict=False), layers)


QUERIES["layer_slices"] = layer_slices
SQL["layer_slices"] = f"""WITH {_COLUMNS}, r AS (SELECT vid, top, n AS layer, greatest(least(64.0::DOUBLE * (n + 1), bottom), top) AS reach FROM fixed, generate_series(0, 5) g(n)),
e AS (SELECT vid, top, layer, max(reach) OVER (PARTITION BY vid ORDER BY layer) AS slice_bottom FROM r)
SELECT vid, layer::INTEGER AS layer, coalesce(lag(slice_bottom) OVER (PARTITION BY vid ORDER BY layer), top) AS slice_top, slice_bottom FROM e"""


def tomography_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points, joined with a table of Q at the same places."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    points = o.select((F.col("o_orderkey") % 100).alias("x"), F.floor(F.col("o_orderkey") / 100).alias("y"), F.lit(0).alias("z"), F.col("o_totalprice").alias("vp"))
    q = points.select("x", "y", "z", (F.col("x") * 2 + 1).alias("qp"), (F.col("x") + 1).alias("qs"))
    return meshes.join_q(points, q)


QUERIES["tomography_join_q"] = tomography_join_q
SQL["tomography_join_q"] = "SELECT o_orderkey % 100 AS x, o_orderkey // 100 AS y, 0 AS z, o_totalprice AS vp, o_orderkey % 100 * 2 + 1 AS qp, o_orderkey % 100 + 1 AS qs FROM orders"


def tomography_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a mesh made from a table of grid points in km and km/s."""
    i = F.col("id")
    points = spark.range(8 * 6 * 5).select((F.floor(i / 30) / 2).alias("x"), (F.floor(i / 5) % 6 / 4).alias("y"), (i % 5 * 1.0).alias("z"))
    points = points.withColumns({"vp": 2 + F.col("x") / 2 + F.col("z") / 4, "vs": 1 + F.col("x") / 8 + F.col("y") / 4, "rho": 2.5 + F.col("z") / 64})
    return meshes.tomography_mesh(spark, points)[0].select("vid", "x", "y", "z", "rho", "vp", "vs", F.round("qp", 6).alias("qp"), F.round("qs", 6).alias("qs"))


QUERIES["tomography_mesh"] = tomography_mesh
SQL["tomography_mesh"] = """WITH p AS (SELECT i // 30 / 2.0::DOUBLE AS x, i // 5 % 6 / 4.0::DOUBLE AS y, (i % 5)::DOUBLE AS z, i AS vid FROM generate_series(0, 239) g(i))
SELECT vid, x, y, z, (2.5::DOUBLE + z / 64) * 1000 AS rho, (2 + x / 2 + z / 4) * 1000 AS vp, (1 + x / 8 + y / 4) * 1000 AS vs,
       round((1 + x / 8 + y / 4) * 100, 6) AS qp, round((1 + x / 8 + y / 4) * 50, 6) AS qs FROM p"""


def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", numeric.morton(F.col("p_partkey") % 1024, F.col("p_size").cast("long"), F.floor(F.col("p_partkey") / 7)).alias("code"))


_BITS = lambda e, shift: [f"((({e})::BIGINT >> {b}) & 1) * {2 ** (3 * b + shift)}::BIGINT" for b in range(20)]
QUERIES["morton_order"] = morton_order
SQL["morton_order"] = f"SELECT p_partkey, ({' + '.join([*_BITS('p_partkey % 1024', 0), *_BITS('p_size', 1), *_BITS('p_partkey // 7', 2)])})::BIGINT AS code FROM part"


def crs_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a lattice of degrees, projected."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lon, lat = 166.0 + F.col("s_suppkey") % 32 / 2, -47.0 + F.floor(F.col("s_suppkey") / 32) % 24 / 2
    e, n = crs.TransverseMercator().forward(lon, lat)
    return s.select("s_suppkey", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def _tm_sql(t: crs.TransverseMercator, places: str, lon0: str, north: str) -> str:
    """CTE `tm`: the columns of `places` (lon, lat, ...) with e and n."""
    import math

    n, radius, alpha, _ = t._series()
    e = 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))])
    up = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))])
    k = t.k0 * radius
    return f"""tm1 AS (SELECT *, radians(lon - ({lon0})) AS dl, radians(lat) AS phi FROM {places}),
tm2 AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM tm1),
tm3 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM tm2),
tm AS (SELECT *, {t.easting0} + {k!r}::DOUBLE * ({east}) AS e, {north} + {k!r}::DOUBLE * ({up}) AS n FROM tm3)"""


QUERIES["crs_forward"] = crs_forward
SQL["crs_forward"] = f"""WITH p AS (SELECT s_suppkey, 166.0::DOUBLE + s_suppkey % 32 / 2.0::DOUBLE AS lon, -47.0::DOUBLE + s_suppkey // 32 % 24 / 2.0::DOUBLE AS lat FROM supplier),
{_tm_sql(crs.NZTM, "p", f"{crs.NZTM.lon0}", f"{crs.NZTM.northing0}")}
SELECT s_suppkey, round(e, 3) AS easting, round(n, 3) AS northing FROM tm"""


def crs_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all over the world, each projected in the zone of its place, and taken back to degrees by the zone's number."""
    key = F.col("c_custkey")
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (key * 37 % 1440 / 4 - 179.9375).alias("lon"), (key * 11 % 320 / 2 - 79.875).alias("lat"))
    code, east, north = crs.utm(F.col("lon"), F.col("lat"))
    made = own.withColumns({"code": code, "easting": east, "northing": north})
    lon, lat = crs.from_utm(F.col("code"), F.col("easting"), F.col("northing"))
    return made.select("c_custkey", "code", *(F.round(c, 3).alias(c) for c in ("easting", "northing")), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


QUERIES["crs_zones"] = crs_zones
SQL["crs_zones"] = f"""WITH p AS (SELECT c_custkey, c_custkey * 37 % 1440 / 4.0::DOUBLE - 179.9375::DOUBLE AS lon, c_custkey * 11 % 320 / 2.0::DOUBLE - 79.875::DOUBLE AS lat FROM customer),
z AS (SELECT *, floor((lon + 180) / 6)::BIGINT + 1 AS zone FROM p), {_tm_sql(crs.WGS84, "z", "6 * zone - 183", "CASE WHEN lat < 0 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END")}
SELECT c_custkey, zone + CASE WHEN lat < 0 THEN 32700 ELSE 32600 END AS code, round(e, 3) AS easting, round(n, 3) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat FROM tm"""
