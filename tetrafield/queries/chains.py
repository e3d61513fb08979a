"""Layers and chains of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import grids, layers
from ..schema import ALL, BASINS, COMPONENTS, TOMOGRAPHY
from . import rasters, world

QUERIES, SQL = {}, {}
KEYS = ["grid", "i", "j", "k"]
DEPTH_T = 2.0


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of nine nodes for each part, hung from the hill, with its place made of the part's numbers."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y = F.col("p_partkey") * 37 % 448 / 64 + 0.5, F.col("p_partkey") * 101 % 448 / 64 + 0.5
    own = part.select(F.col("p_partkey").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), x.alias("x"), y.alias("y"))
    return grids.hang(own, rasters.surface, 3.0, 0.375, "grid")


SQL_NODES = """pts AS (SELECT *, s + depth AS z, i || '-' || k AS pid FROM (
  SELECT *, (x * x - y) / 16 AS s, k * 0.375::DOUBLE AS depth FROM (
    SELECT p_partkey AS i, 0::BIGINT AS j, p_partkey * 37 % 448 / 64.0::DOUBLE + 0.5 AS x, p_partkey * 101 % 448 / 64.0::DOUBLE + 0.5 AS y FROM part), generate_series(0, 8) g(k)))"""


def lattice(spark: SparkSession) -> DataFrame:
    """A grid over the models, of columns that hang from the hill."""
    return grids.regular(spark, rasters.surface, 7.0, 7.0, 3.0, 0.5, 0.5, 0.375, grids.Frame(4.0, 4.0))


SQL_LATTICE = f"""pts AS (SELECT *, s + depth AS z, i || '-' || j || '-' || k AS pid FROM (
  SELECT *, (x * x - y) / 16 AS s, k * 0.375::DOUBLE AS depth FROM (
    SELECT i, j, (i - 7.5::DOUBLE) * 0.5 + 4 AS x, (j - 7.5::DOUBLE) * 0.5 + 4 AS y FROM generate_series(0, 14) a(i), generate_series(0, 14) b(j)), generate_series(0, 8) g(k)))"""
OUT = f"SELECT 'grid' AS grid, i, j, k, {world.rounded()} "


def _out(points: DataFrame) -> DataFrame:
    return points.select(*KEYS, *(F.round(c, 6).alias(c) for c in COMPONENTS))


def _over(top: str, under: str, name: str, source: str) -> str:
    """CTE of source's rows with the columns of `top` over those of `under` (prefixes), named plainly."""
    t, u = f"{top}alpha", f"{under}alpha"
    a, b = f"({t} / al)", f"({u} * (1 - {t}) / al)"
    mean = lambda c: f"{a} * {top}{c} + {b} * {under}{c}"
    q = lambda c, v: f"CASE WHEN {mean(v)} > 0 THEN ({mean(v)}) / ({a} * {top}{v} / {top}{c} + {b} * {under}{v} / {under}{c}) ELSE 1 / ({a} / {top}{c} + {b} / {under}{c}) END"
    value = {"rho": mean("rho"), "vp": mean("vp"), "vs": mean("vs"), "qp": q("qp", "vp"), "qs": q("qs", "vs"), "alpha": "al"}
    fields = ", ".join(f"CASE WHEN {t} < 1e-7 THEN {under}{c} WHEN {u} < 1e-7 THEN {top}{c} ELSE {value[c]} END AS {name}{c}" for c in COMPONENTS)
    return f"(SELECT *, {fields} FROM (SELECT * EXCLUDE al, {t} + {u} * (1 - {t}) AS al FROM (SELECT *, 0 AS al FROM {source})))"


def _renamed(table: str, prefix: str) -> str:
    return f"(SELECT pid, {', '.join(f'{c} AS {prefix}{c}' for c in COMPONENTS)} FROM {table})"


def sampled(points: DataFrame, index) -> DataFrame:
    return _out(layers.evaluate(layers.Query(index), points))


SQL_SAMPLED = f"WITH {SQL_LATTICE}, {world.SQL_MESH}, {world.sql_composite('c')} {OUT} FROM pts JOIN c USING (pid)"


def layer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(layers.evaluate(layers.Query(world.index(spark)), nodes(spark, sf_dir)))


QUERIES["layer_query"] = layer_query
SQL["layer_query"] = f"WITH {SQL_NODES}, {world.SQL_MESH}, {world.sql_composite('c')} {OUT} FROM pts JOIN c USING (pid)"


def layer_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional layer over a constant one: doubles vs below a depth of 1."""

    @layers.functional
    def stiffen(points: DataFrame, models, factor: float) -> DataFrame:
        q = F.col("q")
        vs = F.when(F.col("depth") > 1, q["vs"] * factor).otherwise(q["vs"])
        return points.withColumn("q", F.struct(*((vs if c == "vs" else q[c]).alias(c) for c in COMPONENTS)))

    chain = stiffen(layers.Constant(rho=2000.0, vp=3000.0, vs=1000.0, qp=100.0, qs=50.0, alpha=1.0), factor=2.0)
    return _out(layers.evaluate(chain, nodes(spark, sf_dir)))


QUERIES["layer_constant"] = layer_constant
SQL["layer_constant"] = f"""WITH {SQL_NODES} SELECT 'grid' AS grid, i, j, k, 2000.0::DOUBLE AS rho, 3000.0::DOUBLE AS vp, CASE WHEN depth > 1 THEN 2000.0::DOUBLE ELSE 1000.0::DOUBLE END AS vs,
100.0::DOUBLE AS qp, 50.0::DOUBLE AS qs, 1.0::DOUBLE AS alpha FROM pts"""


def _poly(c: tuple[float, ...], x: str) -> str:
    out = f"{c[0]!r}::DOUBLE"
    for k in c[1:]:
        out = f"({out}) * ({x}) + {k!r}::DOUBLE"
    return out


def _clamp(bounds: dict, low: float | None = None, high: float | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(layers.evaluate(layers.Clamp(layers.Query(world.index(spark)), bounds, low, high), nodes(spark, sf_dir)))

    return query


QUERIES["layer_clamp"] = _clamp({"vs": layers.Bound(min=1200.0, max=1700.0), "qs": layers.Bound(min=0.05, min_ref="vs", max=0.055, max_ref="vs"), "qp": layers.Bound(min=2.0, min_ref="qs")})
_BASE = f"WITH {SQL_NODES}, {world.SQL_MESH}, {world.sql_composite('c')}, b AS (SELECT * FROM pts JOIN c USING (pid)), "
_MOVED = f"""m2 AS (SELECT * REPLACE (CASE WHEN nv <> vs THEN {_poly(numeric.VP_OF_VS, 'nv')} ELSE vp END AS vp), CASE WHEN nv <> vs THEN 1 ELSE 0 END AS moved FROM m1),
m3 AS (SELECT * REPLACE (CASE WHEN moved = 1 THEN {_poly(numeric.RHO_OF_VP, 'vp')} ELSE rho END AS rho, nv AS vs) FROM m2)"""
SQL["layer_clamp"] = f"""{_BASE} m1 AS (SELECT *, least(greatest(vs, 1200), 1700) AS nv FROM b), {_MOVED},
m4 AS (SELECT * REPLACE (least(greatest(qs, 0.05::DOUBLE * vs), 0.055::DOUBLE * vs) AS qs) FROM m3), m5 AS (SELECT * REPLACE (greatest(qp, 2 * qs) AS qp) FROM m4) {OUT} FROM m5"""

QUERIES["layer_clamp_floors"] = _clamp({"vs": layers.Bound(min=600.0, floors=(("depth", 0.5, 1400.0), ("depth", 1.5, 1300.0), ("elevation", 3.0, 2100.0)))})
SQL["layer_clamp_floors"] = f"""{_BASE} m1 AS (SELECT *, greatest(vs, CASE WHEN depth >= 0.5 THEN 1400.0::DOUBLE ELSE 600.0::DOUBLE END, CASE WHEN z >= 3 THEN 2100.0::DOUBLE ELSE 0 END) AS nv FROM b), {_MOVED} {OUT} FROM m3"""

QUERIES["layer_ratio"] = _clamp({}, 1.9, 2.1)
SQL["layer_ratio"] = f"""{_BASE} m1 AS (SELECT *, least(greatest(vp, 1.9::DOUBLE * vs), 2.1::DOUBLE * vs) AS nv FROM b),
m2 AS (SELECT * REPLACE (CASE WHEN nv <> vp THEN {_poly(numeric.RHO_OF_VP, 'nv')} ELSE rho END AS rho, nv AS vp) FROM m1) {OUT} FROM m2"""


def vs30(rows: DataFrame, name: str) -> DataFrame:
    """A site velocity by place; the north-west has none."""
    x, y = F.col("x"), F.col("y")
    return rows.withColumn(name, F.when((x > 2) | (y < 6), 256.0 + 32 * x + 16 * y))


def ely(spark: SparkSession) -> layers.Layer:
    return layers.Coastline(layers.Ely(layers.Query(world.index(spark)), vs30, DEPTH_T), rasters.lines(spark))


def layer_ely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(layers.evaluate(ely(spark), nodes(spark, sf_dir)))


_V = f"(least(depth, {DEPTH_T}) / {DEPTH_T})"
_F, _G = f"({_V} + ({_V} - {_V} * {_V}) * (2 / 3.0::DOUBLE))", f"(0.5 - 5 * {_V} + 1.5 * {_V} * {_V} + 3 * sqrt({_V}))"
SQL_ELY = f"""{SQL_NODES}, {world.SQL_MESH}, {rasters.sql_coast('pts')},
tops AS (SELECT i, j, x, y, s + {DEPTH_T} AS z, {DEPTH_T}::DOUBLE AS depth, pid FROM pts WHERE k = 0),
{world.sql_composite('ba', hi=127)}, {world.sql_composite('tm', lo=128)}, {world.sql_composite('tt', 'tops', lo=128)},
ed AS (SELECT p.*, CASE WHEN c.odd = 1 THEN -c.d ELSE c.d END AS coast, CASE WHEN p.x > 2 OR p.y < 6 THEN 256.0::DOUBLE + 32 * p.x + 16 * p.y END AS vs30, tt.vp AS vpt, tt.vs AS vst
  FROM pts p JOIN coast c ON p.x = c.x AND p.y = c.y JOIN tops t ON p.i = t.i AND p.j = t.j JOIN tt ON tt.pid = t.pid),
ee AS (SELECT *, {_F} * vst + {_G} * vs30 AS evs, {_F} * vpt + {_G} * ({_poly(numeric.VP_OF_VS, 'vs30')}) AS evp FROM ed),
eg AS (SELECT ee.*, t.*EXCLUDE pid, b.* EXCLUDE pid FROM ee JOIN {_renamed('tm', 't_')} t USING (pid) JOIN {_renamed('ba', 'b_')} b USING (pid)),
eh AS (SELECT *, depth < {DEPTH_T} AND coast <= 1e-6 AND vs30 IS NOT NULL AS tapered FROM eg),
ei AS (SELECT *, CASE WHEN tapered THEN {_poly(numeric.RHO_OF_VP, 'evp')} ELSE t_rho END AS g_rho, CASE WHEN tapered THEN evp ELSE t_vp END AS g_vp, CASE WHEN tapered THEN evs ELSE t_vs END AS g_vs,
  CASE WHEN tapered THEN 0.1::DOUBLE * evs ELSE t_qp END AS g_qp, CASE WHEN tapered THEN 0.05::DOUBLE * evs ELSE t_qs END AS g_qs, CASE WHEN tapered THEN 1.0::DOUBLE ELSE t_alpha END AS g_alpha FROM eh),
el AS {_over('b_', 'g_', '', 'ei')}"""
QUERIES["layer_ely"] = layer_ely
SQL["layer_ely"] = f"WITH {SQL_ELY} {OUT} FROM el"

BODY = [layers.OffshoreLayer(0.5, 1750.0, 1600.0, 400.0, 60.0, 30.0), layers.OffshoreLayer(1.0, 1900.0, 1800.0, 600.0, 80.0, 40.0, 0.5), layers.OffshoreLayer(4.0, 2100.0, 2200.0, 900.0, 100.0, 50.0)]
KNOTS = [(0.0, 0.25), (1.0, 1.0), (2.0, 2.0)]


def layer_offshore(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = layers.Coastline(layers.Offshore(layers.Query(world.index(spark)), KNOTS, BODY), rasters.lines(spark))
    return _out(layers.evaluate(chain, nodes(spark, sf_dir)))


_STEP = lambda f: f"CASE WHEN depth >= 1.0 THEN {getattr(BODY[2], f)}::DOUBLE WHEN depth >= 0.5 THEN {getattr(BODY[1], f)}::DOUBLE ELSE {getattr(BODY[0], f)}::DOUBLE END"
QUERIES["layer_offshore"] = layer_offshore
SQL["layer_offshore"] = f"""WITH {SQL_NODES}, {world.SQL_MESH}, {rasters.sql_coast('pts')},
tops AS (SELECT i, j, x, y, s AS z, 0.0::DOUBLE AS depth, pid FROM pts WHERE k = 0),
{world.sql_composite('c')}, {world.sql_composite('ba', hi=127)}, {world.sql_composite('tp', 'tops', hi=127)},
od AS (SELECT p.*, CASE WHEN c.odd = 1 THEN -c.d ELSE c.d END AS coast, tp.alpha AS foot
  FROM pts p JOIN coast c ON p.x = c.x AND p.y = c.y JOIN tops t ON p.i = t.i AND p.j = t.j JOIN tp ON tp.pid = t.pid),
oj AS (SELECT od.*, u.* EXCLUDE pid, b.* EXCLUDE pid FROM od JOIN {_renamed('c', 'u_')} u USING (pid) JOIN {_renamed('ba', 'b_')} b USING (pid)),
ok AS (SELECT *, {', '.join(f"{_STEP(f)} AS o_{f}" for f in COMPONENTS[:-1])}, ({_STEP('alpha')}) * (1 - least(greatest(foot - b_alpha, 0), 1)) AS o_alpha,
  depth < 2 AND coast > 0 AND abs(foot - 1) > 1.001e-5 AND depth < CASE WHEN coast <= 0 THEN 0.25 WHEN coast <= 1 THEN 0.25 + coast * 0.75 WHEN coast <= 2 THEN 1 + (coast - 1) ELSE 2 END AS body FROM oj),
ol AS {_over('o_', 'u_', 'v_', 'ok')}, om AS {_over('b_', 'v_', 'w_', 'ol')},
oz AS (SELECT i, j, k, {', '.join(f'CASE WHEN body THEN w_{c} ELSE u_{c} END AS {c}' for c in COMPONENTS)} FROM om) {OUT} FROM oz"""


def layer_backus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(layers.evaluate(layers.Backus(layers.Query(world.index(spark)), 3), nodes(spark, sf_dir)))


QUERIES["layer_backus"] = layer_backus
SQL["layer_backus"] = f"""WITH {SQL_NODES.replace('pts AS', 'own AS')}, {world.SQL_MESH},
sp AS (SELECT *, CASE WHEN k = 0 THEN z ELSE z - 0.1875 END AS up, z + 0.1875 AS down FROM own),
pts AS (SELECT o.i, o.j, o.k, o.x, o.y, up + (m + 0.5) / 3 * (down - up) AS z, up + (m + 0.5) / 3 * (down - up) - s AS depth, o.pid || '/' || m AS pid FROM sp o, generate_series(0, 2) g(m)),
{world.sql_composite('c')},
a AS (SELECT i, j, k, sum(alpha) AS w, sum(alpha * rho) AS r, sum(CASE WHEN alpha > 0 THEN alpha / (rho * vp * vp) ELSE 0 END) AS m, sum(CASE WHEN alpha > 0 THEN alpha / (rho * vs * vs) ELSE 0 END) AS mu,
  sum(CASE WHEN alpha > 0 THEN alpha / (rho * vp * vp * qp) ELSE 0 END) AS mq, sum(CASE WHEN alpha > 0 THEN alpha / (rho * vs * vs * qs) ELSE 0 END) AS muq FROM pts JOIN c USING (pid) GROUP BY i, j, k),
z AS (SELECT i, j, k, CASE WHEN w > 0 THEN r / w ELSE 0 END AS rho, CASE WHEN w > 0 THEN w / sqrt(m * r) ELSE 0 END AS vp, CASE WHEN w > 0 THEN w / sqrt(mu * r) ELSE 0 END AS vs,
  CASE WHEN w > 0 THEN m / mq ELSE 0 END AS qp, CASE WHEN w > 0 THEN mu / muq ELSE 0 END AS qs, w / 3 AS alpha FROM a) {OUT} FROM z"""


def layer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coastline over clamp over ely over query, put together from configuration order."""
    chain = layers.Chain([
        lambda below: layers.Coastline(below, rasters.lines(spark)), lambda below: layers.Clamp(below, {"vs": layers.Bound(min=700.0)}),
        lambda below: layers.Ely(below, vs30, DEPTH_T), lambda below: layers.Query(world.index(spark)),
    ])
    return _out(layers.evaluate(chain.build(), nodes(spark, sf_dir)))


QUERIES["layer_chain"] = layer_chain
SQL["layer_chain"] = f"WITH {SQL_ELY}, m1 AS (SELECT i, j, k, rho, vp, vs, qp, qs, alpha, greatest(vs, 700) AS nv FROM el), {_MOVED} {OUT} FROM m3"


def layer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of hits answers three ranges."""
    made = layers.Query(world.index(spark))(nodes(spark, sf_dir), [ALL, BASINS, TOMOGRAPHY])
    return made.select(*KEYS, *(F.round(F.col(layers.q_of(r))["vs"], 6).alias(n) for n, r in (("vs_all", ALL), ("vs_basins", BASINS), ("vs_tomography", TOMOGRAPHY))))


QUERIES["layer_ranges"] = layer_ranges
SQL["layer_ranges"] = f"""WITH {SQL_NODES}, {world.SQL_MESH}, {world.sql_composite('a')}, {world.sql_composite('b', hi=127)}, {world.sql_composite('t', lo=128)}
SELECT 'grid' AS grid, i, j, k, round(a.vs, 6) AS vs_all, round(b.vs, 6) AS vs_basins, round(t.vs, 6) AS vs_tomography FROM pts JOIN a USING (pid) JOIN b USING (pid) JOIN t USING (pid)"""
