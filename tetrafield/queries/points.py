"""Point queries: location, composition, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra
from ..operators import locate
from ..schema import ALL, BASINS, COMPONENTS, ELEVATION, INTERPOLATE, TOMOGRAPHY, ModelRange, quality
from ..sinks.formats import scratch
from . import world

QUERIES, SQL = {}, {}


def rounded(struct: str) -> list[Column]:
    return [F.round(F.col(struct)[c], 6).alias(c) for c in COMPONENTS]


def _composite(models: ModelRange):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = locate.composite(world.lineitem_points(spark, sf_dir), world.index(spark), models)
        return made.select(*world.POINT, "x", "y", "z", "depth", *rounded("q"))

    sql = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}, {world.sql_composite('c', lo=models.lo, hi=models.hi)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, z, depth, {world.rounded()} FROM pts JOIN c USING (pid)"""
    return query, sql


for _name, _range in (("query_many", ALL), ("composite_priority", ModelRange(0, 200)), ("composite_basins", BASINS), ("composite_tomography", TOMOGRAPHY)):
    QUERIES[_name], SQL[_name] = _composite(_range)


def _single(model: int):
    """One model alone, as its own query; only the points it holds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        models, vertices, tets = world.tables(spark)
        own = locate.build_index(models.filter(F.col("model_id") == model), vertices.filter(F.col("model_id") == model), tets.filter(F.col("model_id") == model))
        made = locate.composite(world.lineitem_points(spark, sf_dir), own, miss_zero=False).filter("q IS NOT NULL")
        return made.select(*world.POINT, "z", *rounded("q"))

    p = world.MODELS[model].priority
    sql = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}, {world.sql_composite('c', lo=p, hi=p)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, {world.rounded()} FROM pts JOIN c USING (pid) WHERE alpha > 0"""
    return query, sql


QUERIES["interp_query"], SQL["interp_query"] = _single(2)
QUERIES["profile_query"], SQL["profile_query"] = _single(1)


def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = locate.hits(world.lineitem_points(spark, sf_dir), world.index(spark))
    return hits.groupBy(*world.POINT, "z", "model_id").agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("n_tets"))


_L = [f"(m{r}0 * (p.x - x3) + m{r}1 * (p.y - y3) + m{r}2 * (CASE WHEN t.vertical = 'depth' THEN p.depth ELSE p.z END - z3))" for r in range(3)]
QUERIES["locate_points"] = locate_points
SQL["locate_points"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p.z AS z, model_id, min(tid) AS tid, count(*) AS n_tets FROM pts p, tet t
WHERE {' AND '.join(f'{x} >= -1e-4' for x in _L)} AND {' + '.join(_L)} <= 1 + 1e-4 GROUP BY ALL"""


def explain_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = locate.explain(world.lineitem_points(spark, sf_dir), world.index(spark))
    models = F.array_join(F.transform("contributions", lambda x: x["model_id"].cast("string")), ",")
    return made.select(*world.POINT, "z", models.alias("models"), "termination", F.round(F.coalesce(F.col("output")["alpha"], F.lit(0.0)), 6).alias("alpha"))


QUERIES["explain_hits"] = explain_hits
SQL["explain_hits"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}, {world.sql_composite('c')},
r AS (SELECT pid, model_id, priority, 1 - product(1 - alpha) OVER (PARTITION BY pid ORDER BY priority, model_id) AS run,
             row_number() OVER (PARTITION BY pid ORDER BY priority, model_id) AS n, count(*) OVER (PARTITION BY pid) AS k FROM c_q),
e AS (SELECT pid, string_agg(model_id::VARCHAR, ',' ORDER BY priority, model_id) AS models, min(n) FILTER (abs(run - 1) <= 1e-4) AS ended, max(k) AS k FROM r GROUP BY pid)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, coalesce(models, '') AS models,
       (CASE WHEN ended < k THEN ended - 1 END)::INTEGER AS termination, round(alpha, 6) AS alpha
FROM pts JOIN c USING (pid) LEFT JOIN e USING (pid)"""


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = locate.query_stats(world.lineitem_points(spark, sf_dir), world.index(spark))
    return made.select(*world.POINT, "z", "held", "hit_count")


QUERIES["query_stats"] = query_stats
SQL["query_stats"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH},
h AS (SELECT pid, count(*) AS held, count(DISTINCT model_id) AS hit_count FROM pts p, tet t
      WHERE {' AND '.join(f'{x} >= -1e-4' for x in _L)} AND {' + '.join(_L)} <= 1 + 1e-4 GROUP BY pid)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, coalesce(held, 0) AS held, coalesce(hit_count, 0) AS hit_count FROM pts LEFT JOIN h USING (pid)"""


def query_stats_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's statistics together with its composite, from one look at the cells."""
    made = locate.query_stats(world.lineitem_points(spark, sf_dir), world.index(spark), output="q")
    ordered = (F.col("candidates") >= F.col("tested")) & (F.col("tested") >= F.col("held"))
    return made.select(*world.POINT, "z", "held", "hit_count", ordered.alias("ordered"), *rounded("q"))


_HELD = f"{' AND '.join(f'{x} >= -1e-4' for x in _L)} AND {' + '.join(_L)} <= 1 + 1e-4"
QUERIES["query_stats_output"] = query_stats_output
SQL["query_stats_output"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}, {world.sql_composite('c')},
h AS (SELECT pid, count(*) AS held, count(DISTINCT model_id) AS hit_count FROM pts p, tet t WHERE {_HELD} GROUP BY pid)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, coalesce(held, 0) AS held, coalesce(hit_count, 0) AS hit_count, true AS ordered, {world.rounded()}
FROM pts JOIN c USING (pid) LEFT JOIN h USING (pid)"""


def query_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that writes every point's composite counted, a row for each count, and the rows written."""
    rows, totals = locate.measured(world.lineitem_points(spark, sf_dir), world.index(spark))
    path = scratch(spark, "totals")
    found = totals.timed(lambda: rows.select(*world.POINT, "q.*").write.parquet(path))
    told = [(n, found[n]) for n in ("points", "held", "hit_count")]
    written = spark.read.parquet(path).agg(F.lit("rows").alias("what"), F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(told, "what string, n long").unionByName(written.select("what", "n"))


QUERIES["query_totals"] = query_totals
SQL["query_totals"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH},
h AS (SELECT pid, model_id, count(*) AS held FROM pts p, tet t WHERE {_HELD} GROUP BY pid, model_id)
SELECT unnest(['points', 'rows']) AS what, count(*) AS n FROM pts
UNION ALL SELECT 'held', coalesce(sum(held), 0)::BIGINT FROM h UNION ALL SELECT 'hit_count', count(*) FROM h"""


def blend_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples made of each event, one over the other."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v, a, b = F.col("event_id") % 64 * 32 + 512, F.col("event_id") % 5 / 4, F.col("user_id") % 3 / 2
    top = quality(rho=v + 1024, vp=v * 2, vs=v.cast("double"), qp=v / 16, qs=v / 32, alpha=a)
    under = quality(rho=F.lit(2048.0), vp=F.lit(4096.0), vs=F.lit(0.0), qp=F.lit(128.0), qs=F.lit(64.0), alpha=b)
    return e.select("event_id", algebra.over(top, under).alias("q")).select("event_id", *rounded("q"))


QUERIES["blend_over"] = blend_over
SQL["blend_over"] = """WITH s AS (SELECT event_id, (event_id % 64 * 32 + 512)::DOUBLE AS v, event_id % 5 / 4.0::DOUBLE AS a, user_id % 3 / 2.0::DOUBLE AS b FROM events),
w AS (SELECT *, a + b * (1 - a) AS al FROM s),
n AS (SELECT *, a / al AS w0, b * (1 - a) / al AS w1 FROM w)
SELECT event_id,
  round(CASE WHEN a = 0 THEN 2048.0::DOUBLE WHEN b = 0 THEN v + 1024 ELSE w0 * (v + 1024) + w1 * 2048 END, 6) AS rho,
  round(CASE WHEN a = 0 THEN 4096.0::DOUBLE WHEN b = 0 THEN v * 2 ELSE w0 * v * 2 + w1 * 4096 END, 6) AS vp,
  round(CASE WHEN a = 0 THEN 0.0::DOUBLE WHEN b = 0 THEN v ELSE w0 * v END, 6) AS vs,
  round(CASE WHEN a = 0 THEN 128.0::DOUBLE WHEN b = 0 THEN v / 16 ELSE (w0 * v * 2 + w1 * 4096) / (w0 * v * 2 / (v / 16) + w1 * 4096 / 128) END, 6) AS qp,
  round(CASE WHEN a = 0 THEN 64.0::DOUBLE WHEN b = 0 THEN v / 32 ELSE (w0 * v) / (w0 * v / (v / 32)) END, 6) AS qs,
  round(CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE al END, 6) AS alpha
FROM n"""


def model_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two range's composites at the same points: absolute difference, and that of log10 where both are positive."""
    with_hits = locate.gathered(world.lineitem_points(spark, sf_dir), world.index(spark))
    both = locate.refold(locate.refold(with_hits, ALL, "a"), TOMOGRAPHY, "b")
    log = F.when((F.col("a.vs") > 0) & (F.col("b.vs") > 0), F.log10("a.vs") - F.log10("b.vs"))
    return both.select(*world.POINT, "z", F.round(F.col("a.vs") - F.col("b.vs"), 6).alias("d_vs"), F.round(F.col("a.rho") - F.col("b.rho"), 6).alias("d_rho"), F.round(log, 6).alias("log_vs"))


QUERIES["model_diff"] = model_diff
SQL["model_diff"] = f"""WITH {world.SQL_POINTS}, {world.SQL_MESH}, {world.sql_composite('a')}, {world.sql_composite('b', lo=128)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, round(a.vs - b.vs, 6) AS d_vs, round(a.rho - b.rho, 6) AS d_rho,
       round(CASE WHEN a.vs > 0 AND b.vs > 0 THEN log10(a.vs) - log10(b.vs) END, 6) AS log_vs
FROM pts JOIN a USING (pid) JOIN b USING (pid)"""


def query_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem is a point, however often its place occurs; those of some suppliers have no height."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y, z = F.col("l_partkey") % 16 / 2, F.col("l_suppkey") % 16 / 2, F.when(F.col("l_suppkey") % 13 > 0, F.col("l_quantity") / 8)
    points = rows.select("l_orderkey", x.alias("x"), y.alias("y"), z.alias("z"), (z / 2).alias("depth"))
    return locate.composite(points, world.index(spark)).select("l_orderkey", "x", "y", "z", *rounded("q"))


QUERIES["query_repeated"] = query_repeated
SQL["query_repeated"] = f"""WITH own AS (SELECT l_orderkey, l_partkey % 16 / 2.0::DOUBLE AS x, l_suppkey % 16 / 2.0::DOUBLE AS y, CASE WHEN l_suppkey % 13 > 0 THEN l_quantity / 8 END AS z FROM lineitem),
pts AS (SELECT DISTINCT x, y, z, z / 2 AS depth, x || '/' || y || '/' || coalesce(z::VARCHAR, '') AS pid FROM own), {world.SQL_MESH}, {world.sql_composite('c')}
SELECT l_orderkey, own.x AS x, own.y AS y, own.z AS z, {world.rounded()} FROM own JOIN pts ON own.x = pts.x AND own.y = pts.y AND own.z IS NOT DISTINCT FROM pts.z JOIN c USING (pid)"""


# One mesh whose tetrahedra differ a thousandfold: a corner and three edges along the axes for each part.
_GRADED = {"x": "p_partkey * 37 % 1024", "y": "p_partkey * 101 % 1024", "z": "p_partkey * 53 % 256"}
_SIZE = "CAST(power(2, p_partkey % 11) AS DOUBLE)"


def graded_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, vertices, tets) of one model made of parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    place = parts.select(F.col("p_partkey").alias("tid"), F.expr(_SIZE).alias("s"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(f"o{a}") for a, e in _GRADED.items()))
    corners = place.select("tid", "s", "ox", "oy", "oz", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    moved = {a: F.col(f"o{a}") + F.when(F.col("c") == n, F.col("s")).otherwise(0.0) for n, a in enumerate("xyz", 1)}
    vertices = corners.select(F.lit(0).alias("model_id"), (F.col("tid") * 4 + F.col("c")).alias("vid"), *(v.alias(a) for a, v in moved.items()))
    fields = {f: c + dx * F.col("x") + dy * F.col("y") + dz * F.col("z") for f, (c, dx, dy, dz, _) in world.LINEAR.items()}
    vertices = vertices.withColumns({k: c.cast("double") for k, c in fields.items()} | {"alpha": F.lit(1.0)})
    tets = place.select(F.lit(0).alias("model_id"), "tid", *((F.col("tid") * 4 + n).alias(f"v{n}") for n in range(4)))
    return spark.createDataFrame([(0, "graded", 0, ELEVATION, INTERPOLATE)], "model_id int, name string, priority int, vertical string, model_type int"), vertices, tets


def locate_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points among tetrahedra with edges of 1 to 1024 in one mesh: how many hold each, and the lowest one's sample."""
    index = locate.build_index(*graded_tables(spark, sf_dir))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y, z = F.col("o_custkey") * 29 % 2048 / 2 + 0.25, F.col("o_orderkey") * 13 % 2048 / 2 + 0.125, F.col("o_orderkey") * 7 % 1024 / 4 + 0.0625
    points = o.select("o_orderkey", x.alias("x"), y.alias("y"), z.alias("z"), z.alias("depth"))
    made = locate.query_stats(points, index, output="q", counts=("held",))
    return made.select("o_orderkey", "x", "y", "z", F.round("q.rho", 6).alias("rho"), F.round("q.vs", 6).alias("vs"), F.round("q.alpha", 6).alias("alpha"), "held", "hit_count")


_GL = [f"(p.{a} - t.{a}) / s" for a in "xyz"]  # weights of the corners along the axes
_GF = {f: f"{world.LINEAR[f][0]}::DOUBLE + " + " + ".join(f"{world.LINEAR[f][n]}::DOUBLE * p.{a}" for n, a in enumerate("xyz", 1)) for f in ("rho", "vs")}
QUERIES["locate_graded"] = locate_graded
SQL["locate_graded"] = f"""WITH t AS (SELECT p_partkey AS tid, {', '.join(f'({e})::DOUBLE AS {a}' for a, e in _GRADED.items())}, {_SIZE} AS s FROM part),
p AS (SELECT o_orderkey, o_custkey * 29 % 2048 / 2.0::DOUBLE + 0.25 AS x, o_orderkey * 13 % 2048 / 2.0::DOUBLE + 0.125 AS y, o_orderkey * 7 % 1024 / 4.0::DOUBLE + 0.0625 AS z FROM orders),
h AS (SELECT o_orderkey, count(*) AS held FROM p, t WHERE {' AND '.join(f'{w} >= -1e-4' for w in _GL)} AND {' + '.join(_GL)} <= 1 + 1e-4 GROUP BY o_orderkey)
SELECT p.o_orderkey AS o_orderkey, x, y, z, round(CASE WHEN held > 0 THEN {_GF['rho']} ELSE 0 END, 6) AS rho, round(CASE WHEN held > 0 THEN {_GF['vs']} ELSE 0 END, 6) AS vs,
       CASE WHEN held > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha, coalesce(held, 0) AS held, CASE WHEN held > 0 THEN 1 ELSE 0 END::BIGINT AS hit_count
FROM p LEFT JOIN h ON p.o_orderkey = h.o_orderkey"""
