"""The models and points that the queries use, as tables and as SQL.

All constants are dyadic, so weights and linear fields come out exactly in either engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import locate, meshes
from ..schema import COMPONENTS, DEPTH, DEPTH_PROFILE, ELEVATION, FIELDS, INTERPOLATE


@dataclass(frozen=True)
class Model:
    name: str
    priority: int
    vertical: str
    model_type: int
    origin: tuple[float, float, float]
    step: float
    shape: tuple[int, int, int]
    alpha: float


MODELS = [
    Model("shelf", 10, DEPTH, INTERPOLATE, (2.0, 2.0, 0.0), 1.0, (5, 5, 3), 0.5),
    Model("basin", 40, DEPTH, DEPTH_PROFILE, (3.0, 3.0, 0.0), 1.0, (4, 4, 3), 0.75),
    Model("tomography", 255, ELEVATION, INTERPOLATE, (0.0, 0.0, -2.0), 2.0, (5, 5, 5), 1.0),
]
# Linear fields: constant, x, y, z, and what each model adds.
LINEAR = {"rho": (1800.0, 64.0, 32.0, 16.0, 128.0), "vp": (3072.0, 128.0, -64.0, 256.0, 512.0), "vs": (1536.0, 64.0, 16.0, 32.0, 256.0), "qp": (128.0, 8.0, 4.0, 2.0, 16.0), "qs": (64.0, 4.0, 2.0, 1.0, 8.0)}
# The basin's profile: top and fields.
PROFILE = [(0.0, 1792.0, 1536.0, 384.0, 64.0, 32.0), (0.5, 2048.0, 2048.0, 768.0, 96.0, 48.0), (1.25, 2304.0, 2560.0, 1152.0, 128.0, 64.0)]
POINT = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, vertices, tets)."""
    vertices = tets = None
    for n, m in enumerate(MODELS):
        fields = {f: c + dx * F.col("x") + dy * F.col("y") + dz * F.col("z") + own * n for f, (c, dx, dy, dz, own) in LINEAR.items()}
        v, t = meshes.grid_mesh(spark, n, m.origin, (m.step,) * 3, m.shape, alpha=m.alpha)
        v = v.withColumns({k: c.cast("double") for k, c in fields.items()})
        vertices, tets = (v, t) if vertices is None else (vertices.unionByName(v), tets.unionByName(t))
    rows = [(n, m.name, m.priority, m.vertical, m.model_type, [dict(zip(("top", *FIELDS), p)) for p in PROFILE] if m.model_type == DEPTH_PROFILE else None) for n, m in enumerate(MODELS)]
    schema = "model_id int, name string, priority int, vertical string, model_type int, profile array<struct<top:double,rho:double,vp:double,vs:double,qp:double,qs:double>>"
    return spark.createDataFrame(rows, schema), vertices, tets


_INDEX: dict[str, locate.Index] = {}


def index(spark: SparkSession) -> locate.Index:
    """Built once for each application, as a server of queries would."""
    key = spark.sparkContext.applicationId
    if key not in _INDEX:
        _INDEX[key] = locate.build_index(*tables(spark))
    return _INDEX[key]


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct points made of lineitem's keys and quantity."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = F.col("l_partkey") % 512 / 64, (F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 512 / 64
    return rows.select(*POINT, x.alias("x"), y.alias("y"), (F.col("l_quantity") / 8).alias("z"), (F.col("l_quantity") / 16).alias("depth")).distinct()


SQL_POINTS = """pts AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 512) / 64.0::DOUBLE AS x,
         ((l_suppkey * 37 + l_orderkey) % 512) / 64.0::DOUBLE AS y, l_quantity / 8 AS z, l_quantity / 16 AS depth,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity AS pid
  FROM lineitem)"""


def _mesh_sql() -> str:
    models = ", ".join(f"({n}, {m.priority}, '{m.vertical}', {m.model_type}, {', '.join(f'{o}::DOUBLE' for o in m.origin)}, {m.step}::DOUBLE, {', '.join(map(str, m.shape))}, {m.alpha}::DOUBLE)" for n, m in enumerate(MODELS))
    pattern = ", ".join(f"({parity}, {slot}, {', '.join(d for corner in row for d in corner)})" for parity, rows in ((0, meshes.EVEN), (1, meshes.ODD)) for slot, row in enumerate(rows))
    corners = ", ".join(f"{a}{n}" for n in range(4) for a in ("di", "dj", "dk"))
    places = ", ".join(f"o{a} + s * (c.{i} + p.d{i}{n}) AS {a}{n}" for n in range(4) for a, i in zip("xyz", "ijk"))
    fields = ", ".join(f"{c}::DOUBLE + {dx}::DOUBLE * x{n} + {dy}::DOUBLE * y{n} + {dz}::DOUBLE * z{n} + {own}::DOUBLE * model_id AS {f}{n}" for f, (c, dx, dy, dz, own) in LINEAR.items() for n in range(4))
    e = [[f"({a}{n} - {a}3)" for a in "xyz"] for n in range(3)]
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    rows = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    det = " + ".join(f"{a} * {b}" for a, b in zip(e[0], rows[0]))
    inverse = ", ".join(f"{rows[r][c]} / det AS m{r}{c}" for r in range(3) for c in range(3))
    return f"""mdl(model_id, priority, vertical, model_type, ox, oy, oz, s, ni, nj, nk, alpha) AS (VALUES {models}),
pat(parity, slot, {corners}) AS (VALUES {pattern}),
cells AS (SELECT m.*, i, j, k FROM mdl m, generate_series(0, 3) a(i), generate_series(0, 3) b(j), generate_series(0, 3) d(k)
          WHERE i < ni - 1 AND j < nj - 1 AND k < nk - 1),
placed AS (SELECT c.model_id, c.priority, c.vertical, c.model_type, c.alpha, ((c.i * (c.nj - 1) + c.j) * (c.nk - 1) + c.k) * 5 + p.slot AS tid, {places}
           FROM cells c JOIN pat p ON p.parity = (c.i + c.j + c.k) % 2),
sized AS (SELECT *, {det} AS det, {fields} FROM placed),
tet AS (SELECT *, {inverse} FROM sized)"""


SQL_MESH = _mesh_sql()


def sql_composite(name: str, points: str = "pts", lo: int = 0, hi: int = 255) -> str:
    """CTEs that end in `name`: (pid, rho .. alpha) by testing every point against every tetrahedron; zeros for a miss."""
    h = "CASE WHEN t.vertical = 'depth' THEN p.depth ELSE p.z END"
    l = [f"(m{r}0 * (p.x - x3) + m{r}1 * (p.y - y3) + m{r}2 * ({h} - z3))" for r in range(3)]  # noqa: E741
    mean = lambda f: " + ".join(f"l{n} * {f}{n}" for n in range(4))
    q = lambda f, v: f"({mean(v)}) / ({' + '.join(f'l{n} * {v}{n} / {f}{n}' for n in range(4))})"
    layer = {f: "CASE " + " ".join(f"WHEN depth >= {p[0]} THEN {p[n]}::DOUBLE" for p in PROFILE[:0:-1]) + f" ELSE {PROFILE[0][n]}::DOUBLE END" for n, f in enumerate(FIELDS, 1)}
    value = {"rho": mean("rho"), "vp": mean("vp"), "vs": mean("vs"), "qp": q("qp", "vp"), "qs": q("qs", "vs")}
    fields = ", ".join(f"CASE WHEN model_type = {DEPTH_PROFILE} THEN {layer[f]} ELSE {value[f]} END AS {f}" for f in FIELDS)
    weigh = "sum(alpha * tr)"
    total = lambda f: f"sum(alpha * tr * {f}) / {weigh}"
    loss = lambda f, v: f"sum(alpha * tr * {v}) / sum(alpha * tr * {v} / {f})"
    return f"""{name}_l AS (
  SELECT p.pid, p.depth, t.*, {', '.join(f'{x} AS l{n}' for n, x in enumerate(l))} FROM {points} p, tet t
  WHERE t.priority BETWEEN {lo} AND {hi} AND {' AND '.join(f'{x} >= -1e-4' for x in l)} AND {' + '.join(l)} <= 1 + 1e-4
  QUALIFY row_number() OVER (PARTITION BY p.pid, t.model_id ORDER BY t.tid) = 1),
{name}_q AS (SELECT pid, model_id, priority, tid, alpha, {fields} FROM (SELECT *, 1 - (l0 + l1 + l2) AS l3 FROM {name}_l)),
{name}_t AS (SELECT *, coalesce(product(1 - alpha) OVER (PARTITION BY pid ORDER BY priority, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS tr FROM {name}_q),
{name}_c AS (SELECT pid, {total('rho')} AS rho, {total('vp')} AS vp, {total('vs')} AS vs, {loss('qp', 'vp')} AS qp, {loss('qs', 'vs')} AS qs, {weigh} AS alpha
  FROM {name}_t GROUP BY pid),
{name} AS (SELECT p.pid, {', '.join(f'coalesce(c.{f}, 0.0) AS {f}' for f in COMPONENTS)} FROM {points} p LEFT JOIN {name}_c c ON p.pid = c.pid)"""


def rounded(columns: tuple[str, ...] = COMPONENTS, of: str = "") -> str:
    return ", ".join(f"round({of}{c}, 6) AS {c}" for c in columns)


