"""Meshes as tables: building them from grids, prisms and profiles, checking, thinning and ordering them.

vertices(model_id, vid, x, y, z, rho .. alpha); tets(model_id, tid, v0 .. v3); models(model_id, name, priority, vertical,
model_type, minx .. maxz, profile). z is positive down: negated elevation, or depth below the topography.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..schema import COMPONENTS, DEPTH_PROFILE

# Corners of a cell as (di, dj, dk) for the five tetrahedra of an even and of an odd cell: fixed values. Neighbouring cells differ in
# parity and so agree on the diagonal of the face they share.
EVEN = (("000", "100", "010", "001"), ("110", "100", "010", "111"), ("101", "100", "001", "111"), ("011", "010", "001", "111"), ("100", "010", "001", "111"))
ODD = (("100", "000", "110", "101"), ("010", "000", "110", "011"), ("001", "000", "101", "011"), ("111", "110", "101", "011"), ("000", "110", "101", "011"))


def grid_cells(spark: SparkSession, ni: int, nj: int, nk: int) -> DataFrame:
    """(i, j, k) of the cells of a grid of ni * nj * nk nodes."""
    n = max(ni - 1, 0) * max(nj - 1, 0) * max(nk - 1, 0)
    c, r = F.col("id"), max(nk - 1, 1)
    return spark.range(n).select((c / (max(nj - 1, 1) * r)).cast("long").alias("i"), ((c / r).cast("long") % max(nj - 1, 1)).alias("j"), (c % r).alias("k"))


def five_tets(cells: DataFrame, nj: int, nk: int) -> DataFrame:
    """(tid, slot, i, j, k, v0 .. v3): five tetrahedra a cell, as vertex numbers of the flattened grid."""

    def vertex(corner: str) -> Column:
        di, dj, dk = map(int, corner)
        return (F.col("i") + di) * (nj * nk) + (F.col("j") + dj) * nk + (F.col("k") + dk)

    def pattern(rows: tuple) -> Column:
        return F.array(*(F.struct(F.lit(s).alias("slot"), *(vertex(c).alias(f"v{n}") for n, c in enumerate(row))) for s, row in enumerate(rows)))

    chosen = F.when((F.col("i") + F.col("j") + F.col("k")) % 2 == 0, pattern(EVEN)).otherwise(pattern(ODD))
    cell = (F.col("i") * (nj - 1) + F.col("j")) * (nk - 1) + F.col("k")
    return cells.select("i", "j", "k", cell.alias("cell"), F.explode(chosen).alias("t")).select((F.col("cell") * 5 + F.col("t.slot")).alias("tid"), "t.slot", "i", "j", "k", *(F.col(f"t.v{n}").alias(f"v{n}") for n in range(4)))


def grid_mesh(spark: SparkSession, model_id: int, origin: tuple, step: tuple, shape: tuple, **fields: Column | float) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a regular grid; fields are columns of x, y, z or constants."""
    ni, nj, nk = shape
    c = F.col("id")
    place = {"x": (c / (nj * nk)).cast("long") * float(step[0]) + float(origin[0]), "y": ((c / nk).cast("long") % nj) * float(step[1]) + float(origin[1]), "z": (c % nk) * float(step[2]) + float(origin[2])}
    vertices = spark.range(ni * nj * nk).select(F.lit(model_id).alias("model_id"), c.alias("vid"), *(v.cast("double").alias(k) for k, v in place.items()))
    values = {f: fields.get(f, 1.0 if f == "alpha" else 0.0) for f in COMPONENTS}
    vertices = vertices.select("*", *((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in values.items()))
    return vertices, five_tets(grid_cells(spark, ni, nj, nk), nj, nk).select(F.lit(model_id).alias("model_id"), "tid", "v0", "v1", "v2", "v3")


def gather(tets: DataFrame, vertices: DataFrame, columns: tuple[str, ...] = ("x", "y", "z", *COMPONENTS)) -> DataFrame:
    """tets with the structs c0 .. c3 of their corners: one join and one aggregation, not four joins.

    Both joins are merged: Spark's sizes don't see that cells and tetrahedra were exploded, and so it would gather millions of them in the driver to broadcast.
    """
    tets = tets.hint("merge")
    corners = tets.select("model_id", "tid", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("corner", "vid")).hint("merge")
    joined = corners.join(vertices.select("model_id", "vid", F.struct(*columns).alias("c")), ["model_id", "vid"])
    sides = [F.max(F.when(F.col("corner") == n, F.col("c"))).alias(f"c{n}") for n in range(4)]
    return tets.join(joined.groupBy("model_id", "tid").agg(*sides), ["model_id", "tid"])


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sides(cornered: str = "c") -> tuple[tuple, tuple, tuple]:
    """Edges from the last corner to the others."""
    last = F.col(f"{cornered}3")
    return tuple(tuple(F.col(f"{cornered}{n}")[a] - last[a] for a in "xyz") for n in range(3))


def determinant() -> Column:
    e0, e1, e2 = sides()
    return dot(e0, cross(e1, e2))


def volume() -> Column:
    """Of rows that gather() made."""
    return F.abs(determinant()) / 6


def prisms(triangles: DataFrame) -> DataFrame:
    """(tri, slot, v0 .. v3): three tetrahedra under each triangle (tri, a, b, c). Column n has its top at vertex 2n, its bottom at 2n + 1.

    Corners are sorted first, so neighbouring prisms split their shared face along the same diagonal.
    """
    s = F.array_sort(F.array("a", "b", "c"))
    i, j, k = (2 * s[n] for n in range(3))
    rows = ((i, i + 1, j + 1, k + 1), (i, j, j + 1, k), (i, j + 1, k, k + 1))
    made = F.array(*(F.struct(F.lit(n).alias("slot"), *(v.alias(f"v{m}") for m, v in enumerate(row))) for n, row in enumerate(rows)))
    keys = [c for c in triangles.columns if c not in ("a", "b", "c")]
    return triangles.select(*keys, F.explode(made).alias("t")).select(*keys, "t.slot", *(F.col(f"t.v{m}").alias(f"v{m}") for m in range(4)))


def cull(vertices: DataFrame, tets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Drops tetrahedra of no more than the threshold's volume, then unused vertices; vertex numbers become dense again."""
    kept = gather(tets, vertices, ("x", "y", "z")).filter(volume() > threshold).select("model_id", "tid", "v0", "v1", "v2", "v3")
    used = kept.select("model_id", F.explode(F.array("v0", "v1", "v2", "v3")).alias("vid")).distinct()
    # numbers are dense within a model: a model's used vertices are counted in one window
    numbers = used.withColumn("new", (F.row_number().over(Window.partitionBy("model_id").orderBy("vid")) - 1).cast("long"))
    thin = vertices.join(numbers, ["model_id", "vid"]).withColumn("vid", F.col("new")).drop("new")
    corner = kept.select("model_id", "tid", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("corner", "vid")).join(numbers, ["model_id", "vid"])
    again = corner.groupBy("model_id", "tid").agg(*(F.max(F.when(F.col("corner") == n, F.col("new"))).alias(f"v{n}") for n in range(4)))
    return thin, again


def report(vertices: DataFrame, tets: DataFrame, least: float = 1e-6) -> DataFrame:
    """(model_id, n_tets, min_volume, ok): a mesh with a tetrahedron below the least volume isn't ok."""
    return gather(tets, vertices, ("x", "y", "z")).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_tets"), F.min(volume()).alias("min_volume")).withColumn("ok", F.col("min_volume") >= least)


def bounds(vertices: DataFrame, pad: float = 0.0) -> DataFrame:
    return vertices.groupBy("model_id").agg(*(f((F.col(a))).alias(f"{n}{a}") for f, n in ((F.min, "min"), (F.max, "max")) for a in "xyz")).select("model_id", *((F.col(f"min{a}") - pad).alias(f"min{a}") for a in "xyz"), *((F.col(f"max{a}") + pad).alias(f"max{a}") for a in "xyz"))


def world_bounds(vertices: DataFrame, to_local: Sequence[Sequence[float]], pad: float = 0.0) -> DataFrame:
    """bounds() in the world of vertices in a model's frame, by the inverse of the map from the world."""
    return bounds(in_world(vertices, to_local), pad)


def in_world(vertices: DataFrame, to_local: Sequence[Sequence[float]]) -> DataFrame:
    """vertices moved from a model's frame to the world; barycentric weights are the same in both."""
    moved = numeric.affine(np.linalg.inv(np.asarray(to_local)).tolist(), *(F.col(a) for a in "xyz"))
    return vertices.withColumns(dict(zip("xyz", moved, strict=True)))


def validate(models: DataFrame, tets: DataFrame) -> None:
    """Raises where a model is empty, of an unknown type, or a depth profile without a profile."""
    if "profile" not in models.columns:
        models = models.withColumn("profile", F.lit(None).cast("string"))
    found = models.join(tets.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")), "model_id", "left")
    wrong = found.filter(F.col("n").isNull() | ~F.col("model_type").isin(1, 2, 3) | ((F.col("model_type") == DEPTH_PROFILE) & F.col("profile").isNull()) | ~F.col("vertical").isin("elevation", "depth")).select("name").limit(10).collect()
    if wrong:
        raise ValueError(f"models that are empty or of a wrong type: {sorted(r[0] for r in wrong)}")


def rectilinear(points: DataFrame) -> DataFrame:
    """points (x, y, z, ...) with their grid numbers ix, iy, iz; raises unless they fill a grid."""
    n = points.agg(F.count(F.lit(1)), *(F.countDistinct(a) for a in "xyz")).first()
    if n[0] != n[1] * n[2] * n[3] or not n[0]:
        raise ValueError(f"{n[0]} points don't fill a grid of {n[1]} x {n[2]} x {n[3]}")
    out = points
    for a in "xyz":  # an axis has few values
        axis = points.select(a).distinct().withColumn(f"i{a}", (F.row_number().over(Window.orderBy(a)) - 1).cast("long"))
        out = out.join(axis, a)
    return out


def tomography_mesh(spark: SparkSession, points: DataFrame, model_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a table x, y, z, vp, vs, rho in km/s and g/cc, with qp and qs or their rules (qs = 0.05 vs, qp = 2 qs)."""
    own = set(points.columns)
    numbered = rectilinear(points)
    ni, nj, nk = (points.select(a).distinct().count() for a in "xyz")
    m = {c: F.col(c) * 1000.0 for c in ("rho", "vp", "vs")}
    qs = F.col("qs") if "qs" in own else m["vs"] * 0.05
    qp = F.col("qp") if "qp" in own else qs * 2
    vid = F.col("ix") * (nj * nk) + F.col("iy") * nk + F.col("iz")
    vertices = numbered.select(F.lit(model_id).alias("model_id"), vid.alias("vid"), *(F.col(a).cast("double") for a in "xyz"), *(m[c].alias(c) for c in ("rho", "vp", "vs")), qp.alias("qp"), qs.alias("qs"), F.lit(1.0).alias("alpha"))
    return vertices, five_tets(grid_cells(spark, ni, nj, nk), nj, nk).select(F.lit(model_id).alias("model_id"), "tid", "v0", "v1", "v2", "v3")


def join_q(points: DataFrame, q: DataFrame, keys: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """points with q's other columns; raises where a key is doubled or missing."""
    for name, side in (("points", points), ("Q table", q)):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"the {name} repeat a position")
    if not points.join(q, list(keys), "left_anti").isEmpty():
        raise ValueError("the Q table lacks some positions")
    return points.join(q, list(keys), "left")


def layer_tops(layers: DataFrame, by: tuple[str, ...] = (), bottom: str = "bottom") -> DataFrame:
    """Layers with top (the bottom above, 0 at first) and thickness."""
    order = Window.partitionBy(*by).orderBy(bottom)
    return layers.withColumn("top", F.lag(bottom, 1, 0.0).over(order)).withColumn("thickness", F.col(bottom) - F.col("top"))


def repair_interfaces(columns: DataFrame, top: str = "top", bottom: str = "bottom", strict: bool = True) -> DataFrame:
    """A missing interface takes the other's depth, and a top below its bottom is lifted to it; with `strict` both missing raises."""
    t, b = numeric.not_nan(F.col(top)), numeric.not_nan(F.col(bottom))
    if strict and not columns.filter(t.isNull() & b.isNull()).isEmpty():
        raise ValueError("both interfaces are missing")
    fixed = F.coalesce(b, t)
    return columns.withColumns({top: F.least(F.coalesce(t, b), fixed), bottom: fixed})


def slice_layers(columns: DataFrame, layers: DataFrame, key: str = "vid") -> DataFrame:
    """(key, layer, slice_top, slice_bottom) of columns (key, top, bottom) cut by layers (layer, z, thickness).

    A layer reaches from where the last one ended to its own bottom, within the column.
    """
    cut = columns.select(key, "top", "bottom").join(F.broadcast(layers.select("layer", (F.col("z") + F.col("thickness")).alias("_to"))), F.lit(True))  # a profile has a few dozen layers
    reach = F.greatest(F.least("_to", "bottom"), "top")
    order = Window.partitionBy(key).orderBy("layer")
    ended = cut.withColumn("slice_bottom", F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ended.withColumn("slice_top", F.coalesce(F.lag("slice_bottom").over(order), F.col("top"))).select(key, "layer", "slice_top", "slice_bottom")


def profile_mesh(columns: DataFrame, triangles: DataFrame, layers: DataFrame, model_id: int, threshold: float = 0.0, pad: float = 0.0) -> tuple[DataFrame, DataFrame, Column]:
    """(vertices, tets, profile literal) of one prism column a triangle between a top and a bottom interface.

    columns: vid, x, y, top, bottom (depths); layers: z, thickness and fields. The model ends at the last layer's bottom; with `pad`
    the top is raised where there is thickness.
    """
    rows = [r.asDict() for r in layers.orderBy("z").collect()]  # a profile has a few dozen layers
    rows = [r for r, after in zip(rows, [*rows[1:], None]) if after is None or r["z"] != after["z"]]
    end = rows[-1]["z"] + rows[-1]["thickness"]
    bottom = F.greatest(F.least(F.col("bottom"), F.lit(float(end))), F.col("top"))
    cut = columns.withColumn("_b", bottom).withColumn("_t", F.when(F.col("_b") > F.col("top"), F.col("top") - pad).otherwise(F.col("top")))
    ends = F.explode(F.array(F.struct((F.col("vid") * 2).alias("vid"), F.col("_t").alias("z")), F.struct((F.col("vid") * 2 + 1).alias("vid"), F.col("_b").alias("z"))))
    vertices = cut.select("x", "y", ends.alias("e")).select(F.lit(model_id).alias("model_id"), "e.vid", "x", "y", "e.z")
    layer = F.array(*(F.struct(F.lit(float(r["z"])).alias("top"), *(F.lit(float(r[c])).alias(c) for c in ("rho", "vp", "vs", "qp", "qs"))) for r in rows))
    at = numeric.layer_of(F.col("z"), layer)
    vertices = vertices.select("*", *(at[c].alias(c) for c in ("rho", "vp", "vs", "qp", "qs")), F.lit(1.0).alias("alpha"))
    tets = prisms(triangles).select(F.lit(model_id).alias("model_id"), (F.col("tri") * 3 + F.col("slot")).cast("long").alias("tid"), *(F.col(f"v{n}").cast("long").alias(f"v{n}") for n in range(4)))
    thin, kept = cull(vertices, tets, threshold)
    return thin, kept, layer


def fade(distance: Column, width: float) -> Column:
    """Opacity across a smoothing band: 1 at its inner edge, 0 at its outer one."""
    return numeric.interpolate(distance, [0.0, width], [1.0, 0.0]) if width > 0 else F.lit(1.0)


def stacked(interfaces: DataFrame, key: str = "vid", order: str = "interface", depth: str = "depth") -> DataFrame:
    """(key, layer, top, bottom): each interface with the next below it."""
    by = Window.partitionBy(key).orderBy(order)
    return interfaces.withColumn("bottom", F.lead(depth).over(by)).filter(F.col("bottom").isNotNull()).select(key, F.col(order).alias("layer"), F.col(depth).alias("top"), "bottom")


def in_z_order(vertices: DataFrame, tets: DataFrame, resolution: float, partitions: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same mesh with vertices numbered along a Z-order curve; a layout hint that changes no result."""
    low = vertices.groupBy("model_id").agg(*(F.min(a).alias(f"_{a}") for a in "xyz"))
    cells = [F.floor((F.col(a) - F.col(f"_{a}")) / resolution) for a in "xyz"]
    keyed = vertices.join(F.broadcast(low), "model_id").withColumn("_key", numeric.morton(*cells))
    numbered = keyed.withColumn("_new", (F.row_number().over(Window.partitionBy("model_id").orderBy("_key", "vid")) - 1).cast("long"))
    numbers = numbered.select("model_id", "vid", "_new")
    corner = tets.select("model_id", "tid", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("corner", "vid")).join(numbers, ["model_id", "vid"])
    again = corner.groupBy("model_id", "tid").agg(*(F.max(F.when(F.col("corner") == n, F.col("_new"))).alias(f"v{n}") for n in range(4)))
    return numbered.withColumn("vid", F.col("_new")).select(*vertices.columns), again


def concatenated(*meshes: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Meshes of one model joined: vertex and tetrahedron numbers of later ones are moved on."""
    vertices, tets = meshes[0]
    for v, t in meshes[1:]:
        nv, nt = (d.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0] for d, c in ((vertices, "vid"), (tets, "tid")))
        vertices = vertices.unionByName(v.withColumn("vid", F.col("vid") + nv))
        tets = tets.unionByName(t.withColumns({"tid": F.col("tid") + nt, **{f"v{n}": F.col(f"v{n}") + nv for n in range(4)}}))
    return vertices, tets


def rewrite_top(vertices: DataFrame, mask: Column, depth_t: float, vs30: Column, vp_t: Column, vs_t: Column, outside: dict[str, float]) -> DataFrame:
    """Vertices whose column is tapered from its own top: each column's least z is its ground; outside the mask constants stand."""
    ground = F.min("z").over(Window.partitionBy("model_id", "x", "y"))
    own = vertices.withColumn("_d", F.col("z") - ground)
    taper = numeric.ely_profile(F.least("_d", F.lit(float(depth_t))), vs30, vp_t, vs_t, depth_t)
    near = F.col("_d") < depth_t
    made = {c: F.when(near & mask, taper[c]).when(near, F.lit(float(outside[c]))).otherwise(F.col(c)) for c in COMPONENTS if c in outside}
    return own.withColumns(made).drop("_d")
