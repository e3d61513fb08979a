"""Rasters and curvilinear grids: bilinear lookup, block means, resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric

OUTSIDE = 1e-9  # of a cell, by which a point may miss the raster and still be inside
BROADCAST_NODES = 2_000_000
BROADCAST_VALUES = 400_000  # nodes times surfaces of stacked cells, of about 40 bytes


def cells(nodes: DataFrame, value: str = "z") -> DataFrame:
    """(ix, iy, z00, z10, z01, z11): each node with its neighbours to the right and below. A raster's row or column is a window partition."""
    z = numeric.not_nan(F.col(value).cast("double"))
    right = nodes.select("ix", "iy", z.alias("z00")).withColumn("z10", F.lead("z00").over(Window.partitionBy("iy").orderBy("ix")))
    below = Window.partitionBy("ix").orderBy("iy")
    return right.withColumns({"z01": F.lead("z00").over(below), "z11": F.lead("z10").over(below)})


def stacked_cells(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(ix, iy, values): cells() of several surfaces, each a struct of z00, z10, z01, z11. The nodes are put in order once for all of them."""
    own = nodes.select("ix", "iy", F.struct(*(numeric.not_nan(F.col(v).cast("double")).alias(v) for v in values)).alias("z00"))
    right = own.withColumn("z10", F.lead("z00").over(Window.partitionBy("iy").orderBy("ix")))
    below = Window.partitionBy("ix").orderBy("iy")
    full = right.withColumns({"z01": F.lead("z00").over(below), "z11": F.lead("z10").over(below)})
    return full.select("ix", "iy", *(F.struct(*(F.col(z)[v].alias(z) for z in ("z00", "z10", "z01", "z11"))).alias(v) for v in values))


def bilinear_stack(points: DataFrame, nodes: DataFrame, shape: tuple[int, int], values: Sequence[str], origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """points (x, y, ...) with the values of several surfaces of a raster (ix, iy, values), as bilinear() has each; outside NULL. One join for all of them."""
    at = {f"_t{a}": (F.col(a) - float(first)) / float(step) for a, first, step in zip("xy", origin, spacing)}
    lower = {f"_i{a}": F.greatest(F.least(F.floor(f"_t{a}"), F.lit(n - 2)), F.lit(0)) for a, n in zip("xy", shape)}
    keyed = points.withColumns(at).withColumns(lower).withColumns({f"_t{a}": F.col(f"_t{a}") - F.col(f"_i{a}") for a in "xy"})
    table = stacked_cells(nodes, values).select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *(F.col(v).alias(f"_v_{v}") for v in values))
    small = shape[0] * shape[1] * len(values) <= BROADCAST_VALUES
    table = F.broadcast(table) if small else table.hint("merge")  # a raster of small whole numbers has few bytes on disk
    outside = (F.col("_tx") < -OUTSIDE) | (F.col("_tx") > 1 + OUTSIDE) | (F.col("_ty") < -OUTSIDE) | (F.col("_ty") > 1 + OUTSIDE)
    u, v = numeric.clip(F.col("_tx"), 0, 1), numeric.clip(F.col("_ty"), 0, 1)
    corners = (((1 - u) * (1 - v), "z00"), (u * (1 - v), "z10"), ((1 - u) * v, "z01"), (u * v, "z11"))

    def between(name: str) -> Column:
        parts = [F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"_v_{name}")[z]) for w, z in corners]
        return F.when(~outside, parts[0] + parts[1] + parts[2] + parts[3])

    return keyed.join(table, ["_ix", "_iy"], "left").select(*points.columns, *(between(name).alias(name) for name in values))


def bilinear(points: DataFrame, nodes: DataFrame, shape: tuple[int, int], origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0), frame: Sequence[Sequence[float]] | None = None, extrapolate: bool = False, name: str = "surface", value: str = "z", axes: tuple[Sequence[float], Sequence[float]] | None = None, table: DataFrame | None = None) -> DataFrame:
    """points (x, y, ...) with the raster's value; outside NULL, or the edge's value with `extrapolate`.

    `frame` maps world to raster coordinates (two rows of three numbers). `axes` gives uneven node positions. A corner without
    weight has no part, so missing data next to a node doesn't blank it. `table` has the cells where they are at hand (_ix, _iy, z00 ..).
    """
    nx, ny = shape
    fx, fy = numeric.affine(frame, F.col("x"), F.col("y")) if frame is not None else (F.col("x"), F.col("y"))

    def cell(position: Column, first: float, step: float, n: int, axis: Sequence[float] | None) -> tuple[Column, Column]:
        if axis is None:
            at = (position - first) / step
            lower = F.greatest(F.least(F.floor(at), F.lit(n - 2)), F.lit(0))
            return lower, at - lower
        nodes_at = F.array(*(F.lit(float(a)) for a in axis))
        lower = F.greatest(F.least(F.size(F.filter(nodes_at, lambda a: a <= position)) - 1, F.lit(n - 2)), F.lit(0)).cast("long")
        low, high = F.get(nodes_at, lower.cast("int")), F.get(nodes_at, (lower + 1).cast("int"))
        return lower, (position - low) / (high - low)

    (ix, tx), (iy, ty) = cell(fx, origin[0], spacing[0], nx, axes and axes[0]), cell(fy, origin[1], spacing[1], ny, axes and axes[1])
    keyed = points.withColumns({"_ix": ix, "_iy": iy, "_tx": tx, "_ty": ty})
    outside = (F.col("_tx") < -OUTSIDE) | (F.col("_tx") > 1 + OUTSIDE) | (F.col("_ty") < -OUTSIDE) | (F.col("_ty") > 1 + OUTSIDE)
    if table is None:
        table = cells(nodes, value).select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "z00", "z10", "z01", "z11")
        table = F.broadcast(table) if nx * ny <= BROADCAST_NODES else table
    u, v = numeric.clip(F.col("_tx"), 0, 1), numeric.clip(F.col("_ty"), 0, 1)
    corners = (((1 - u) * (1 - v), "z00"), (u * (1 - v), "z10"), ((1 - u) * v, "z01"), (u * v, "z11"))
    parts = [F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(z)) for w, z in corners]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    out = total if extrapolate else F.when(~outside, total)
    return keyed.join(table, ["_ix", "_iy"], "left").select(*points.columns, out.alias(name))


def coarsen(nodes: DataFrame, factor: int, shape: tuple[int, int], value: str = "z") -> DataFrame:
    """Means of factor * factor blocks; blocks that the raster cuts off are left out, missing values don't count."""
    bx, by = F.floor(F.col("ix") / factor), F.floor(F.col("iy") / factor)
    whole = (bx < shape[0] // factor) & (by < shape[1] // factor)
    return nodes.filter(whole).groupBy(bx.alias("ix"), by.alias("iy")).agg(F.avg(numeric.not_nan(F.col(value).cast("double"))).alias(value))


def value_range(nodes: DataFrame, value: str = "z") -> DataFrame:
    z = numeric.not_nan(F.col(value).cast("double"))
    return nodes.agg(F.min(z).alias("lowest"), F.max(z).alias("highest"), F.count(z).alias("n"))


def window(nodes: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Nodes with numbers in both ranges, ends included: a filter that reaches the scan."""
    return nodes.filter(F.col("ix").between(*x) & F.col("iy").between(*y))


def valid_window(nodes: DataFrame, value: str = "z") -> tuple[tuple[int, int], tuple[int, int]]:
    """The smallest ranges that hold all valid nodes."""
    r = nodes.filter(numeric.not_nan(F.col(value).cast("double")).isNotNull()).agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    return (r[0], r[1]), (r[2], r[3])


def median_spacing(nodes: DataFrame, along: str = "ix") -> DataFrame:
    """The median distance between neighbours of (ix, iy, x, y): exact."""
    other = "iy" if along == "ix" else "ix"
    by = Window.partitionBy(other).orderBy(along)
    step = F.hypot(F.lead("x").over(by) - F.col("x"), F.lead("y").over(by) - F.col("y"))
    return nodes.select(step.alias("step")).agg(F.percentile("step", F.lit(0.5)).alias("spacing"))


def depth_below(surface: DataFrame, topography: DataFrame, shape: tuple[int, int], **options) -> DataFrame:
    """surface nodes (x, y, z) as depth below the topography at the same place; the topography's edge extends."""
    return bilinear(surface, topography, shape, extrapolate=True, name="_ground", **options).withColumn("depth", F.col("z") - F.col("_ground")).drop("_ground")


def limits(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, lowest, highest, n) of each column's valid values, in one pass."""
    valid = {c: numeric.not_nan(F.col(c).cast("double")) for c in columns}
    found = F.array(*(F.struct(F.lit(c).alias("component"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.count(v).alias("n")) for c, v in valid.items()))
    return rows.agg(found.alias("f")).select(F.inline("f"))


def index_fit(nodes: DataFrame) -> DataFrame:
    """One row of the least-squares map from places to numbers (j, k) of a curvilinear grid: its centres cx, cy, cj, ck and the slopes jx, jy, kx, ky.

    Slopes are NULL where the nodes stand on one line.
    """
    r = nodes.agg(
        *(F.avg(c).alias(f"c{c}") for c in ("x", "y", "j", "k")), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        *(F.covar_pop(i, a).alias(f"_{i}{a}") for i in "jk" for a in "xy"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = det <= 1e-12 * F.col("xx") * F.col("yy")
    slopes = {f"{i}x": F.col(f"_{i}x") * F.col("yy") - F.col(f"_{i}y") * F.col("xy") for i in "jk"} | {f"{i}y": F.col(f"_{i}y") * F.col("xx") - F.col(f"_{i}x") * F.col("xy") for i in "jk"}
    return r.select("cx", "cy", "cj", "ck", *(F.when(~flat, F.try_divide(v, det)).alias(c) for c, v in slopes.items()))


def quads(nodes: DataFrame) -> DataFrame:
    """(j, k, x0.., y0.., v0..): the cells of a curvilinear grid (j, k, x, y, value); corners 0: (j,k), 1: (j,k+1), 2: (j+1,k), 3: (j+1,k+1)."""
    own = nodes.select("j", "k", F.struct("x", "y", "value").alias("p0"))
    along = own.withColumn("p1", F.lead("p0").over(Window.partitionBy("j").orderBy("k")))
    down = Window.partitionBy("k").orderBy("j")
    full = along.withColumns({"p2": F.lead("p0").over(down), "p3": F.lead("p1").over(down)}).filter("p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL")
    return full.select("j", "k", *(F.col(f"p{n}")[c].alias(f"{s}{n}") for n in range(4) for c, s in (("x", "x"), ("y", "y"), ("value", "v"))))


def in_quads(points: DataFrame, nodes: DataFrame, level: int, name: str = "value") -> DataFrame:
    """points (x, y, ...) with the bilinear value of the quad that holds each; NULL outside. Quads are binned in cells of 2**level.

    The inverse of the bilinear map is the root in [0, 1] of a quadratic, taken in the form without cancellation.
    """
    size = 2.0**level
    own = quads(nodes)
    low, high = ({a: f(*(F.col(f"{a}{n}") for n in range(4))) for a in "xy"} for f in (F.least, F.greatest))
    for a in "xy":
        own = own.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(low[a] / size), F.floor(high[a] / size))))
    keyed = points.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    ax, ay, bx, by = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    cx, cy = F.col("x3") - F.col("x1") - bx, F.col("y3") - F.col("y1") - by
    a, b, c = bx * cy - by * cx, (ax * by - ay * bx) + (cx * py - cy * px), ay * px - ax * py
    # b v + a v^2 = -c along the second side
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    q = -(b + F.when(b < 0, -root).otherwise(root)) / 2
    v1, v2 = F.try_divide(c, q), F.when(F.abs(a) > 1e-12 * F.abs(b), F.try_divide(q, a))
    miss = lambda v: F.greatest(-v, v - 1, F.lit(0.0))
    v = F.when(v1.isNull(), v2).when(v2.isNull() | (miss(v1) <= miss(v2)), v1).otherwise(v2)
    joined = keyed.join(own, ["_cx", "_cy"], "left").withColumn("_v", v)
    dx, dy = ax + cx * F.col("_v"), ay + cy * F.col("_v")
    u = F.when(F.abs(dx) >= F.abs(dy), F.try_divide(px - bx * F.col("_v"), dx)).otherwise(F.try_divide(py - by * F.col("_v"), dy))
    joined = joined.withColumn("_u", u)
    u, v = F.col("_u"), F.col("_v")
    held = F.greatest(miss(u), miss(v)) <= OUTSIDE
    value = (1 - u) * (1 - v) * F.col("v0") + u * (1 - v) * F.col("v1") + (1 - u) * v * F.col("v2") + u * v * F.col("v3")
    # on a shared edge both cells agree; the first one stands for them
    best = F.min(F.when(held, F.struct("j", "k", value.alias("value"))))
    return joined.groupBy(*points.columns).agg(best.alias("_b")).select(*points.columns, F.col("_b.value").alias(name))


def resample_upright(spark: SparkSession, nodes: DataFrame, spacing: float | None = None, level: int | None = None) -> DataFrame:
    """(ix, iy, x, y, z) of a curvilinear grid (j, k, x, y, value) on an upright lattice; the spacing is the median one unless given."""
    step = spacing or float(median_spacing(nodes.select(F.col("k").alias("ix"), F.col("j").alias("iy"), "x", "y")).first()[0])
    r = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    nx, ny = (int((r[2 * a + 1] - r[2 * a]) // step) + 1 for a in (0, 1))
    lattice = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy")).withColumns({"x": F.lit(r[0]) + F.col("ix") * step, "y": F.lit(r[2]) + F.col("iy") * step})
    return in_quads(lattice, nodes, math.ceil(math.log2(step)) + 1 if level is None else level, name="z")
