"""Basins from outlines and surfaces: samples, triangulation within metres, prisms between interfaces.

Outlines are rings (basin, n, x, y). Samples, interfaces and tetrahedra are rows; only the refinement of one basin's triangles is
sequential, and basins run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import coastline, meshes, surfaces, tin

PAD = 50.0  # metres, fixed value, that a depth mesh's bounds reach beyond surface and depth


def outline_segments(outlines: DataFrame) -> DataFrame:
    """(basin, n, ax, ay, bx, by): each point with the next, the last with the first; repeated points have no segment."""
    order = Window.partitionBy("basin").orderBy("n")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = {f"b{a}": F.coalesce(F.lead(a).over(order), F.first(a).over(whole)) for a in "xy"}
    pairs = outlines.filter("x IS NOT NULL AND y IS NOT NULL").select("basin", "n", F.col("x").alias("ax"), F.col("y").alias("ay"), *(c.alias(k) for k, c in after.items()))
    return pairs.filter("ax <> bx OR ay <> by")


def areas(outlines: DataFrame) -> DataFrame:
    """(basin, area, points): positive for rings that run anticlockwise."""
    twice = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))
    return outline_segments(outlines).groupBy("basin").agg((twice / 2).alias("area"), F.count(F.lit(1)).alias("points"))


def cleaned(outlines: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Outlines without repeated points, anticlockwise, and of more than the least area; others are left out whole."""
    lines = outline_segments(outlines).join(areas(outlines).filter(F.abs("area") > least_area), "basin")
    turned = F.when(F.col("area") > 0, F.col("n")).otherwise(-F.col("n"))
    return lines.select("basin", turned.alias("n"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def within(samples: DataFrame, outlines: DataFrame, band: float) -> DataFrame:
    """samples (x, y, ...) once for each basin that holds them. Both sides meet on bands of y, `band` high; a sample is told by its place."""
    lines = outline_segments(outlines)
    low, high = F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band)
    spread = lines.withColumn("_band", F.explode(F.sequence(low, high)))
    # merged: the samples of a raster are more than its bytes on disk tell, and are not to be broadcast
    met = samples.select("x", "y").distinct().withColumn("_band", F.floor(F.col("y") / band)).hint("merge").join(spread, "_band").filter(coastline.crosses(F.col("x"), F.col("y")))
    held = met.groupBy("basin", "x", "y").agg((F.count(F.lit(1)) % 2).alias("_odd")).filter("_odd = 1").drop("_odd")
    return samples.hint("merge").join(held, ["x", "y"])


def lattice(nodes: DataFrame, values: Sequence[str], origin: tuple[float, float], spacing: tuple[float, float], per_cell: int = 2) -> DataFrame:
    """(x, y, values) of a raster (ix, iy, values), per_cell times finer than its nodes: bilinear between them."""
    table = surfaces.stacked_cells(nodes, values)
    steps = [n / per_cell for n in range(per_cell)]
    place = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(w).alias("w")) for u in steps for w in steps)))
    fine = table.withColumn("_p", place).select("*", "_p.u", "_p.w")
    x, y = ((F.col(i) + F.col(t)) * float(step) + float(first) for i, t, step, first in zip(("ix", "iy"), ("u", "w"), spacing, origin))

    def between(v: str) -> Column:
        parts = (((1 - F.col("u")) * (1 - F.col("w")), "z00"), (F.col("u") * (1 - F.col("w")), "z10"), ((1 - F.col("u")) * F.col("w"), "z01"), (F.col("u") * F.col("w"), "z11"))
        return sum((F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.col(v)[c]) for weight, c in parts), F.lit(0.0))

    on_edge = [(F.col("u") == 0) | F.col(f"{values[0]}.z10").isNotNull(), (F.col("w") == 0) | F.col(f"{values[0]}.z01").isNotNull()]
    return fine.filter(on_edge[0] & on_edge[1]).select(x.alias("x"), y.alias("y"), *(between(v).alias(v) for v in values))


def along(outlines: DataFrame, spacing: float) -> DataFrame:
    """(basin, x, y) along the outlines, no further apart than the spacing; a segment is halved again and again, as the triangulation does."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    parts = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(length / spacing)), F.lit(0))).cast("long")
    fine = outline_segments(outlines).withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    t = F.col("_k") / F.col("_parts")
    return fine.select("basin", *((F.col(f"a{a}") + t * (F.col(f"b{a}") - F.col(f"a{a}"))).alias(a) for a in "xy"))


def triangulated(
    outlines: DataFrame, nodes: DataFrame, shape: tuple[int, int], metres: dict[str, float], origin: tuple[float, float] = (0.0, 0.0),
    spacing: tuple[float, float] = (1.0, 1.0), max_edge: float = math.inf, per_cell: int = 2,
) -> DataFrame:
    """(basin, tri, corner, vid, x, y): every surface of a raster (ix, iy, surfaces) is met within its metres at the lattice and along the outline."""
    step = min(spacing) / per_cell
    names = list(metres)
    inner = within(lattice(nodes, names, origin, spacing, per_cell), outlines, max(spacing)).select("basin", "x", "y", *names)
    rim = surfaces.bilinear_stack(along(outlines, step), nodes, shape, names, origin, spacing)
    return tin.adaptive_tins(outlines, inner.unionByName(rim), names, metres=[metres[n] for n in names], max_edge=max_edge)


def prism_model(
    triangles: DataFrame, nodes: DataFrame, shape: tuple[int, int], top: str, bottom: str, origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0),
) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of the prisms between two surfaces under triangulated(); model_id is the basin. A top below its bottom is lifted to it."""
    columns = at_vertices(triangles, nodes, shape, (top, bottom), origin, spacing).withColumnsRenamed({top: "top", bottom: "bottom"})
    return between(triangles, meshes.repair_interfaces(columns, strict=False))


def at_vertices(
    triangles: DataFrame, nodes: DataFrame, shape: tuple[int, int], interfaces: Sequence[str], origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """(basin, vid, x, y, interfaces) of the vertices of triangulated(): the raster's surfaces between its nodes."""
    return surfaces.bilinear_stack(triangles.select("basin", "vid", "x", "y").distinct(), nodes, shape, interfaces, origin, spacing)


def between(triangles: DataFrame, columns: DataFrame, model: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of the prisms under triangles from top to bottom of columns (basin, vid, x, y, top, bottom); model numbers are of basin, else basins."""
    model = (F.col("basin") if model is None else model).alias("model_id")
    ends = F.explode(F.array(F.struct((F.col("vid") * 2).alias("vid"), F.col("top").alias("z")), F.struct((F.col("vid") * 2 + 1).alias("vid"), F.col("bottom").alias("z"))))
    vertices = columns.select(model, "x", "y", ends.alias("e")).select("model_id", "e.vid", "x", "y", "e.z")
    sides = [F.max(F.when(F.col("corner") == n, F.col("vid"))).alias(c) for n, c in enumerate("abc")]
    rows = triangles.groupBy(model, "tri").agg(*sides)
    return vertices, meshes.prisms(rows).select("model_id", (F.col("tri") * 3 + F.col("slot")).alias("tid"), "v0", "v1", "v2", "v3")


def layered(triangles: DataFrame, columns: DataFrame, interfaces: Sequence[str], ends: Sequence[float] | None = None, pad: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a layer between each two neighbours of interfaces, all over one triangulation; model_id is basin * layers + layer.

    The bottom of a layer and the top of the next are the same depths at the same vertices, so they meet without a gap. An interface above
    that is missing or below the next one is lifted to it within its layer. ends: the depth where each layer's model ends and the layer with it;
    pad: how far the first top is raised where there is thickness.
    """
    n = len(interfaces) - 1
    if n < 1:
        raise ValueError("layers lie between two interfaces at least")
    layer = [F.struct(F.lit(k).alias("_k"), *(F.col(c).cast("double").alias(e) for c, e in zip(interfaces[k:], ("top", "bottom"))), F.lit(None if ends is None else float(ends[k])).cast("double").alias("_end")) for k in range(n)]
    own = columns.select("basin", "vid", "x", "y", F.inline(F.array(*layer)))
    own = meshes.repair_interfaces(own, strict=False)
    if ends is not None:
        own = own.withColumn("bottom", F.greatest(F.least("bottom", "_end"), "top"))
    if pad:
        own = own.withColumn("top", F.when((F.col("_k") == 0) & (F.col("bottom") > F.col("top")), F.col("top") - pad).otherwise(F.col("top")))
    each = triangles.withColumn("_k", F.explode(F.array(*map(F.lit, range(n)))))
    return between(each, own, F.col("basin") * n + F.col("_k"))


def depth_bounds(bounds: DataFrame, lowest: float, highest: float, pad: float = PAD) -> DataFrame:
    """Bounds (minz, maxz as depths) of depth meshes in elevation's frame: their depths below any ground between the two, and a margin."""
    return bounds.withColumns({"minz": F.col("minz") + lowest - pad, "maxz": F.col("maxz") + highest + pad})
