"""Grid generators: query points with numbers (grid, i, j, k), coordinates, depth and nominal depth.

i, j, k run east, north and down; z is positive down. A block's surface is sampled once for each column, then columns are
multiplied by levels, so no level repeats a raster lookup.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..schema import RESERVED

SURFACE_SAMPLES = 65  # between a surface's lowest and highest value, to see whether levels cross
Surface = Callable[[DataFrame, str], DataFrame]  # adds the surface's value (positive down) to rows with x, y


@dataclass(frozen=True)
class Frame:
    """Grid to world: turned clockwise by azimuth degrees about the origin."""

    origin_x: float = 0.0
    origin_y: float = 0.0
    azimuth: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return numeric.translate(self.origin_x, self.origin_y) @ numeric.rotate(-self.azimuth)

    def outline(self, nx: int, ny: int, res_x: float, res_y: float) -> list[tuple[float, float]]:
        half = [(sx * nx * res_x / 2, sy * ny * res_y / 2) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        return [tuple((self.matrix @ [x, y, 1])[:2].tolist()) for x, y in half]


def grid_azimuth(azimuth: float, lon: float, lat: float, projection=None) -> float:
    """Degrees clockwise from grid north of a bearing from true north at a place."""
    from ..functions.crs import TransverseMercator

    return (azimuth + (projection or TransverseMercator()).convergence(lon, lat)) % 360


def nodes_along(extent: float, resolution: float) -> int:
    return round(extent / resolution) + 1


def levels_to(thickness: float, resolution: float) -> int:
    """Levels until the first at or below the thickness; noise in the quotient is rounded off first."""
    return math.ceil(round(thickness / resolution, 6)) + 1


def columns(spark: SparkSession, ni: int, nj: int, res_x: float, res_y: float, frame: Frame = Frame(), stride: int = 1) -> DataFrame:
    """(i, j, x, y) of the columns, with the numbers of the finest grid: a coarser one takes every stride-th, bit for bit."""
    keep_i, keep_j = -(-ni // stride), -(-nj // stride)
    i, j = (F.col("id") / keep_j).cast("long") * stride, F.col("id") % keep_j * stride
    own = spark.range(keep_i * keep_j).select(i.alias("i"), j.alias("j"))
    x, y = numeric.affine(frame.matrix.tolist(), (F.col("i") - ni / 2) * res_x, (F.col("j") - nj / 2) * res_y)
    return own.withColumns({"x": x, "y": y})


def _with_levels(block: DataFrame, nk: int) -> DataFrame:
    return block.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nk - 1).cast("long"))))


def hang(block: DataFrame, surface: Surface, thickness: float, resolution: float, name: str) -> DataFrame:
    """Levels at fixed depths below the surface."""
    out = _with_levels(surface(block, "_s"), levels_to(thickness, resolution)).withColumn("depth", F.col("k") * float(resolution))
    return out.withColumns({"grid": F.lit(name), "z": F.col("_s") + F.col("depth"), "nominal_depth": F.col("depth")}).drop("_s")


def shape(block: DataFrame, surface: Surface, levels: Column, nk: int, name: str, decay: str, **decay_options: float) -> DataFrame:
    """Levels that follow the surface less and less with depth. `levels` gives the nominal depth of k."""
    out = _with_levels(surface(block, "_s"), nk).withColumn("nominal_depth", levels)
    weight = numeric.decay_weight(decay, F.col("nominal_depth"), F.col("_s"), **decay_options)
    z, depth = numeric.terrain(F.col("nominal_depth"), F.col("_s"), F.col("_w"))
    return out.withColumn("_w", weight).withColumns({"grid": F.lit(name), "z": z, "depth": depth}).drop("_s", "_w")


def regular(spark: SparkSession, surface: Surface, extent_x: float, extent_y: float, thickness: float, res_x: float, res_y: float, res_z: float, frame: Frame = Frame(), name: str = "grid") -> DataFrame:
    if thickness < res_z:
        raise ValueError("thickness must be at least one vertical step")
    return hang(columns(spark, nodes_along(extent_x, res_x), nodes_along(extent_y, res_y), res_x, res_y, frame), surface, thickness, res_z, name)


def check_refinements(refinements: dict[str, tuple[float, float]]) -> list[tuple[str, float, float]]:
    """Blocks (name, resolution, bottom) from the top; each is twice as coarse as the one above, and bottoms differ."""
    blocks = sorted(((n, float(r), float(b)) for n, (r, b) in refinements.items()), key=lambda x: x[2])
    for (_, fine, top), (name, coarse, bottom) in zip(blocks, blocks[1:]):
        if top == bottom:
            raise ValueError("refinements must end at different depths")
        if not math.isclose(coarse, 2 * fine):
            raise ValueError(f"{name} must be twice as coarse as the block above it")
    return blocks


def sw4(spark: SparkSession, surface: Surface, extent_x: float, extent_y: float, refinements: dict[str, tuple[float, float]], frame: Frame = Frame(), decay: str | None = None, **decay_options: float) -> DataFrame:
    """Nested blocks, coarser with depth. Without a decay the first block is stretched from the surface to its flat bottom."""
    blocks = check_refinements(refinements)
    finest, coarsest = blocks[0][1], blocks[-1][1]
    extent_x, extent_y = (math.ceil(round(e / coarsest, 6)) * coarsest for e in (extent_x, extent_y))
    ni, nj = nodes_along(extent_x, finest), nodes_along(extent_y, finest)
    out, top = None, 0.0
    for n, (name, resolution, bottom) in enumerate(blocks):
        own = columns(spark, ni, nj, finest, finest, frame, round(resolution / finest))
        nk = round((bottom - top) / resolution) + 1
        nominal = top + F.col("k") * float(resolution)
        if decay is not None:
            made = shape(own, surface, nominal, nk, name, decay, **({"length": blocks[0][2]} | decay_options))
        elif n == 0:
            made = shape(own, surface, nominal, nk, name, "linear", length=bottom)
        else:
            made = _with_levels(surface(own, "_s"), nk).withColumn("nominal_depth", nominal).withColumns({"grid": F.lit(name), "z": F.col("nominal_depth"), "depth": F.col("nominal_depth") - F.col("_s")}).drop("_s")
        out = made if out is None else out.unionByName(made)
        top = bottom
    return out


def emod3d(spark: SparkSession, surface: Surface, nx: int, ny: int, nz: int, resolution: float, decay: str, frame: Frame = Frame(), name: str = "grid", **decay_options: float) -> DataFrame:
    own = columns(spark, nx, ny, resolution, resolution, frame)
    return shape(own, surface, F.col("k") * float(resolution), nz, name, decay, **({"length": nz * resolution} | decay_options))


def check_labels(columns_: Sequence[str]) -> None:
    if taken := sorted(set(columns_) & RESERVED):
        raise ValueError(f"labels {taken} have reserved names")


def borehole(sites: DataFrame, surface: Surface, depth: float, resolution: float, labels: Sequence[str] = (), name: str = "grid") -> DataFrame:
    """A column for each row of sites (i, x, y, labels)."""
    check_labels(labels)
    if depth < resolution:
        raise ValueError("depth must be at least one vertical step")
    return hang(sites.select("i", F.lit(0).cast("long").alias("j"), "x", "y", *labels), surface, depth, resolution, name)


def scattered(points: DataFrame, surface: Surface, name: str = "grid") -> DataFrame:
    """points (i, x, y, z, labels) as one-level columns; those above ground are set onto it."""
    lifted = surface(points, "_s").withColumn("z", F.greatest("z", "_s"))
    return lifted.withColumns({"grid": F.lit(name), "j": F.lit(0).cast("long"), "k": F.lit(0).cast("long"), "depth": F.col("z") - F.col("_s"), "nominal_depth": F.col("z") - F.col("_s")}).drop("_s")


def at_depth(points: DataFrame, depth: float) -> DataFrame:
    """One row for each column, at a fixed depth below the topography: from the column's first level."""
    first = points.groupBy("grid", "i", "j").agg(F.min(F.struct("k", *(c for c in points.columns if c not in ("grid", "i", "j", "k")))).alias("_p"))
    own = first.select("grid", "i", "j", *(F.col(f"_p.{c}").alias(c) for c in points.columns if c not in ("grid", "i", "j")))
    return own.withColumn("z", F.col("z") - (F.col("depth") - F.lit(float(depth)))).withColumn("depth", F.lit(float(depth))).select(*points.columns)


def folded_levels(spark: SparkSession, lowest: float, highest: float, levels: Sequence[float], decay: str, **options: float) -> DataFrame:
    """(surface, level) where the next level isn't deeper, over sampled surfaces: none means that no levels cross."""
    n = SURFACE_SAMPLES - 1
    samples = spark.range(n + 1).select((F.lit(float(lowest)) + F.col("id") * ((highest - lowest) / n)).alias("surface"))
    z = lambda a: numeric.terrain(a, F.col("surface"), numeric.decay_weight(decay, a, F.col("surface"), **options))[0]
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(levels, levels[1:])))
    return samples.withColumn("_p", F.explode(pairs)).filter(z(F.col("_p.b")) - z(F.col("_p.a")) <= 0).select("surface", F.col("_p.a").alias("level"))


def check_folds(spark: SparkSession, lowest: float, highest: float, levels: Sequence[float], decay: str, **options: float) -> None:
    """Raises where levels cross over surfaces from lowest to highest."""
    if found := folded_levels(spark, lowest, highest, levels, decay, **options).orderBy("level").limit(3).collect():
        raise ValueError(f"levels fold over at nominal depths {[r['level'] for r in found]}: a longer decay keeps them apart")


def solver_coordinate(solver: str) -> Column:
    if solver not in ("physical", "nominal"):
        raise ValueError(f"a solver takes physical or nominal coordinates, not {solver!r}")
    return F.col("z") if solver == "physical" else F.col("nominal_depth")


def fence(values: DataFrame, samples: DataFrame, fields: Sequence[str], shape_: tuple[int, int]) -> DataFrame:
    """samples (s, fi, fj: fractional column numbers) with bilinear fields at each level k of a structured output."""
    ni, nj = shape_
    i0 = F.greatest(F.least(F.floor("fi"), F.lit(ni - 2)), F.lit(0))
    j0 = F.greatest(F.least(F.floor("fj"), F.lit(nj - 2)), F.lit(0))
    own = samples.withColumns({"_i": i0, "_j": j0}).withColumns({"_u": F.col("fi") - F.col("_i"), "_v": F.col("fj") - F.col("_j")})
    corner = F.explode(F.array(*(F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v"))).alias("w")) for a in (0, 1) for b in (0, 1))))
    spread = own.withColumn("_c", corner).select(*samples.columns, "_c.i", "_c.j", "_c.w").filter("w <> 0")
    return spread.join(values, ["i", "j"]).groupBy(*samples.columns, "k").agg(*(F.sum(F.col("w") * F.col(f)).alias(f) for f in fields))
