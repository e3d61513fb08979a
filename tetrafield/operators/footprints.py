"""Where models lie, seen from above: how far each reaches in sixteen directions, found in one pass over its vertices and kept with it.

The lines at these distances enclose a convex polygon around the model, and each of them touches it. A domain, turned or not,
misses the model if some line parts the two polygons: that of a direction, or of a side of the domain (the separating-axis test).
The test is exact for the polygons, so no model that meets the domain is left out; models in the polygon's corners may stay
needlessly. Models without a footprint stay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = 16
PAD = 0.01  # metres that footprints reach further, for rounding
Outline = Sequence[tuple[float, float]]

_TURNS = [(math.cos(2 * math.pi * k / DIRECTIONS), math.sin(2 * math.pi * k / DIRECTIONS)) for k in range(DIRECTIONS)]


def footprints(vertices: DataFrame, pad: float = PAD) -> DataFrame:
    """(model_id, footprint) of vertices (model_id, x, y, ...): partial maxima go over the shuffle, not vertices."""
    reach = F.array(*(F.max(F.col("x") * c + F.col("y") * s) + pad for c, s in _TURNS))
    return vertices.groupBy("model_id").agg(reach.alias("footprint"))


def corners(footprint: Column) -> list[tuple[Column, Column]]:
    """Where lines of neighbouring directions cross."""
    out, across = [], math.sin(2 * math.pi / DIRECTIONS)
    for k, (c, s) in enumerate(_TURNS):
        n = (k + 1) % DIRECTIONS
        h, g, (d, t) = footprint[k], footprint[n], _TURNS[n]
        out.append(((h * t - g * s) / across, (g * c - h * d) / across))
    return out


def meets(footprint: Column, outline: Outline) -> Column:
    """Whether the polygon and a convex outline (corners in either order; a line or a point will do) have a point in common."""
    apart = F.lit(False)
    for k, (c, s) in enumerate(_TURNS):
        apart |= footprint[k] < min(x * c + y * s for x, y in outline)
    own = corners(footprint)
    for (ax, ay), (bx, by) in zip(outline, [*outline[1:], outline[0]], strict=True):
        if (length := math.hypot(bx - ax, by - ay)) == 0:
            continue
        for u, v in (((by - ay) / length, (ax - bx) / length), ((ay - by) / length, (bx - ax) / length)):
            apart |= F.least(*(x * u + y * v for x, y in own)) > max(x * u + y * v for x, y in outline)
    return ~F.coalesce(apart, F.lit(False))


def prune(models: DataFrame, outline: Outline) -> DataFrame:
    """models (footprint, ...) that may meet the outline."""
    return models.filter(meets(F.col("footprint"), outline))
