"""Interpolation, polynomials, bounds, bits and empirical relations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Brocher's relations in m/s and kg/m3, highest power first, in single precision: fixed values.
VP_OF_VS = tuple(float(np.float32(c)) for c in (-2.51e-11, 2.683e-07, -0.0008206, 2.0947, 940.9))
RHO_OF_VP = tuple(float(np.float32(c)) for c in (1.06e-16, -4.3e-12, 6.71e-08, -0.0004721, 1.6612, 0.0))


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def vp_of_vs(vs: Column) -> Column:
    return polynomial(VP_OF_VS, vs)


def rho_of_vp(vp: Column) -> Column:
    return polynomial(RHO_OF_VP, vp)


def not_nan(c: Column) -> Column:
    """NaN is no data: NULL inside the engine."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip(value: Column, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """NULL stays NULL; where lo > hi, hi wins."""
    out = value
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(value.isNotNull(), out)


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear between knots in rising order, level beyond the first and last."""
    if len(xs) != len(ys) or not xs or any(b < a for a, b in zip(xs, xs[1:])):
        raise ValueError("knots must rise and have one value each")
    out = F.when(x.isNull(), F.lit(None)).when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        if x1 > x0:
            out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(ys[-1])))


def step(x: Column, tops: Sequence[float], values: Sequence) -> Column:
    """The value of the last top at or above x (as-of, backward); x above the first top takes the first."""
    out = F.when(x.isNull(), F.lit(None))
    for top, value in reversed(list(zip(tops, values, strict=True))[1:]):
        out = out.when(x >= top, value if isinstance(value, Column) else F.lit(float(value)))
    first = values[0]
    return out.otherwise(first if isinstance(first, Column) else F.lit(float(first)))


def layer_of(depth: Column, layers: Column) -> Column:
    """The struct of an array ordered by `top` that holds a depth; a boundary belongs to the deeper one, the first opens upward."""
    below = F.filter(F.slice(layers, 2, F.size(layers)), lambda s: s["top"] <= depth)
    return F.element_at(layers, 1 + F.size(below))


def spread_bits(c: Column) -> Column:
    """The low 21 bits with two zeros between each. Shifts and masks are the customary ones: fixed values."""
    x = c.cast("long").bitwiseAND(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def morton(i: Column, j: Column, k: Column) -> Column:
    """Z-order key of three cell numbers, a layout hint."""
    return spread_bits(i).bitwiseOR(F.shiftleft(spread_bits(j), 1)).bitwiseOR(F.shiftleft(spread_bits(k), 2))


def affine(matrix: Sequence[Sequence[float]], *coordinates: Column) -> list[Column]:
    """Rows of an affine map (n rows of n + 1 numbers) applied to n columns."""
    n = len(coordinates)
    return [reduce(lambda acc, t: acc + t, [F.lit(float(row[i])) * coordinates[i] for i in range(n)], F.lit(float(row[n]))) for row in matrix[:n]]


def translate(*by: float) -> np.ndarray:
    m = np.eye(len(by) + 1)
    m[:-1, -1] = by
    return m


def scale(*by: float) -> np.ndarray:
    return np.diag([*by, 1.0])


def rotate(degrees: float) -> np.ndarray:
    """Anticlockwise in the plane."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return np.array([[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]])


def reflect_x(dims: int = 2) -> np.ndarray:
    return scale(-1.0, *[1.0] * (dims - 1))


def model_frame(x: float, y: float, degrees: float, reflect: bool = False, unit: float = 1000.0) -> np.ndarray:
    """The 4 x 4 map from metres in the world to a model's frame: its origin, its unit, a mirrored x axis and a turn about the vertical."""
    turn = np.eye(4)
    turn[:2, :2] = rotate(degrees)[:2, :2]
    mirrored = reflect_x(3) if reflect else np.eye(4)
    return turn @ mirrored @ scale(*[1 / unit] * 3) @ translate(-x, -y, 0.0)


def decay_weight(kind: str, level: Column, surface: Column, **p: float) -> Column:
    """How much of the surface's shape is left at a nominal depth: squashed, linear, tapered or sleve."""
    if kind == "squashed":
        return F.lit(1.0)
    if kind == "linear":
        return clip(1 - level / p["length"], 0, 1)
    if kind == "tapered":
        height = -surface
        return F.when(height > 0, clip(1 - level / (p.get("ratio", 1.0) * F.when(height > 0, height).otherwise(1.0)), 0, 1)).otherwise(F.lit(1.0))
    if kind == "sleve":
        a, b = F.greatest(F.lit(float(p["length"])) - level, F.lit(0.0)) / p["scale"], F.lit(p["length"] / p["scale"])
        return F.exp(a - b) * F.expm1(-2 * a) / F.expm1(-2 * b)
    raise ValueError(f"unknown decay {kind!r}")


def terrain(level: Column, surface: Column, weight: Column) -> tuple[Column, Column]:
    """(z, depth) of a level: the surface's share of lift falls off with depth; no weight leaves exactly the level."""
    shift = F.when(weight == 0, F.lit(0.0)).otherwise(weight * surface)
    return level + shift, level + (shift - surface)


def ely_profile(depth: Column, vs30: Column, vp_t: Column, vs_t: Column, depth_t: float) -> Column:
    """The taper of Ely et al. (2010) from a Vs30 at the surface to the rock at depth_t, as a sample."""
    n = F.greatest(depth, F.lit(0.0)) / depth_t
    f = n + (n - n * n) * (2 / 3)
    g = 0.5 - 5 * n + 1.5 * n * n + 3 * F.sqrt(n)
    vs = f * vs_t + g * vs30
    vp = f * vp_t + g * vp_of_vs(vs30)
    parts = {"rho": rho_of_vp(vp), "vp": vp, "vs": vs, "qp": vs * 0.1, "qs": vs * 0.05, "alpha": F.lit(1.0)}
    return F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))
