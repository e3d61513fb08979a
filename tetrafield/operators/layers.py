"""Layers: an ordered chain of transforms over a model query.

A layer answers several priority ranges at once: `layer(points, ranges)` returns points with one struct of the six
components for each range. So one set of hits serves every range that a chain asks for, and only samples at other positions
(a column's surface, a taper's base, sub-samples of a span) need a further join. Points are rows keyed by grid, i, j, k.
"""

from __future__ import annotations

import graphlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra, numeric
from ..schema import ALL, BASINS, COMPONENTS, TOMOGRAPHY, ModelRange, quality
from . import coastline as coast
from . import grids, locate

KEYS = ("grid", "i", "j", "k")
COLUMN = ("grid", "i", "j")


def q_of(r: ModelRange) -> str:
    return f"q_{r.lo}_{r.hi}"


class Layer:
    """What stands below is `below`; requires and provides name point columns."""

    requires: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()

    def __init__(self, below: Layer | None = None):
        self.below = below

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        if self.below is None:
            raise RuntimeError("no layer below answers; a chain ends with a layer that needs none, such as query")
        return self.below(points, ranges)


class Query(Layer):
    """The models themselves; a point that none holds has six zeros."""

    def __init__(self, index: locate.Index):
        super().__init__()
        self.index = index

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        asked = ModelRange(min(r.lo for r in ranges), max(r.hi for r in ranges))
        found = locate.gathered(points, self.index, asked)
        for r in ranges:
            found = locate.refold(found, r, q_of(r))
        return found.drop("hits")


class Constant(Layer):
    """The same sample everywhere."""

    def __init__(self, **values: float):
        super().__init__()
        self.values = values

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        return points.withColumns({q_of(r): quality(**self.values) for r in ranges})


class Functional(Layer):
    """A function of (points with the struct "q", range) over what stands below, or without it."""

    def __init__(self, function: Callable[..., DataFrame], below: Layer | None = None, **options):
        super().__init__(below)
        self.function, self.options = function, options

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        out = self.below(points, ranges) if self.below is not None else points
        for r in ranges:
            made = self.function(out.withColumn("q", F.col(q_of(r))) if self.below is not None else out, r, **self.options)
            out = made.withColumn(q_of(r), F.col("q")).drop("q")
        return out


def functional(function: Callable[..., DataFrame]) -> Callable[..., Functional]:
    """Makes a layer type of a function."""
    return lambda below=None, **options: Functional(function, below, **options)


class Counting(Layer):
    """Counts calls, for tests."""

    def __init__(self, below: Layer):
        super().__init__(below)
        self.calls: list[tuple[ModelRange, ...]] = []

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        self.calls.append(tuple(ranges))
        return self.below(points, ranges)


class Recording(Layer):
    """Keeps the points that each call asks about, for tests."""

    def __init__(self, below: Layer):
        super().__init__(below)
        self.asked: list[DataFrame] = []

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        self.asked.append(points)
        return self.below(points, ranges)


class Coastline(Layer):
    """Adds the signed distance, worked out once for each column."""

    provides = ("coastline",)

    def __init__(self, below: Layer, lines: DataFrame):
        super().__init__(below)
        self.lines, self.extent = lines, coast.extent(lines)

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        return self.below(coast.signed_distance(points, self.lines, self.extent), ranges)


class Ely(Layer):
    """The taper from a site velocity to the tomography at depth_t, on land; basins stay on top of it."""

    requires = ("coastline",)

    def __init__(self, below: Layer, vs30: Callable[[DataFrame, str], DataFrame], depth_t: float = 450.0):
        super().__init__(below)
        if depth_t <= 0:
            raise ValueError("depth_t must be positive")
        self.vs30, self.depth_t = vs30, float(depth_t)

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        tapered = [r for r in ranges if r != BASINS]
        if not tapered:
            return self.below(points, ranges)
        needed = [TOMOGRAPHY] + ([BASINS] if any(r != TOMOGRAPHY for r in ranges) else [])
        out = self.below(points, needed)
        base = self.below(grids.at_depth(points, self.depth_t), [TOMOGRAPHY])
        base = self.vs30(base, "_vs30").select(*COLUMN, "_vs30", F.col(q_of(TOMOGRAPHY))["vp"].alias("_vp_t"), F.col(q_of(TOMOGRAPHY))["vs"].alias("_vs_t"))
        out = out.join(base, list(COLUMN))
        site = numeric.not_nan(F.col("_vs30"))
        mask = (F.col("depth") < self.depth_t) & (F.col("coastline") <= 1e-6) & site.isNotNull()
        profile = numeric.ely_profile(F.least("depth", F.lit(self.depth_t)), site, F.col("_vp_t"), F.col("_vs_t"), self.depth_t)
        ground = algebra.blend_where(F.coalesce(mask, F.lit(False)), profile, F.col(q_of(TOMOGRAPHY)))
        out = out.withColumn("_ground", ground)
        made = {q_of(r): F.col("_ground") if r == TOMOGRAPHY else F.col(q_of(BASINS)) if r == BASINS else algebra.over(F.col(q_of(BASINS)), F.col("_ground")) for r in ranges}
        return out.select(*points.columns, *(v.alias(k) for k, v in made.items()))


@dataclass(frozen=True)
class OffshoreLayer:
    bottom_depth: float
    rho: float
    vp: float
    vs: float
    qp: float
    qs: float
    alpha: float = 1.0

    def __post_init__(self):
        if self.vp <= self.vs or not 0 <= self.alpha <= 1 or min(self.rho, self.vp, self.bottom_depth) <= 0:
            raise ValueError("an offshore layer needs vp > vs, positive values and an opacity between 0 and 1")


class Offshore(Layer):
    """A sediment body off the coast, whose depth follows the distance to it; basins show through where they are."""

    requires = ("coastline",)

    def __init__(self, below: Layer, basin_depth: Sequence[tuple[float, float]], model: Sequence[OffshoreLayer]):
        super().__init__(below)
        knots = sorted(basin_depth)
        self.distances, self.depths = [d for d, _ in knots], [b for _, b in knots]
        self.bottom = max(self.depths)
        layers = sorted(model, key=lambda m: m.bottom_depth)
        reach = next((n for n, m in enumerate(layers) if m.bottom_depth >= self.bottom), len(layers) - 1)
        self.layers = layers[: reach + 1]
        self.tops = [0.0, *(m.bottom_depth for m in self.layers[:-1])]

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        if all(r == TOMOGRAPHY for r in ranges):
            return self.below(points, ranges)
        out = self.below(points, list(dict.fromkeys([*ranges, BASINS])))
        top = self.below(grids.at_depth(points, 0.0), [BASINS]).select(*COLUMN, F.col(q_of(BASINS))["alpha"].alias("_footprint"))
        out = out.join(top, list(COLUMN))
        basins, depth = F.col(q_of(BASINS)), F.col("depth")
        limit = numeric.interpolate(F.col("coastline"), self.distances, self.depths)
        # a column that a basin fills at the surface is left as it is
        filled = F.abs(F.col("_footprint") - 1) <= 1e-8 + 1e-5
        mask = (depth < self.bottom) & (F.col("coastline") > 0) & (depth < limit) & ~filled
        faded = numeric.clip(F.col("_footprint") - basins["alpha"], 0, 1)
        part = {c: numeric.step(depth, self.tops, [getattr(m, c) for m in self.layers]) for c in COMPONENTS}
        body = F.struct(*((part[c] * (1 - faded) if c == "alpha" else part[c]).alias(c) for c in COMPONENTS))
        made = {q_of(r): F.col(q_of(r)) if r == TOMOGRAPHY else F.when(F.coalesce(mask, F.lit(False)), algebra.over(basins, algebra.over(body, F.col(q_of(r))))).otherwise(F.col(q_of(r))) for r in ranges}
        return out.select(*points.columns, *(v.alias(k) for k, v in made.items()))


@dataclass(frozen=True)
class Bound:
    """A component's bounds: constants, multiples of another component, and floors that hold from a depth or elevation down."""

    min: float | None = None
    max: float | None = None
    min_ref: str | None = None
    max_ref: str | None = None
    floors: tuple[tuple[str, float, float], ...] = ()  # (depth or elevation, threshold, least value)

    def __post_init__(self):
        if any(k not in ("depth", "elevation") for k, _, _ in self.floors) or any(k == "depth" and t < 0 for k, t, _ in self.floors):
            raise ValueError("a floor holds from a depth of 0 or more, or from an elevation")
        if (self.min_ref and self.min is None) or (self.max_ref and self.max is None):
            raise ValueError("a reference needs a multiplier")
        if self.min is not None and self.max is not None and not (self.min_ref or self.max_ref) and not 0 < self.min <= self.max:
            raise ValueError("0 < min <= max")
        if self.max is not None and not self.max_ref and any(m > self.max for _, _, m in self.floors):
            raise ValueError("a floor above the maximum")

    def columns(self, q: dict[str, Column]) -> tuple[Column | None, Column | None]:
        def side(value: float | None, ref: str | None) -> Column | None:
            return None if value is None else F.lit(float(value)) * q[ref] if ref else F.lit(float(value))

        low = side(self.min, self.min_ref)
        for kind, key in (("depth", "depth"), ("elevation", "z")):
            steps = sorted((t, m) for k, t, m in self.floors if k == kind)
            if steps:
                run, made = None, F.lit(None).cast("double")
                for t, m in steps:  # the tightest of those that hold
                    run = m if run is None else max(run, m)
                    made = F.when(F.col(key) >= t, F.lit(float(run))).otherwise(made)
                low = F.coalesce(F.greatest(low, made), made, low) if low is not None else made
        return low, side(self.max, self.max_ref)


def _clipped(value: Column, low: Column | None, high: Column | None) -> Column:
    out = value if low is None else F.when(low.isNotNull(), F.greatest(value, low)).otherwise(value)
    return out if high is None else F.least(out, high)


class Clamp(Layer):
    """Bounds on components. A moved vs takes vp and density with it; then the ratio of vp to vs; then the other components, references first."""

    def __init__(self, below: Layer, clamps: dict[str, Bound], min_vp_vs_ratio: float | None = None, max_vp_vs_ratio: float | None = None):
        super().__init__(below)
        self.clamps, self.ratios = clamps, (min_vp_vs_ratio, max_vp_vs_ratio)
        graph = {c: {r for r in (b.min_ref, b.max_ref) if r} for c, b in clamps.items()}
        self.order = [c for c in graphlib.TopologicalSorter(graph).static_order() if c in clamps and c != "vs"]

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        out = self.below(points, ranges)
        for r in ranges:
            out = self._clamp(out.withColumns({f"_{c}": F.col(q_of(r))[c] for c in COMPONENTS})).withColumn(q_of(r), F.struct(*(F.col(f"_{c}").alias(c) for c in COMPONENTS)))
        return out.drop(*(f"_{c}" for c in COMPONENTS))

    def _clamp(self, rows: DataFrame) -> DataFrame:
        own = {c: F.col(f"_{c}") for c in COMPONENTS}
        if "vs" in self.clamps:
            rows = rows.withColumn("_new", _clipped(own["vs"], *self.clamps["vs"].columns(own)))
            moved = F.col("_new") != own["vs"]
            rows = rows.withColumn("_vp", F.when(moved, numeric.vp_of_vs(F.col("_new"))).otherwise(own["vp"])).withColumn("_rho", F.when(moved, numeric.rho_of_vp(F.col("_vp"))).otherwise(own["rho"])).withColumn("_vs", F.col("_new")).drop("_new")
        low, high = self.ratios
        if low or high:
            guarded = _clipped(own["vp"], F.lit(float(low)) * own["vs"] if low else None, F.lit(float(high)) * own["vs"] if high else None)
            rows = rows.withColumn("_new", guarded)
            rows = rows.withColumn("_rho", F.when(F.col("_new") != own["vp"], numeric.rho_of_vp(F.col("_new"))).otherwise(own["rho"])).withColumn("_vp", F.col("_new")).drop("_new")
        for c in self.order:
            rows = rows.withColumn(f"_{c}", _clipped(own[c], *self.clamps[c].columns(own)))
        return rows


class Backus(Layer):
    """Long-wavelength averages over each node's span, from `samples` samples of what stands below, weighted by opacity.

    A span reaches half-way to the neighbours. At the top of a block the free surface cuts it off, or with
    mirror=True (a block below another) the interface mirrors it; a column of one level keeps its point's value.
    """

    def __init__(self, below: Layer, samples: int, mirror: bool = False):
        super().__init__(below)
        if samples < 1:
            raise ValueError("samples must be positive")
        self.samples, self.mirror = samples, mirror

    def __call__(self, points: DataFrame, ranges: Sequence[ModelRange] = (ALL,)) -> DataFrame:
        order = Window.partitionBy(*COLUMN).orderBy("k")
        z, above, under = F.col("z"), F.lag("z").over(order), F.lead("z").over(order)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = points.withColumns({"_above": above, "_under": under, "_ground": F.first(z - F.col("depth")).over(whole)})
        up, down = (F.col("_above") + z) / 2, (z + F.col("_under")) / 2
        first = (2 * z - down) if self.mirror else z
        own = own.withColumn("_up", F.when(F.col("_above").isNull() & F.col("_under").isNull(), z).when(F.col("_above").isNull(), first).otherwise(up))
        own = own.withColumn("_down", F.when(F.col("_above").isNull() & F.col("_under").isNull(), z).when(F.col("_under").isNull(), 2 * z - F.col("_up")).otherwise(down))
        spread = own.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(self.samples - 1))))
        at = F.col("_up") + (F.col("_m") + 0.5) / self.samples * (F.col("_down") - F.col("_up"))
        rest = [c for c in points.columns if c not in ("z", "depth")]
        sampled = spread.select(*rest, F.col("z").alias("_z"), F.col("depth").alias("_depth"), "_m", at.alias("z"), (at - F.col("_ground")).alias("depth"))
        got = self.below(sampled, ranges)
        sums = []
        for r in ranges:
            q = F.col(q_of(r))
            inverse = lambda v: F.try_divide(F.lit(1.0), q["rho"] * v * v)  # noqa: B023, E731
            m, mu = inverse(q["vp"]), inverse(q["vs"])
            terms = {"w": q["alpha"], "rho": q["alpha"] * q["rho"], "m": q["alpha"] * m, "mu": q["alpha"] * mu, "mq": F.try_divide(q["alpha"] * m, q["qp"]), "muq": F.try_divide(q["alpha"] * mu, q["qs"])}
            # a sample without opacity has no part, whatever its values; a compliance without bound makes the average velocity 0
            sums += [F.sum(F.when(q["alpha"] == 0, F.lit(0.0)).otherwise(F.coalesce(t, F.lit(float("inf"))))).alias(f"_{n}_{q_of(r)}") for n, t in terms.items()]
        grouped = got.groupBy(*rest, "_z", "_depth").agg(*sums)
        out = []
        for r in ranges:
            w, rho, m, mu, mq, muq = (F.col(f"_{n}_{q_of(r)}") for n in ("w", "rho", "m", "mu", "mq", "muq"))
            covered = w > 0
            value = lambda c: F.when(covered, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))  # noqa: B023, E731
            parts = {"rho": value(F.try_divide(rho, w)), "vp": value(F.try_divide(w, F.sqrt(m * rho))), "vs": value(F.try_divide(w, F.sqrt(mu * rho))), "qp": value(F.try_divide(m, mq)), "qs": value(F.try_divide(mu, muq)), "alpha": w / self.samples}
            out.append(F.struct(*(parts[c].alias(c) for c in COMPONENTS)).alias(q_of(r)))
        named = {"z": F.col("_z"), "depth": F.col("_depth")}
        return grouped.select(*(named.get(c, F.col(c)).alias(c) for c in points.columns), *out)


@dataclass
class Chain:
    """Layer makers, outermost first; the last one needs nothing below."""

    makers: list[Callable[..., Layer]] = field(default_factory=list)

    def build(self) -> Layer:
        below: Layer = Layer()
        for make in reversed(self.makers):
            below = make(below)
        return below


def check_order(layers: Sequence[type[Layer] | Layer]) -> None:
    """Raises where a layer requires a column that none further out provides."""
    provided: set[str] = set()
    for layer in layers:
        if lacking := set(layer.requires) - provided:
            raise ValueError(f"{getattr(layer, '__name__', type(layer).__name__)} requires {sorted(lacking)}, which no layer before it provides")
        provided |= set(layer.provides)


def evaluate(chain: Layer, points: DataFrame, models: ModelRange = ALL) -> DataFrame:
    """points with the six components as flat columns."""
    made = chain(points, [models])
    q = F.col(q_of(models))
    return made.select(*points.columns, *(q[c].alias(c) for c in COMPONENTS))


def discover(folder: str | Path, globs: Sequence[str] = ("*.parquet",)) -> list[Path]:
    """Files below a folder that match any pattern, each once and sorted; none is an error."""
    found = sorted({p for g in globs for p in Path(folder).rglob(g)})
    if not found:
        raise FileNotFoundError(f"no model below {folder} matches {list(globs)}")
    return found


def prune(models: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Models whose bounds meet a rectangle; those without bounds stay."""
    apart = (F.col("maxx") < x[0]) | (F.col("minx") > x[1]) | (F.col("maxy") < y[0]) | (F.col("miny") > y[1])
    return models.filter(~F.coalesce(apart, F.lit(False)))
