"""Smoothing bands: basins' outlines grown over the water, and opacity that fades across the band.

Outlines are rings (basin, n, x, y) as in `basins`; land is rings (ring, n, x, y), of which a place is on land if an odd number of
crossings lies east of it, so that lakes are water. Everything is rows: distances reach from pieces of lines to the nodes of a lattice
around them, the grown outline is the contour of these distances, and its pieces are put in order by doubling jumps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.formats import scratch
from . import basins, coastline, meshes

NEAR = 2.0  # steps of the lattice, more than a cell's diagonal: how far a contour's cell has to know about a line
# The sides of a cell (bottom, right, top, left) between which a contour runs, its inside to the left, by the corners
# that are inside (1 lower left, 2 lower right, 4 upper right, 8 upper left). Opposite corners are kept apart.
TURNS = {1: "BL", 2: "RB", 3: "RL", 4: "TR", 5: "BLTR", 6: "TB", 7: "TL", 8: "LT", 9: "BT", 10: "RBLT", 11: "RT", 12: "LR", 13: "BR", 14: "LB"}


def pieces(lines: DataFrame, step: float) -> DataFrame:
    """lines (ax, ay, bx, by, ...) cut into equal pieces no longer than the step."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.ceil(F.hypot(dx, dy) / step), F.lit(1))
    others = [c for c in lines.columns if c not in ("ax", "ay", "bx", "by")]
    cut = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    ends = [(F.col(f"a{a}") + (F.col("_k") + k) / F.col("_n") * d).alias(f"{e}{a}") for e, k in (("a", 0), ("b", 1)) for a, d in (("x", dx), ("y", dy))]
    return cut.select(*others, *ends)


def odd(places: DataFrame, lines: DataFrame, band: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Distinct places (x, y, ...) east of which an odd number of lines crosses, of those that agree `on` columns; both meet on bands of y."""
    low, high = F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band)
    spread = lines.select(*on, "ax", "ay", "bx", "by", F.explode(F.sequence(low, high)).alias("_band"))
    met = places.distinct().withColumn("_band", F.floor(F.col("y") / band)).join(spread, [*on, "_band"]).filter(coastline.crosses(F.col("x"), F.col("y")))
    return met.groupBy(*places.columns).agg((F.count(F.lit(1)) % 2).alias("_odd")).filter("_odd = 1").drop("_odd")


def land_lines(land: DataFrame) -> DataFrame:
    """Segments of all rings of land."""
    return basins.outline_segments(land.withColumnRenamed("ring", "basin")).select("ax", "ay", "bx", "by")


def reaches(lines: DataFrame, step: float, radius: float, name: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, ix, iy, name): the lattice's nodes no farther than the radius from lines no longer than the step, with the least distance."""
    spread = lines
    for a in "xy":
        low, high = F.floor((F.least(f"a{a}", f"b{a}") - radius) / step), F.ceil((F.greatest(f"a{a}", f"b{a}") + radius) / step)
        spread = spread.withColumn(f"i{a}", F.explode(F.sequence(low, high)))
    far = F.sqrt(coastline.squared_distance(F.col("ix") * step, F.col("iy") * step))
    return spread.withColumn(name, far).filter(F.col(name) <= radius).groupBy(*on, "ix", "iy").agg(F.min(name).alias(name))


def field(outlines: DataFrame, land: DataFrame | None, metres: float, step: float) -> DataFrame:
    """(basin, ix, iy, f): nodes near the border of basin and band together, f negative inside and about the distance to that border."""
    rings = basins.outline_segments(outlines).select("basin", "ax", "ay", "bx", "by")
    edge = pieces(rings, step)
    sources, coast = edge, None
    if land is not None:
        coast = land_lines(land)
        half = [((F.col(f"a{a}") + F.col(f"b{a}")) / 2).alias(a) for a in "xy"]
        middle = edge.select("*", *half)
        sea = middle.join(odd(middle.select("x", "y"), coast, step), ["x", "y"], "left_anti").select(*edge.columns)
        # where the water of a basin ends at a shore inside of it, the band is told from that shore
        shores = pieces(coast, step).select("*", *half)
        sources = sea.unionByName(basins.within(shores, outlines, step).select(*edge.columns))
    near, water = reaches(edge, step, NEAR * step, "near", ("basin",)), reaches(sources, step, metres + NEAR * step, "water", ("basin",))
    nodes = near.join(water, ["basin", "ix", "iy"], "full").select("*", (F.col("ix") * step).alias("x"), (F.col("iy") * step).alias("y"))
    own = ["basin", "ix", "iy"]
    held = odd(nodes.select(*own, "x", "y"), rings, step, ("basin",)).select(*own, F.lit(-1.0).alias("_in"))
    known = nodes.join(held, own, "left")
    inner = F.coalesce("_in", F.lit(1.0)) * F.coalesce("near", F.lit(NEAR * step))
    band = F.coalesce("water", F.lit(metres + NEAR * step)) - metres
    if coast is not None:
        ground = odd(nodes.select("ix", "iy", "x", "y"), coast, step).select("ix", "iy", F.lit(1.0).alias("_land"))
        known = known.join(ground, ["ix", "iy"], "left").join(reaches(pieces(coast, step), step, NEAR * step, "shore"), ["ix", "iy"], "left")
        band = F.greatest(band, F.coalesce("_land", F.lit(-1.0)) * F.coalesce("shore", F.lit(NEAR * step)))
    return known.select(*own, F.least(inner, band).alias("f"))


def contour(values: DataFrame, step: float) -> DataFrame:
    """(basin, node, next, x, y): pieces of the border of f < 0, from a node on a side of a cell to the next, with the inside to the left."""
    corners = {"c00": (0, 0), "c10": (1, 0), "c01": (0, 1), "c11": (1, 1)}
    of = F.array(*(F.struct(F.lit(c).alias("c"), (F.col("ix") - i).alias("ix"), (F.col("iy") - j).alias("iy")) for c, (i, j) in corners.items()))
    shared = values.select("basin", "f", F.explode(of).alias("s")).select("basin", "s.*", "f")
    cells = shared.groupBy("basin", "ix", "iy").agg(*(F.max(F.when(F.col("c") == c, F.col("f"))).alias(c) for c in corners)).dropna(subset=list(corners))
    x, y = F.col("ix"), F.col("iy")

    def side(across: bool, i: int, j: int, first: str, last: str) -> Column:
        """A side's number and the place where f is 0 on it; the cell beyond works out the same."""
        t = F.col(first) / (F.col(first) - F.col(last))
        px, py = (x + i + (t if across else F.lit(0.0))) * step, (y + j + (F.lit(0.0) if across else t)) * step
        return F.struct(F.struct(F.lit(int(across)).alias("d"), (x + i).alias("i"), (y + j).alias("j")).alias("node"), px.alias("x"), py.alias("y"))

    sides = {"B": side(True, 0, 0, "c00", "c10"), "R": side(False, 1, 0, "c10", "c11"), "T": side(True, 0, 1, "c01", "c11"), "L": side(False, 0, 0, "c00", "c01")}
    case = sum(((F.col(c) < 0).cast("int") * bit for c, bit in (("c00", 1), ("c10", 2), ("c11", 4), ("c01", 8))), F.lit(0))
    runs = F.lit(None)
    for inside, way in TURNS.items():
        runs = F.when(F.col("_case") == inside, F.array(*(F.struct(sides[a].alias("a"), sides[b]["node"].alias("b")) for a, b in zip(way[::2], way[1::2], strict=True)))).otherwise(runs)
    turned = cells.withColumn("_case", case).filter("_case NOT IN (0, 15)").select("basin", F.explode(runs).alias("r"))
    return turned.select("basin", F.col("r.a.node").alias("node"), F.col("r.b").alias("next"), F.col("r.a.x").alias("x"), F.col("r.a.y").alias("y"))


def _kept(rows: DataFrame) -> DataFrame:
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(rows.sparkSession, "bands"))
    return rows.checkpoint()


def rings(parts: DataFrame) -> DataFrame:
    """(basin, ring, n, x, y) of a contour's pieces: each node learns the least node of its ring and how far on it is, in jumps twice as long each time."""
    parts = _kept(parts)
    most = parts.groupBy("basin").count().agg(F.max("count")).first()[0] or 0
    state = parts.select("basin", "node", F.col("next").alias("jump"), F.struct(F.col("node").alias("to"), F.lit(0).cast("long").alias("far")).alias("least"))
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        beyond = state.select("basin", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.struct(F.col("least.to").alias("to"), (F.col("least.far") + 2**k).alias("far")).alias("_least"))
        state = _kept(state.join(beyond, ["basin", "jump"]).select("basin", "node", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least")))
    first = F.when(F.col("least.far") == 0, F.lit(-(2**62))).otherwise(-F.col("least.far"))
    return parts.join(state, ["basin", "node"]).select("basin", F.col("least.to").alias("ring"), first.alias("n"), "x", "y")


def grown(outlines: DataFrame, metres: float, step: float, land: DataFrame | None = None) -> DataFrame:
    """Outlines (basin, n, x, y) of basins with a band of water around the part of them that is water, all around without land.

    The border is met within about a step of the lattice, corners are rounded. Of the pieces that land cuts apart the largest stays, which
    is the one that holds the basin; islands and lakes inside of it are covered. A basin narrower than two steps may be lost: with a
    step too coarse for a basin there is an error.
    """
    if not (metres > 0 and step > 0 and metres >= step):
        raise ValueError("a band is as wide as a step at least")
    found = rings(contour(field(outlines, land, metres, step), step))
    alone = F.struct("basin", "ring")
    sizes = basins.areas(found.select(alone.alias("basin"), "n", "x", "y"))
    largest = sizes.filter("area > 0").groupBy("basin.basin").agg(F.max_by("basin.ring", "area").alias("ring"))
    made = _kept(basins.cleaned(found.join(largest, ["basin", "ring"]).select("basin", "n", "x", "y")))
    lost = outlines.select("basin").distinct().join(made, "basin", "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"basins without a border at a step of {step}: {sorted(str(r[0]) for r in lost)}")
    return made


def opacity(places: DataFrame, outlines: DataFrame, metres: float, name: str = "alpha") -> DataFrame:
    """places (basin, x, y, ...) with their opacity: 1 inside their basin's outline, falling to 0 at the band's width from it."""
    lines = basins.outline_segments(outlines).select("basin", "ax", "ay", "bx", "by")
    cell = {a: F.floor(F.col(a) / metres) for a in "xy"}
    own = places.select("basin", "x", "y").distinct()
    spread = pieces(lines, metres)
    for a in "xy":
        spread = spread.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.least(f"a{a}", f"b{a}") / metres) - 1, F.floor(F.greatest(f"a{a}", f"b{a}") / metres) + 1)))
    met = own.withColumns({f"_{a}": c for a, c in cell.items()}).join(spread, ["basin", "_x", "_y"])
    near = met.groupBy("basin", "x", "y").agg(F.sqrt(F.min(coastline.squared_distance(F.col("x"), F.col("y")))).alias("_far"))
    held = odd(own, lines, metres, ("basin",)).withColumn("_in", F.lit(True))
    faded = meshes.fade(F.coalesce("_far", F.lit(float(metres))), metres)
    told = own.join(near, ["basin", "x", "y"], "left").join(held, ["basin", "x", "y"], "left")
    return places.join(told.select("basin", "x", "y", F.when(F.col("_in"), 1.0).otherwise(faded).alias(name)), ["basin", "x", "y"], "left")
