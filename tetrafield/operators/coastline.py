"""Distance to a coastline, negative on land."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 4  # how much finer each level of the pyramid is
EVERY = 3  # levels after which the pairs are kept and what led to them is let go
FARTHEST = 2.0**50


def segments(rings: DataFrame) -> DataFrame:
    """(sid, ax, ay, bx, by) of closed rings (ring, n, x, y): each point with the next."""
    order = Window.partitionBy("ring").orderBy("n")
    pairs = rings.select("ring", "n", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"))
    return pairs.filter("bx IS NOT NULL").select(F.xxhash64("ring", "n").alias("sid"), "ax", "ay", "bx", "by")


def squared_distance(x: Column, y: Column) -> Column:
    """To the segment of the row; a segment without length is its point."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / F.when(length == 0, 1.0).otherwise(length))
    t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    ex, ey = x - (F.col("ax") + t * dx), y - (F.col("ay") + t * dy)
    return ex * ex + ey * ey


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray to the east meets the row's segment, which holds its lower end only."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rise = F.col("by") - F.col("ay")
    at = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.when(rise == 0, 1.0).otherwise(rise)
    return (low <= y) & (y < high) & (at > x)


@dataclass(frozen=True)
class Extent:
    """How many segments there are, their lower corner, the longer side of their box and their mean length."""

    count: int
    x: float
    y: float
    side: float
    mean: float


def whole(lines: DataFrame) -> DataFrame:
    """Segments whose ends are numbers."""
    return lines.filter(_number(F.col("ax")) & _number(F.col("ay")) & _number(F.col("bx")) & _number(F.col("by")))


def extent(lines: DataFrame) -> Extent:
    lines = whole(lines)
    ends = [F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")]
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    r = lines.agg(F.count(F.lit(1)).alias("n"), F.min(ends[0]).alias("x"), F.min(ends[1]).alias("y"), F.max(ends[2]).alias("hx"), F.max(ends[3]).alias("hy"), F.avg(length).alias("mean")).first()
    return Extent(r["n"], r["x"], r["y"], max(r["hx"] - r["x"], r["hy"] - r["y"]), r["mean"]) if r["n"] else Extent(0, 0.0, 0.0, 0.0, 0.0)


def signed_distance(points: DataFrame, lines: DataFrame, of: Extent | None = None, name: str = "coastline", size: float | None = None) -> DataFrame:
    """points (x, y, ...) with the distance to the nearest segment, negative where a ray to the east crosses an odd number; infinite without any segment.

    Parity is an equi-join on bands of y. The nearest segment is found down a pyramid of cells, each level STEP times finer than the one
    above: cells that hold places are paired with cells that hold segments, and a pair goes on to the finer cells inside both if its
    least possible distance isn't above the greatest possible one of the place cell's best pair. Every join is on cells. Long segments
    are cut into pieces of a cell's length, so a level lists each in proportion to its length.

    A point whose x or y is null, no number or farther than FARTHEST cells away has no distance: null.
    """
    of, lines = of or extent(lines), whole(lines)
    x, y = F.col("x"), F.col("y")
    if of.count == 0:
        return points.withColumn(name, F.when(_number(x) & _number(y), F.lit(float("inf"))))
    size = float(size or of.mean or 1.0)
    places = points.select("x", "y").filter(_number(x) & _number(y) & (F.abs((x - of.x) / size) < FARTHEST) & (F.abs((y - of.y) / size) < FARTHEST)).distinct().persist()
    bands = lines.withColumn("_band", F.explode(F.sequence(F.floor((F.least("ay", "by") - of.y) / size), F.floor((F.greatest("ay", "by") - of.y) / size))))
    odd = places.withColumn("_band", F.floor((y - of.y) / size)).join(bands, "_band").filter(crosses(x, y)).groupBy("x", "y").agg((F.count(F.lit(1)) % 2).alias("_odd"))
    found = nearest(places, lines, of, size).join(odd, ["x", "y"], "left")
    # a row for each distinct place, kept: layers ask for their points at several positions, and each asks for this again
    signed = found.select(x.alias("_x"), y.alias("_y"), (F.sqrt("_d") * F.when(F.col("_odd") == 1, -1.0).otherwise(1.0)).alias(name)).persist()
    return points.join(signed, (x == F.col("_x")) & (y == F.col("_y")), "left").select(*points.columns, name)


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def pieces(lines: DataFrame, of: Extent, size: float) -> DataFrame:
    """Segments under the leaf cells (qx, qy) that the boxes of their pieces touch: four a piece at most."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / size), F.lit(1))
    cut = lines.withColumn("_n", n).withColumn("_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    out = cut
    for a, d, origin in (("x", dx, of.x), ("y", dy, of.y)):
        ends = [F.col(f"a{a}") + (F.col("_m") + k) / F.col("_n") * d for k in (0, 1)]
        low, high = (F.floor((f(*ends) - origin) / size + pad) for f, pad in ((F.least, -1e-9), (F.greatest, 1e-9)))
        out = out.withColumn(f"q{a}", F.explode(F.sequence(low, high)))
    return out.select("qx", "qy", "ax", "ay", "bx", "by").distinct()


def nearest(places: DataFrame, lines: DataFrame, of: Extent, size: float) -> DataFrame:
    """(x, y, _d): each place's squared distance to its nearest segment."""
    x, y = F.col("x"), F.col("y")
    leaves = pieces(lines, of, size).persist()
    at = places.select("x", "y", F.floor((x - of.x) / size).alias("px"), F.floor((y - of.y) / size).alias("py"))
    levels = max(1, math.ceil(math.log(max(of.side / size, 1.0) + 2, STEP)) + 1)
    up = lambda c, n: F.floor(F.col(c) / float(STEP**n)).cast("long")

    def cells(rows: DataFrame, n: int, a: str) -> DataFrame:
        """Cells of level n that hold something, with the cell above."""
        own = rows.select(up(f"{a}x", n).alias(f"{a}x"), up(f"{a}y", n).alias(f"{a}y")).distinct()
        return own.select(f"{a}x", f"{a}y", up(f"{a}x", 1).alias(f"u{a}x"), up(f"{a}y", 1).alias(f"u{a}y"))

    # all segments lie in the top's first cell, or by padding in those before it
    top = [(i, j) for i in (-1, 0) for j in (-1, 0)]
    pairs = cells(at, levels, "p").select("px", "py", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("qx"), F.lit(j).cast("long").alias("qy")) for i, j in top))).alias("q")).select("px", "py", "q.*")
    held = None
    for n in range(levels - 1, -1, -1):
        above = pairs.select(*(F.col(c).alias(f"u{c}") for c in pairs.columns))
        both = above.join(cells(at, n, "p"), ["upx", "upy"]).join(cells(leaves, n, "q"), ["uqx", "uqy"]).select("px", "py", "qx", "qy")
        apart = [F.abs(F.col(f"p{a}") - F.col(f"q{a}")).cast("double") for a in "xy"]
        slack = 1.5 / STEP**n  # a piece may miss a corner cell of its box by so much
        low = sum((F.pow(F.greatest(d - 1, F.lit(0.0)), 2) for d in apart), F.lit(0.0))
        high = sum((F.pow(d + 1 + slack, 2) for d in apart), F.lit(0.0))
        both = both.withColumns({"_low": low, "_best": F.min(high).over(Window.partitionBy("px", "py"))})  # a place cell has few pairs
        pairs = both.filter(F.col("_low") <= F.col("_best") * (1 + 1e-9)).select("px", "py", "qx", "qy")
        if n % EVERY == 0 and levels > EVERY:
            pairs = pairs.persist()
            pairs.count()  # few rows until the last levels; what came before isn't needed any more
            if held is not None:
                held.unpersist()
            held = pairs
    # a segment under several of a place cell's cells counts once
    near = pairs.join(leaves, ["qx", "qy"]).select("px", "py", "ax", "ay", "bx", "by").distinct()
    met = at.join(near, ["px", "py"])
    return met.groupBy("x", "y").agg(F.min(squared_distance(x, y)).alias("_d"))
