"""Point location: which tetrahedra hold which points, as equi-joins on cells.

The index is a hierarchy of cell grids. Every tetrahedron stands at the level of its own box, padded by the tolerance's reach: cells are
cubes of a power of two, at least as long as the box, so it is listed under eight cells at most, whatever other sizes its mesh has. The
lattice of cells is off by half a cell, as meshes like to have their corners at round numbers. A point needs one key for each
(level, vertical) in use. A cell's rows are thin: planes and numbers. What a tetrahedron's sample needs (corners, profile, bounds) is
joined to hits only. Tetrahedra of a model with the same planes are one row with their number: a point is tested once for all of them.

Composition works on distinct places. Places are dealt out by a hash once, their hits are folded where they are, and points meet
their place's result by the same hash, so rows that repeat, and those without a hit, stay rows. The cells are broadcast only under a
bound of the index's rows; otherwise places shuffle on the cell, and AQE splits hot ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import algebra, numeric
from ..functions.algebra import let
from ..schema import ALL, COMPONENTS, DEPTH, DEPTH_PROFILE, QUALITY, ModelRange
from . import meshes

TOLERANCE = 1e-4  # of each barycentric weight
BROADCAST_ROWS = 500_000  # index rows, of about 200 bytes
BROADCAST_TETS = 200_000  # of about 350 bytes
BROADCAST_MODELS = 10_000
CELL_KEYS = ("level", "vertical", "cx", "cy", "cz")
PLACE = ("x", "y", "z", "depth")
PLANES = ("x3", "y3", "z3", *(f"m{r}{c}" for r in range(3) for c in range(3)))
PROFILE = "array<struct<top:double,rho:double,vp:double,vs:double,qp:double,qs:double>>"


@dataclass
class Index:
    """rows of (cell, tetrahedron) with the tetrahedron's planes, samples by tetrahedron, models by number; how many there are of each, and which (level, vertical) pairs occur.

    Of tetrahedra with the same planes the lowest stands in rows, with their number n; samples have all of them as twins of that one.
    """

    rows: DataFrame
    samples: DataFrame
    models: DataFrame
    count: int
    tets: int
    n_models: int
    keys: list[tuple[int, str]]

    def asked(self, models: ModelRange) -> DataFrame:
        rows = self.rows if models == ALL else self.rows.filter(models.holds(F.col("priority")))
        return F.broadcast(rows) if self.count <= BROADCAST_ROWS else rows

    def payload(self, twins: bool = False) -> tuple[DataFrame, DataFrame]:
        """(samples, models). twins: with the samples of all tetrahedra, else of those in rows."""
        samples = self.samples if twins else self.samples.filter("twin = tid")
        return (F.broadcast(samples) if self.tets <= BROADCAST_TETS else samples), (F.broadcast(self.models) if self.n_models <= BROADCAST_MODELS else self.models)


def tet_rows(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """One row for each tetrahedron: its box, corner samples, and the rows of the inverse edge matrix. Flat tetrahedra hold no point and are left out."""
    own = meshes.gather(tets, vertices)
    e0, e1, e2 = meshes.sides()
    det = meshes.determinant()
    rows = [meshes.cross(e1, e2), meshes.cross(e2, e0), meshes.cross(e0, e1)]
    inverse = {f"m{r}{c}": rows[r][c] / F.col("det") for r in range(3) for c in range(3)}
    own = own.withColumn("det", det).filter("det <> 0").withColumns(inverse)
    boxes = {f"{n}_{a}": f(*(F.col(f"c{k}")[a] for k in range(4))) for f, n in ((F.least, "lo"), (F.greatest, "hi")) for a in "xyz"}
    corners = [F.struct(*(F.col(f"c{n}")[c].alias(c) for c in COMPONENTS)).alias(f"q{n}") for n in range(4)]
    return own.withColumns(boxes).select("model_id", "tid", *(F.col("c3")[a].alias(f"{a}3") for a in "xyz"), *inverse, *boxes, *corners)


def build_index(models: DataFrame, vertices: DataFrame, tets: DataFrame) -> Index:
    """The index of all models; `models` may lack bounds and profile."""
    if "minx" not in models.columns:
        models = models.join(meshes.bounds(vertices, 0.01), "model_id")
    if "profile" not in models.columns:
        models = models.withColumn("profile", F.lit(None).cast(PROFILE))
    models = models.persist()
    n_models = models.count()
    own = tet_rows(vertices, tets)
    catalog = models.select("model_id", "vertical", "priority")
    own = own.join(F.broadcast(catalog) if n_models <= BROADCAST_MODELS else catalog, "model_id").persist()
    same = ["model_id", "vertical", "priority", *PLANES]
    boxes = [f(f"{n}_{a}").alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]
    alike = own.groupBy(*same).agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("n"), *boxes).persist()
    # the accepted region reaches 3 * TOLERANCE * longest edge beyond the tetrahedron; an edge is at most sqrt(3) boxes long
    edge = F.greatest(*(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"))
    reach = edge * (3 * TOLERANCE * 1.75)

    def ends(a: str, level: Column) -> tuple[Column, Column]:
        size = F.pow(F.lit(2.0), level)
        return cell(F.col(f"lo_{a}") - reach, size), cell(F.col(f"hi_{a}") + reach, size)

    first = F.ceil(F.log2(edge)).cast("int")
    # a box as long as its cell may touch three in a row; one level up it can't
    crowded = F.greatest(*(hi - lo for lo, hi in (ends(a, first) for a in "xyz"))) > 1
    rows = alike.withColumn("level", first + F.when(crowded, 1).otherwise(0))
    for a in "xyz":
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(*ends(a, F.col("level")))))
    rows = rows.select(*CELL_KEYS, "model_id", "tid", F.col("priority").cast("int").alias("priority"), "n", *PLANES).persist()
    found = rows.groupBy("level", "vertical").count().collect()  # a handful of sizes
    samples = own.withColumn("twin", F.col("tid"))
    if alike.count() < own.count():
        samples = own.withColumnRenamed("tid", "twin").join(alike.select(*same, "tid"), same)
    samples = samples.select("model_id", "tid", "twin", *PLANES, *(f"q{n}" for n in range(4))).persist()
    n_tets = samples.count()
    alike.unpersist()
    own.unpersist()
    return Index(rows, samples, models.select("model_id", "model_type", *(f"{n}{a}" for n in ("min", "max") for a in "xyz"), "profile"), sum(r["count"] for r in found), n_tets, n_models, sorted((r["level"], r["vertical"]) for r in found))


def cell(at: Column, size: Column) -> Column:
    return F.floor(at / size + 0.5)


Of = Callable[[str], Column]  # a tetrahedron's columns, or an array element's fields


def weights(x: Column, y: Column, z: Column, of: Of = F.col) -> list[Column]:
    """The first three barycentric weights."""
    d = (x - of("x3"), y - of("y3"), z - of("z3"))
    return [of(f"m{r}0") * d[0] + of(f"m{r}1") * d[1] + of(f"m{r}2") * d[2] for r in range(3)]


def inside(x: Column, y: Column, z: Column, of: Of = F.col) -> Column:
    l0, l1, l2 = weights(x, y, z, of)
    return (l0 >= -TOLERANCE) & (l1 >= -TOLERANCE) & (l2 >= -TOLERANCE) & (l0 + l1 + l2 <= 1 + TOLERANCE)


def in_bounds(x: Column, y: Column, z: Column, of: Of = F.col) -> Column:
    return x.between(of("minx"), of("maxx")) & y.between(of("miny"), of("maxy")) & z.between(of("minz"), of("maxz"))


def height(vertical: str | Column) -> Column:
    """What a model of that vertical has as its third coordinate."""
    return F.when((F.lit(vertical) if isinstance(vertical, str) else vertical) == DEPTH, F.col("depth")).otherwise(F.col("z"))


def listed(points: DataFrame, index: Index, models: ModelRange = ALL) -> DataFrame:
    """A row for each point and tetrahedron under its cells: the point's columns, _h (its height for that tetrahedron) and the index's as _t_<name>."""
    levels = F.array(*(F.struct(F.lit(n).cast("int").alias("level"), F.lit(v).alias("vertical")) for n, v in index.keys or [(0, "")]))
    keyed = points.withColumn("_s", F.explode(levels)).withColumn("_h", height(F.col("_s.vertical")))
    size = F.pow(F.lit(2.0), F.col("_s.level"))
    keyed = keyed.withColumns({"_k_level": F.col("_s.level"), "_k_vertical": F.col("_s.vertical"), **{f"_k_c{a}": cell(F.col(c), size) for a, c in (("x", "x"), ("y", "y"), ("z", "_h"))}}).drop("_s")
    rows = index.asked(models)
    rows = rows.select(*(F.col(c).alias(f"_t_{c}") for c in rows.columns))
    same = [F.col(f"_k_{c}") == F.col(f"_t_{c}") for c in CELL_KEYS]
    return keyed.join(rows, same).drop(*(f"{p}{c}" for p in ("_k_", "_t_") for c in CELL_KEYS))


def of_index(c: str) -> Column:
    return F.col(f"_t_{c}")


def bounded(found: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of listed() with their model's columns."""
    named = models.select(*(F.col(c).alias(f"_t_{c}") for c in models.columns))
    return found.join(named, "_t_model_id")


def tested(points: DataFrame, index: Index, models: ModelRange = ALL) -> DataFrame:
    """Rows of listed() whose tetrahedron holds the point."""
    return listed(points, index, models).filter(inside(F.col("x"), F.col("y"), F.col("_h"), of_index)).drop(*(f"_t_{c}" for c in PLANES))


def with_samples(found: DataFrame, index: Index, kept: list[str], twins: bool = False) -> DataFrame:
    """The kept columns of tested rows with model_id, priority, tid, q, where the point is in the model's bounds. twins: a row for each tetrahedron with the same planes."""
    samples, catalog = index.payload(twins)
    # bounds hold the stored z range, which for depth models is the mesh's own
    found = bounded(found, catalog).filter(in_bounds(F.col("x"), F.col("y"), F.col("_h"), of_index))
    corners = samples.select(*(F.col(c).alias(f"_t_{c}") for c in samples.columns))
    found = sampled(found.join(corners, ["_t_model_id", "_t_tid"]))
    return found.select(*kept, *(of_index(c).alias(k) for c, k in (("model_id", "model_id"), ("priority", "priority"), ("twin", "tid"))), "q")


def hits(points: DataFrame, index: Index, models: ModelRange = ALL) -> DataFrame:
    """A row for each point and tetrahedron that holds it: point columns, model_id, priority, tid, q."""
    return with_samples(tested(points, index, models), index, points.columns, twins=True)


def sampled(found: DataFrame) -> DataFrame:
    """Adds q: between corners, or the layer of the profile at the point's depth with the corners' opacity. Step by step, so that it compiles."""
    w = [F.col(f"_w{n}") for n in range(4)]
    found = found.withColumns({f"_w{n}": l for n, l in enumerate(weights(F.col("x"), F.col("y"), F.col("_h"), of_index))})
    found = found.withColumn("_w3", 1 - (w[0] + w[1] + w[2]))
    corner = lambda c: [of_index(f"q{n}")[c] for n in range(4)]
    mean = lambda c: sum((x * v for x, v in zip(w[1:], corner(c)[1:], strict=True)), w[0] * corner(c)[0])
    found = found.withColumns({f"_mean_{c}": mean(c) for c in ("rho", "vp", "vs", "alpha")})
    is_profile = of_index("model_type") == DEPTH_PROFILE
    found = found.withColumns({
        "_mean_qp": algebra.following_q(w, corner("vp"), corner("qp"), F.col("_mean_vp")), "_mean_qs": algebra.following_q(w, corner("vs"), corner("qs"), F.col("_mean_vs")),
        "_layer": F.when(is_profile, numeric.layer_of(F.col("depth"), of_index("profile"))),
    })
    part = lambda c: F.when(is_profile, F.col("_layer")[c]).otherwise(F.col(f"_mean_{c}"))
    return found.withColumn("q", F.struct(*((F.col("_mean_alpha") if c == "alpha" else part(c)).alias(c) for c in COMPONENTS)))


ENTRY = "array<struct<priority:int,model_id:int,tid:bigint,q:struct<rho:double,vp:double,vs:double,qp:double,qs:double,alpha:double>>>"


def places(points: DataFrame) -> DataFrame:
    """Distinct places, dealt out by their hash."""
    return points.select(F.xxhash64(*PLACE).alias("_place"), *PLACE).repartition("_place").distinct()


def at_places(points: DataFrame, found: DataFrame) -> DataFrame:
    """points with what was found at their place, or nulls. Places with a null or no number have no hits."""
    own = found.select("_place", *(F.col(c).alias(f"_p_{c}") for c in PLACE), *(c for c in found.columns if c not in ("_place", *PLACE)))
    met = points.withColumn("_place", F.xxhash64(*PLACE)).alias("_l")
    same = F.col("_l._place") == F.col("_r._place")
    for c in PLACE:  # not as keys: the hash is what both sides are dealt out by
        same &= (F.col(f"_l.{c}") >= F.col(f"_r._p_{c}")) & (F.col(f"_l.{c}") <= F.col(f"_r._p_{c}"))
    return met.join(own.alias("_r"), same, "left").select(*(F.col(f"_l.`{c}`") for c in points.columns), *(F.col(f"_r.{c}") for c in own.columns if c not in ("_place", *(f"_p_{p}" for p in PLACE))))


def gathered(points: DataFrame, index: Index, models: ModelRange = ALL) -> DataFrame:
    """points with `hits`: one entry for each model that holds them, by rising priority, then model_id; the lowest tid stands for a model.

    Every point stays a row of its own, repeated ones too; those with a null coordinate have no hits.
    """
    if not index.keys:
        return points.withColumn("hits", F.array().cast(ENTRY))
    entry = F.struct(F.col("priority").cast("int").alias("priority"), F.col("model_id").cast("int").alias("model_id"), F.col("tid").cast("long").alias("tid"), "q")
    keys = ["_place", *PLACE]
    # the lowest tetrahedron of each model first: few rows are left to sample, and the tests stay in a small compiled loop of their own
    held = tested(places(points), index, models).groupBy(*keys, "_h", "_t_model_id", "_t_priority").agg(F.min("_t_tid").alias("_t_tid"))
    found = with_samples(held, index, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    return at_places(points, found).withColumn("hits", F.coalesce("hits", F.array().cast(ENTRY)))


def composite(points: DataFrame, index: Index, models: ModelRange = ALL, name: str = "q", miss_zero: bool = True) -> DataFrame:
    """points with the struct `name`: the models that hold each point composited in order of priority."""
    folded = algebra.fold(F.col("hits"))
    return gathered(points, index, models).withColumn(name, algebra.or_zero(folded) if miss_zero else folded).drop("hits")


def refold(with_hits: DataFrame, models: ModelRange, name: str) -> DataFrame:
    """Another range's composite from hits that were gathered once."""
    own = F.filter("hits", lambda x: models.holds(x["priority"]))
    return with_hits.withColumn(name, algebra.or_zero(algebra.fold(own)))


def explain(points: DataFrame, index: Index) -> DataFrame:
    """points with contributions (every model's sample, in order), the output, and at which contribution the result became opaque.

    termination is only set where a further model follows.
    """
    found = gathered(points, index)
    start = F.struct(F.lit(None).cast(QUALITY).alias("q"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def add(done: Column, x: Column) -> Column:
        """What is composited without stopping, and the first contribution that made it opaque."""
        grown = F.when(done["q"].isNull(), x["q"]).otherwise(algebra.over(done["q"], x["q"]))
        return let(grown, lambda q: F.struct(q.alias("q"), (done["n"] + 1).alias("n"), F.coalesce(done["at"], F.when(algebra.saturated(q), done["n"])).alias("at")))

    at = F.aggregate("hits", start, add, lambda s: s["at"])
    ended = let(at, lambda a: F.when(a < F.size("hits") - 1, a))
    return found.select(*points.columns, F.col("hits").alias("contributions"), algebra.fold(F.col("hits")).alias("output"), ended.alias("termination"))


COUNTS = ("candidates", "tested", "held")


def query_stats(points: DataFrame, index: Index, models: ModelRange = ALL, output: str | None = None, counts: Sequence[str] = COUNTS) -> DataFrame:
    """points with candidates (tetrahedra listed under their cells), tested (of those, in bounds), held and hit_count (models that contribute).

    output: the name of a column for the composite, which is folded from the same rows: the cells are looked up once for both.
    counts: which of the counts to make; where held is the only one, only hits leave the cells.
    """
    x, y, h = F.col("x"), F.col("y"), F.col("_h")
    samples, catalog = index.payload()
    listing = tested if set(counts) <= {"held"} else listed
    found = bounded(listing(places(points), index, models), catalog)
    near = F.coalesce(in_bounds(x, y, h, of_index), F.lit(False))
    held = near if listing is tested else near & inside(x, y, h, of_index)
    found = found.filter(held) if listing is tested else found
    keys = ["_place", *PLACE]
    n = of_index("n")
    every = dict(zip(COUNTS, (n, F.when(near, n), F.when(held, n)), strict=True))
    counts = {c: F.coalesce(F.sum(every[c]), F.lit(0).cast("long")) for c in counts}
    # a row for each place and model, with the tetrahedron that stands for the model
    own = found.groupBy(*keys, "_h", "_t_model_id", "_t_priority").agg(F.min(F.when(held, of_index("tid"))).alias("_t_tid"), *(c.alias(n) for n, c in counts.items()))
    sums = [F.sum(n).alias(n) for n in counts] + [F.count("_t_tid").alias("hit_count")]
    if output:
        corners = samples.select(*(F.col(c).alias(f"_t_{c}") for c in samples.columns))
        # models without a hit keep their counts: only hits have samples to join
        own = sampled(bounded(own, catalog).join(corners, ["_t_model_id", "_t_tid"], "left"))
        entry = F.struct(*(of_index(c).cast(t).alias(c) for c, t in (("priority", "int"), ("model_id", "int"), ("tid", "long"))), "q")
        sums.append(F.sort_array(F.collect_list(F.when(of_index("tid").isNotNull(), entry))).alias("_hits"))
    made = at_places(points, own.groupBy(*keys).agg(*sums))
    zeros = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in (*counts, "hit_count")]
    folded = [algebra.or_zero(algebra.fold(F.coalesce("_hits", F.array().cast(ENTRY)))).alias(output)] if output else []
    return made.select(*points.columns, *folded, *zeros)


class Totals:
    """What one pass of a query counted: known once the first action on its rows has ended, without a second look at the points.

    Sums over all points, repeated ones too. They are told where the rows leave the pass, as adaptive plans may drop what lies below a join
    that turns out empty. Where an executor is lost, what its tasks had counted may be counted again.
    """

    def __init__(self) -> None:
        self._seen = Observation()

    def of(self, rows: DataFrame) -> DataFrame:
        sums = (F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*COUNTS, "hit_count"))
        return rows.observe(self._seen, F.count(F.lit(1)).alias("points"), *sums)

    def counts(self) -> dict[str, int]:
        """Waits for the first action on the rows."""
        return self._seen.get

    def timed(self, action: Callable[[], object]) -> dict[str, float]:
        """Runs an action on the rows; the counts, and its seconds as elapsed."""
        start = time.monotonic()
        action()
        return {**self.counts(), "elapsed": time.monotonic() - start}


def measured(points: DataFrame, index: Index, models: ModelRange = ALL, name: str = "q") -> tuple[DataFrame, Totals]:
    """composite() with the totals of its own pass."""
    totals = Totals()
    return totals.of(query_stats(points, index, models, name)).drop(*COUNTS, "hit_count"), totals
