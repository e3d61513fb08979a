"""Models from files: tomography tables, basins between surfaces, and the inputs of a small synthetic world."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, synthetic
from ..functions.crs import TransverseMercator
from ..operators import bands, basins, meshes, surfaces, tiles
from ..schema import DEPTH, DEPTH_PROFILE, ELEVATION, INTERPOLATE
from ..sources import tables, tiff

Mesh = tuple[DataFrame, DataFrame, DataFrame]
PROFILE_TYPE = "array<struct<top:double,rho:double,vp:double,vs:double,qp:double,qs:double>>"
BAND_EDGE = 1000.0  # metres, fixed value: the longest edges where a band has to be resolved
MODELS = f"model_id int, name string, priority int, vertical string, model_type int, profile {PROFILE_TYPE}"


def model_of(spark: SparkSession, spec: str, bottoms: Sequence[float] | None = None) -> DataFrame:
    """A 1-D model: a text file, or "rho=..,vp=..,vs=..,qp=..,qs=.." everywhere, in layers where bottoms are given."""
    if "=" in spec:
        return tables.uniform_profile(spark, spec, list(bottoms) if bottoms else 1e7)
    if bottoms:
        raise ValueError("bottoms only apply to a uniform model")
    return tables.read_profile(spark, spec)


def tomography_model(spark: SparkSession, path: str, name: str, frame: Sequence[Sequence[float]] | None = None, priority: int = 255) -> Mesh:
    """The mesh of a tomography table in kilometres. frame: the map from the world in metres to the table; none is the unit alone."""
    frame = numeric.model_frame(0.0, 0.0, 0.0) if frame is None else frame
    vertices, tets = meshes.tomography_mesh(spark, tables.read_tomography(spark, path))
    return spark.createDataFrame([(0, name, priority, ELEVATION, INTERPOLATE, None)], MODELS), meshes.in_world(vertices, frame), tets


def read_basins(spark: SparkSession, path: str) -> DataFrame:
    """Outlines (basin, n, x, y) of GeoJSON polygons, numbered by their names; polygons with holes are refused."""
    rings = tables.read_geojson(spark, path)
    names = sorted(r[0] for r in rings.select("ring").distinct().collect())  # a file holds a few dozen
    if any(not n.endswith("#0") for n in names):
        raise ValueError(f"{path} has outlines with holes")
    if not names:
        raise ValueError(f"{path} has no outlines")
    return rings.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "basin int, ring string")), "ring").select("basin", "n", "x", "y")


@dataclass(frozen=True)
class Layer:
    """What lies above one interface of a basin: the interface's column, the 1-D model (z, thickness and fields) and the priority."""

    bottom: str
    profile: DataFrame
    priority: int


@dataclass(frozen=True)
class Band:
    """A smoothing band: how wide, the lattice's step its outline is found on, the longest edges in it, and land (ring, n, x, y)."""

    metres: float
    land: DataFrame | None = None
    step: float | None = None
    max_edge: float = BAND_EDGE


def basin_model(
    spark: SparkSession, outlines: str, lattice: str, bottom: str, profile: DataFrame, name: str, priority: int, top: str | None = None, ground: str | None = None,
    metres: float = 10.0, max_edge: float = math.inf, least_area: float = 0.0,
) -> Mesh:
    """basin_layers() of one layer whose top isn't raised."""
    return basin_layers(spark, outlines, lattice, [Layer(bottom, profile, priority)], name, top, ground, metres, max_edge, least_area, pad=0.0)


def basin_layers(
    spark: SparkSession, outlines: str, lattice: str, layers: Sequence[Layer], name: str, top: str | None = None, ground: str | None = None, metres: float = 10.0,
    max_edge: float = math.inf, least_area: float = 0.0, band: Band | None = None, pad: float = basins.PAD,
) -> Mesh:
    """Basins of stacked layers, each of a 1-D model, as depths below the column ground where that is given.

    Interfaces are columns of a lattice of nodes (x, y, ...), from the top down. Without a top the basins begin at depth 0. All layers
    share one triangulation that meets every interface. Missing nodes outside the outlines (with their band) don't matter; inside they
    end the run. A layer ends where its model does. Models are numbered basin * layers + layer, and named by both where there are several layers.
    """
    if not layers:
        raise ValueError("a basin has a layer at least")
    below = [n.bottom for n in layers]
    nodes, shape, origin, spacing = tables.read_lattice(spark, lattice, list(dict.fromkeys(c for c in (top, *below, ground) if c)))
    under = F.col(ground) if ground else F.lit(0.0)
    given = {"i0": F.col(top) - under if top else F.col(below[-1]) * 0} | {f"i{n}": F.col(c) - under for n, c in enumerate(below, 1)}
    sides = nodes.select("ix", "iy", *(c.alias(n) for n, c in given.items()))
    rings = basins.cleaned(read_basins(spark, outlines), least_area).persist()
    region = rings
    if band is not None:
        region = bands.grown(rings, band.metres, min(band.step or min(spacing) / 2, band.metres), band.land)
        max_edge = min(max_edge, band.max_edge)
    fitted = {n: metres for n in given if n != "i0" or top}
    made = basins.triangulated(region, sides.select("ix", "iy", *fitted), shape, fitted, origin, spacing, max_edge).persist()  # each layer asks for it
    columns = basins.at_vertices(made, sides, shape, list(given), origin, spacing).persist()
    profiles = [sorted((tuple(float(r[c]) for c in ("z", "thickness", "rho", "vp", "vs", "qp", "qs")) for r in n.profile.collect()), key=lambda r: r[0]) for n in layers]  # a few dozen rows each
    vertices, tets = basins.layered(made, columns, list(given), [p[-1][0] + p[-1][1] for p in profiles], pad)
    tabled = [F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("top", "rho", "vp", "vs", "qp", "qs"), (r[0], *r[2:]), strict=True))) for r in p)) for p in profiles]
    count = len(layers)
    layered = F.element_at(F.array(*(t.cast(PROFILE_TYPE) for t in tabled)), (F.col("model_id") % count + 1).cast("int"))
    at = numeric.layer_of(F.col("z"), F.col("_profile"))
    alpha = F.lit(1.0)
    if band is not None:
        faded = bands.opacity(columns.select("basin", "x", "y", "vid"), rings, band.metres).select(F.col("basin").alias("_basin"), F.col("vid").alias("_vid"), "alpha")
        own = (F.floor(F.col("model_id") / count) == F.col("_basin")) & (F.floor(F.col("vid") / 2) == F.col("_vid"))
        vertices, alpha = vertices.join(faded, own).drop("_basin", "_vid"), F.col("alpha")
    valued = vertices.withColumn("_profile", layered).select("model_id", "vid", "x", "y", "z", *(at[c].alias(c) for c in ("rho", "vp", "vs", "qp", "qs")), alpha.alias("alpha"))
    kept = meshes.cull(valued, tets, 0.0)
    numbered = rings.select("basin").distinct().select("basin", F.explode(F.array(*map(F.lit, range(count)))).alias("layer"))
    numbered = numbered.select((F.col("basin") * count + F.col("layer")).alias("model_id"), F.concat_ws("-", F.lit(name), "basin", *(["layer"] if count > 1 else [])).alias("name"))
    priority = F.element_at(F.array(*(F.lit(n.priority) for n in layers)), (F.col("model_id") % count + 1).cast("int"))
    # a layer that is filled to its bottom everywhere has no tetrahedra and so no model
    models = numbered.join(kept[1].select("model_id").distinct(), "model_id", "left_semi").select(
        "model_id", "name", priority.alias("priority"), F.lit(DEPTH if ground or not top else ELEVATION).alias("vertical"), F.lit(DEPTH_PROFILE).alias("model_type"), layered.alias("profile"),
    )
    return models, *kept


def report(spark: SparkSession, path: str, least: float = 1e-6) -> DataFrame:
    """(name, n_tets, min_volume, ok) of a written mesh's models; one without tetrahedra isn't ok."""
    models, vertices, tets = tables.read_mesh(spark, path)
    meshes.validate(models, tets)
    return models.select("model_id", "name").join(meshes.report(vertices, tets, least), "model_id", "left").select("name", "n_tets", "min_volume", F.coalesce("ok", F.lit(False)).alias("ok"))


def upright_surface(spark: SparkSession, path: str, value: str, spacing: float | None = None, flip: bool = False) -> DataFrame:
    """(x, y, z) on an upright lattice of metres of a raster (lon, lat, value) in degrees; NULL outside of it."""
    nodes = tables.read_raster(spark, path, value=value, flip=flip)
    return _projected(spark, nodes, spacing)


def convert_tiff(spark: SparkSession, path: str, output: str, band: int = 1, downsample: int = 1, flip: bool = False, tile: int = tiles.TILE) -> tiles.Tiled:
    """A band of a TIFF as a tiled surface: cut to the box of its valid pixels, then means of whole blocks from the box's first pixel on.

    The file's place in the world, turned or not, becomes the surface's frame. A band without a valid pixel is an error.
    """
    if downsample < 1:
        raise ValueError("blocks have one pixel at least along each axis")
    raster = tiff.about(path)
    z = F.col(f"b{band}")
    pixels = tiff.read(spark, path, [band])
    r = pixels.filter(z.isNotNull()).agg(*(f(a) for a in ("ix", "iy") for f in (F.min, F.max))).first()
    if r[0] is None:
        raise ValueError(f"{path}: band {band} has no valid pixel")
    inside = pixels.filter((F.col("ix") >= r[0]) & (F.col("ix") <= r[1]) & (F.col("iy") >= r[2]) & (F.col("iy") <= r[3]))
    own = inside.select((F.col("ix") - r[0]).alias("ix"), (F.col("iy") - r[2]).alias("iy"), (-z if flip else z).alias("z"))
    shape = (r[1] - r[0] + 1, r[3] - r[2] + 1)
    blocks = own if downsample == 1 else surfaces.coarsen(own, downsample, shape)
    world = np.asarray(raster.to_world)
    middle = (downsample - 1) / 2
    linear, place = world[:, :2] * downsample, world @ (r[0] + middle, r[2] + middle, 1.0)
    turned = np.linalg.inv(linear)
    frame = np.column_stack([turned, -turned @ place])
    tiles.write(blocks, output, (shape[0] // downsample, shape[1] // downsample), frame=frame.tolist(), tile=tile)
    return tiles.read(spark, output)


def _projected(spark: SparkSession, nodes: DataFrame, spacing: float | None) -> DataFrame:
    """nodes: (lon, lat, z) of a full raster in degrees."""
    shape = nodes.agg(*(f(a).alias(f"{n}_{a}") for a in ("lon", "lat") for f, n in ((F.min, "low"), (F.max, "high"), (F.countDistinct, "n")))).first()

    def number(a: str) -> Column:
        return F.round((F.col(a) - shape[f"low_{a}"]) / (shape[f"high_{a}"] - shape[f"low_{a}"]) * (shape[f"n_{a}"] - 1)).cast("long")

    x, y = TransverseMercator().forward(F.col("lon"), F.col("lat"))
    placed = nodes.select(number("lat").alias("j"), number("lon").alias("k"), x.alias("x"), y.alias("y"), F.col("z").alias("value"))
    return surfaces.resample_upright(spark, placed, spacing).select("x", "y", "z")


def geojson(rings: DataFrame) -> DataFrame:
    """One line of text: the rings (ring, n, x, y) as a collection of polygons. An outline is gathered whole, as any writer of this format must."""
    point = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    joined = rings.groupBy("ring").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", point.alias("p")))), lambda s: s["p"]), ",").alias("c"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[['), "c", F.lit("]]}}"))
    return joined.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))


def write_synthetic(spark: SparkSession, folder: str, nx: int = 61, ny: int = 41, spacing: float = 1000.0) -> None:
    """The synthetic world's inputs: surface, vs30 and basins (lattices in metres), coastline and outlines, tomography and profile."""
    def projected(ring: DataFrame) -> DataFrame:
        x, y = TransverseMercator().forward(F.col("x"), F.col("y"))
        return ring.select("ring", "n", x.alias("x"), y.alias("y"))

    def lattice(field) -> DataFrame:
        return _projected(spark, synthetic.raster(spark, nx, ny, field).select("lon", "lat", "z"), spacing)

    ground = lattice(lambda lon, lat: -synthetic.elevation(lon, lat))
    ground.write.mode("overwrite").parquet(f"{folder}/surface.parquet")
    lattice(synthetic.vs30).write.mode("overwrite").parquet(f"{folder}/vs30.parquet")
    both = ground.withColumnRenamed("z", "ground")
    for name, b in (("gully", synthetic.GULLY), ("terrace", synthetic.TERRACE)):
        floor = lattice(lambda lon, lat: -synthetic.basement(b, lon, lat))  # noqa: B023
        both = both.join(floor.withColumnRenamed("z", name), ["x", "y"])
        geojson(projected(synthetic.outline(spark, b))).write.mode("overwrite").text(f"{folder}/{name}.geojson")
    both.write.mode("overwrite").parquet(f"{folder}/basins.parquet")
    geojson(projected(synthetic.land_ring(spark))).write.mode("overwrite").text(f"{folder}/coastline.geojson")
    box = both.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    knots = [[box[2 * a] / 1000 + n * (box[2 * a + 1] - box[2 * a]) / 4000 for n in range(5)] for a in (0, 1)]
    table = synthetic.tomography(spark, *knots, [-2.0, 0.0, 2.0, 5.0, 10.0, 20.0])
    head = spark.createDataFrame([(0, "a synthetic tomography"), (1, "x(km) y(km) Depth(km_BSL) Density Vp Vs")], "n long, value string")
    rows = table.select((F.monotonically_increasing_id() + 2).alias("n"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "z", "rho", "vp", "vs"))).alias("value"))
    layer = synthetic.profile(spark).select((F.col("bottom_depth") * 1000).cast("long").alias("n"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("vp", "vs", "rho", "qp", "qs", "bottom_depth"))).alias("value"))
    title = spark.createDataFrame([(-1, "a synthetic profile")], "n long, value string")
    for name, lines in (("tomography", head.unionByName(rows)), ("profile", title.unionByName(layer))):  # a hundred lines
        lines.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(f"{folder}/{name}.txt")
