"""Readers of point, profile and site tables, surfaces, outlines and meshes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import not_nan
from ..operators import footprints

MESH_TABLES = ("models", "vertices", "tets")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, vertices, tets) of a folder written by sinks.meshes.write_mesh."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in MESH_TABLES)


def read_meshes(spark: SparkSession, paths: Sequence[str], chosen: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Several meshes as one set; model numbers are dealt anew in the order of the paths, then of their own numbers.

    `chosen` picks rows of models (with `footprint`, found from the vertices where a mesh has none stored). Of meshes without a
    chosen model nothing else is read.
    """
    parts, start = [], 0
    for p in sorted(set(map(str, paths))):
        models, vertices, tets = read_mesh(spark, p)
        if chosen is not None and "footprint" not in models.columns:
            models = models.join(footprints.footprints(vertices), "model_id", "left")
        r = models.agg(F.max("model_id")).first()[0]
        moved = tuple(t.withColumn("model_id", (F.col("model_id") + start).cast("int")) for t in (models, vertices, tets))
        parts.append((moved[0].withColumn("_part", F.lit(len(parts))), *moved[1:]))
        start += (r or 0) + 1
    if not parts:
        raise FileNotFoundError("no meshes given")
    models = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p[0] for p in parts))
    if chosen is None:
        kept = range(len(parts))
    else:
        models = chosen(models)
        kept = sorted(r[0] for r in models.select("_part").distinct().collect()) or [0]  # a number for each path at most
    vertices, tets = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (parts[k][n] for k in kept)) for n in (1, 2))
    if chosen is not None:
        own = F.broadcast(models.select("model_id"))  # a row for each mesh
        vertices, tets = (t.join(own, "model_id", "left_semi") for t in (vertices, tets))
    return models.drop("_part"), vertices, tets


def read_sites(spark: SparkSession, path: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """(i, longitude, latitude, labels) from CSV with a header, or Parquet; rows are numbered by their place in the sorted table."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        rows = spark.read.csv(path, header=True, inferSchema=True)
    elif suffix in ("parquet", "pq"):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"sites come as .csv or .parquet, not .{suffix}")
    if lacking := {lon, lat} - set(rows.columns):
        raise ValueError(f"the site table lacks {sorted(lacking)}")
    named = rows.withColumnsRenamed({lon: "longitude", lat: "latitude"})
    wrong = named.filter(F.col("longitude").isNull() | F.col("latitude").isNull() | ~F.col("longitude").between(-180, 360) | ~F.col("latitude").between(-90, 90))
    if not wrong.isEmpty():
        raise ValueError("some sites have no valid place")
    return number(named, "i")


def inline_sites(spark: SparkSession, sites: list[dict]) -> DataFrame:
    """The same table from a request's own list, numbered as listed; labels are typed by their values."""
    names = [k for k in sites[0] if k not in ("longitude", "latitude")]
    kind = lambda k: "boolean" if all(isinstance(s[k], bool) for s in sites) else "bigint" if all(isinstance(s[k], int) and not isinstance(s[k], bool) for s in sites) else "double" if all(isinstance(s[k], (int, float)) and not isinstance(s[k], bool) for s in sites) else "string"
    kinds = {k: kind(k) for k in names}
    cast = {"boolean": bool, "bigint": int, "double": float, "string": str}
    rows = [(n, float(s["longitude"]), float(s["latitude"]), *(cast[kinds[k]](s[k]) for k in names)) for n, s in enumerate(sites)]
    return spark.createDataFrame(rows, ", ".join(["i bigint, longitude double, latitude double", *(f"`{k}` {v}" for k, v in kinds.items())]))


def number(rows: DataFrame, name: str) -> DataFrame:
    """rows with dense numbers in the order of their partitions, without bringing them into one."""
    tagged = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = sorted((r[0], r[1]) for r in tagged.groupBy(part).count().collect())  # a row for each partition
    start, starts = 0, []
    for p, n in sizes:
        starts += [F.lit(p), F.lit(start)]
        start += n
    at = F.create_map(*starts)[part] if starts else F.lit(0)
    return tagged.select((F.coalesce(at, F.lit(0)) + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long").alias(name), *rows.columns)


def read_columns(spark: SparkSession, path: str, skip: int = 0, header: bool = True, names: Sequence[str] = (), comment: str = "#") -> DataFrame:
    """Numbers parted by white space. `skip` lines are left out, then a header may name the columns."""
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n"))
    top = skip + bool(header)
    if header:
        names = lines.orderBy("_file", "_n").limit(skip + 1).select("line").collect()[skip][0].split()
    if not names:
        raise ValueError("columns need names")
    # a file's first part is its largest, so its lines have the file's smallest numbers; there are as many starts as files
    starts = lines.groupBy("_file").agg(F.min("_n").alias("_start"))
    parts = F.split("line", r"\s+")
    data = (F.col("_n") >= F.col("_start") + top) & (F.col("line") != "") & ~F.col("line").startswith(comment)
    own = lines.join(F.broadcast(starts), "_file").filter(data)
    # a later join's null check may be evaluated before the filter, so the cast looks at data lines by itself
    return own.select(*(F.when(data, F.get(parts, n).cast("double")).alias(c) for n, c in enumerate(names)))


def read_tomography(spark: SparkSession, path: str) -> DataFrame:
    """A tomography table (a title line, then names) as x, y, z in km and vp, vs, rho."""
    raw = read_columns(spark, path, skip=1)
    kept = {"x(km)": "x", "y(km)": "y", "Depth(km_BSL)": "z", "Density": "rho", "Vp": "vp", "Vs": "vs", "Qp": "qp", "Qs": "qs"}
    return raw.select(*(F.col(f"`{a}`").alias(b) for a, b in kept.items() if a in raw.columns))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A layered 1-D model (a title line, then vp vs rho qp qs bottom in km and km/s) in SI, with tops and thickness."""
    raw = read_columns(spark, path, skip=1, header=False, names=("vp", "vs", "rho", "qp", "qs", "bottom"))
    return profile_in_si(raw.withColumnRenamed("bottom", "bottom_depth"))


def profile_in_si(layers: DataFrame) -> DataFrame:
    from ..operators.meshes import layer_tops

    si = layers.select(*((F.col(c) * 1000).alias(c) for c in ("vp", "vs", "rho")), "qp", "qs", (F.col("bottom_depth") * 1000).alias("bottom"))
    return layer_tops(si).withColumn("z", F.col("top"))


def uniform_profile(spark: SparkSession, text: str, bottom: float | Sequence[float]) -> DataFrame:
    """A layer from "rho=..,vp=..,vs=..,qp=..,qs=..", in SI, or several of the same values that end at the bottoms given."""
    given = dict(part.split("=", 1) for part in text.replace(" ", "").split(",") if part)
    if set(given) != {"rho", "vp", "vs", "qp", "qs"}:
        raise ValueError("a uniform model names rho, vp, vs, qp and qs")
    bottoms = [float(b) for b in (bottom if isinstance(bottom, Sequence) else [bottom])]
    if not bottoms or any(b <= a for a, b in zip(bottoms, bottoms[1:])):
        raise ValueError("bottoms must rise, and there must be one")
    values = [float(given[c]) for c in ("vp", "vs", "rho", "qp", "qs")]
    return spark.createDataFrame([(*values, a, b, b - a) for a, b in zip([0.0, *bottoms], bottoms)], "vp double, vs double, rho double, qp double, qs double, z double, bottom double, thickness double")


def read_raster(spark: SparkSession, path: str, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, value: str = "value", flip: bool = False) -> DataFrame:
    """(lon, lat, z) of a Parquet raster within a box; a box that misses it reads all of it. `flip` turns elevation into depth."""
    nodes = spark.read.parquet(path)
    inside = nodes
    for name, box in (("lon", lon), ("lat", lat)):
        inside = inside.filter(F.col(name).between(*box)) if box else inside
    chosen = nodes if (lon or lat) and inside.isEmpty() else inside
    z = not_nan(F.col(value).cast("double"))
    return chosen.select("lon", "lat", (-z if flip else z).alias("z"))


def wkb_rings(raw: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multipolygon in well-known binary."""

    def geometry(at: int) -> tuple[list, int]:
        order = "<" if raw[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", raw, at + 1)[0]
        width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        n = struct.unpack_from(order + "I", raw, at + 5)[0]
        at += 9
        rings = []
        if kind % 1000 == 3:
            for _ in range(n):
                m = struct.unpack_from(order + "I", raw, at)[0]
                flat = struct.unpack_from(f"{order}{width * m}d", raw, at + 4)
                rings.append([(flat[i * width], flat[i * width + 1]) for i in range(m)])
                at += 4 + 8 * width * m
        elif kind % 1000 in (6, 7):
            for _ in range(n):
                own, at = geometry(at)
                rings += own
        else:
            raise ValueError(f"geometry type {kind} isn't a polygon")
        return rings, at

    return geometry(0)[0]


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(ring, n, x, y) of files of well-known binary, gzipped or not."""
    import gzip

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, raw in zip(part["path"], part["content"], strict=True):
                for k, ring in enumerate(wkb_rings(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)):
                    rows += [(f"{name}#{k}", n, x, y) for n, (x, y) in enumerate(ring)]
            yield pd.DataFrame(rows, columns=["ring", "n", "x", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "ring string, n int, x double, y double")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ring, n, x, y) of the polygons of GeoJSON files; a ring's name tells its file, feature, polygon and place in it."""
    shape = "struct<type: string, features: array<struct<geometry: struct<type: string, coordinates: string>>>, geometry: struct<type: string, coordinates: string>, coordinates: string>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", shape).alias("g"))
    alone = F.array(F.coalesce(F.col("g.geometry"), F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))))
    found = raw.select("file", F.posexplode(F.coalesce(F.transform("g.features", lambda f: f["geometry"]), alone)).alias("feature", "g"))
    one = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
    many = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    polygons = found.select("file", "feature", F.posexplode(F.when(F.col("g.type") == "MultiPolygon", many).otherwise(one)).alias("polygon", "rings"))
    rings = polygons.select("file", "feature", "polygon", F.posexplode("rings").alias("place", "r"))
    named = rings.select(F.concat_ws("#", "file", "feature", "polygon", "place").alias("ring"), F.posexplode("r").alias("n", "p"))
    return named.select("ring", "n", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Outlines by suffix: GeoJSON, or else well-known binary."""
    return read_geojson(spark, path) if path.lower().endswith((".json", ".geojson")) else read_outlines(spark, path)


def read_surface(spark: SparkSession, path: str, value: str = "z") -> Callable[[DataFrame, str], DataFrame]:
    """A surface of a Parquet table of nodes (x, y, value) on an upright lattice, whichever way its axes run: adds its value to rows with x and y."""
    from ..operators import surfaces

    placed, shape, origin, spacing = read_lattice(spark, path, [value])
    return lambda rows, name: surfaces.bilinear(rows, placed, shape, origin, spacing, name=name, value=value)


def read_lattice(spark: SparkSession, path: str, values: Sequence[str]) -> tuple[DataFrame, tuple[int, int], tuple[float, float], tuple[float, float]]:
    """(nodes (ix, iy, values), shape, origin, spacing) of a Parquet table of nodes (x, y, values) that fill an upright lattice."""
    nodes = spark.read.parquet(path)
    r = nodes.agg(F.min("x"), F.max("x"), F.countDistinct("x"), F.min("y"), F.max("y"), F.countDistinct("y"), F.count(F.lit(1))).first()
    (x0, x1, nx), (y0, y1, ny) = r[:3], r[3:6]
    if nx < 2 or ny < 2 or r[6] != nx * ny:
        raise ValueError(f"{path} isn't a full lattice of two or more nodes along x and y")
    dx, dy = (x1 - x0) / (nx - 1), (y1 - y0) / (ny - 1)
    placed = nodes.select(F.round((F.col("x") - x0) / dx).cast("long").alias("ix"), F.round((F.col("y") - y0) / dy).cast("long").alias("iy"), *values)
    off = nodes.filter((F.abs(F.col("x") - x0 - F.round((F.col("x") - x0) / dx) * dx) > 1e-3 * dx) | (F.abs(F.col("y") - y0 - F.round((F.col("y") - y0) / dy) * dy) > 1e-3 * dy))
    if not off.isEmpty():
        raise ValueError(f"the nodes of {path} aren't evenly spaced")
    return placed, (nx, ny), (x0, y0), (dx, dy)
