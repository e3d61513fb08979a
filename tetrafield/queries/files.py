"""What is written and read again: sites, profiles, tomography, outlines, surfaces, meshes and models; basins from their outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, basins, coastline, meshes, tiles
from ..schema import COMPONENTS
from ..plans.construction import convert_tiff
from ..sinks import arrays, binary, formats
from ..sinks import tiff as tiff_sink
from ..sources import tables, tiff
from . import construction, rasters, world

QUERIES, SQL = {}, {}


def sites_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites in CSV, under other names."""
    key = F.col("s_suppkey")
    placed = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("station"), (key % 360 - 179.75).alias("lon"), (key * 7 % 180 - 89.5).alias("lat"))
    path = f"{formats.scratch(spark, 'sites')}/sites.csv"
    placed.write.csv(path, header=True)
    return tables.read_sites(spark, path, "lon", "lat").select(F.col("station").cast("long").alias("station"), "longitude", "latitude")


QUERIES["sites_csv"] = sites_csv
SQL["sites_csv"] = """SELECT s_suppkey::BIGINT AS station, s_suppkey % 360 - 179.75::DOUBLE AS longitude, s_suppkey * 7 % 180 - 89.5::DOUBLE AS latitude FROM supplier"""


def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the layers of a 1-D model in text: kilometres become metres, tops and thicknesses follow from bottoms."""
    k = F.col("n_nationkey").cast("double")
    fields = (1.5 + k * 0.25, 0.5 + k * 0.125, 1.75 + k * 0.0625, 100 + k, 50 + k, (k + 1) * 0.5)
    layers = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"), F.concat_ws("  ", *(f.cast("string") for f in fields)).alias("value"))
    title = spark.createDataFrame([(-1, "a layered model")], "n long, value string")
    path = formats.scratch(spark, "profile")
    layers.unionByName(title).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)  # a model has a few dozen layers
    return tables.read_profile(spark, path).select("rho", "vp", "vs", "qp", "qs", "top", "bottom", "thickness")


QUERIES["profile_text"] = profile_text
SQL["profile_text"] = """WITH k AS (SELECT n_nationkey::DOUBLE AS k FROM nation)
SELECT 1750 + k * 62.5::DOUBLE AS rho, 1500 + k * 250 AS vp, 500 + k * 125 AS vs, 100 + k AS qp, 50 + k AS qs, k * 500 AS top, (k + 1) * 500 AS bottom, 500::DOUBLE AS thickness FROM k"""


def tomography_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tomography table over several files, each with its title and names."""
    k = F.col("p_partkey")
    fields = ((k % 40) * 2.5, F.floor(k / 40) * 2.5, F.col("p_size") * 0.5, 2.5 + k % 7 * 0.125, 5 + k % 11 * 0.25, 3 + k % 5 * 0.125, 300.0 + k % 13, 150.0 + k % 17)
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", *(f.cast("double").cast("string") for f in fields)).alias("value"))

    def headed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["a tomography", "x(km) y(km) Depth(km_BSL) Density Vp Vs Qp Qs"]})
        yield from parts

    path = formats.scratch(spark, "tomography")
    lines.repartition(3).mapInPandas(headed, "value string").write.text(path)
    return tables.read_tomography(spark, path)


QUERIES["tomography_text"] = tomography_text
SQL["tomography_text"] = """WITH k AS (SELECT p_partkey AS k, p_size FROM part)
SELECT k % 40 * 2.5::DOUBLE AS x, k // 40 * 2.5::DOUBLE AS y, p_size * 0.5::DOUBLE AS z, 2.5::DOUBLE + k % 7 * 0.125::DOUBLE AS rho, 5 + k % 11 * 0.25::DOUBLE AS vp,
       3 + k % 5 * 0.125::DOUBLE AS vs, 300::DOUBLE + k % 13 AS qp, 150::DOUBLE + k % 17 AS qs FROM k"""


def outline_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of nations' outlines from GeoJSON, a file for each region: squares, some with a hole, some of two polygons."""
    k, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")

    def ring(x, y, s: float):
        corners = ((0, 0), (s, 0), (s, s), (0, s), (0, 0))
        return F.concat(F.lit("["), F.concat_ws(",", *(F.concat(F.lit("["), (x + a).cast("string"), F.lit(","), (y + b).cast("string"), F.lit("]")) for a, b in corners)), F.lit("]"))

    outer, hole, far = ring(k * 4, r * 4, 2.0), ring(k * 4 + 0.5, r * 4 + 0.5, 1.0), ring(k * 4, r * 4 + 100, 2.0)
    one = F.when(k % 2 == 0, F.concat(F.lit("["), outer, F.lit(","), hole, F.lit("]"))).otherwise(F.concat(F.lit("["), outer, F.lit("]")))
    many = F.concat(F.lit("["), one, F.lit(",["), far, F.lit("]]"))
    shape = F.when(k % 3 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), many)).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), one))
    features = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), shape, F.lit("}}")).alias("f"))
    files = features.groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}")).alias("value"))
    path = formats.scratch(spark, "outlines")
    files.write.partitionBy("n_regionkey").text(path)
    return coastline.segments(tables.read_geojson(spark, path)).select("ax", "ay", "bx", "by")


QUERIES["outline_geojson"] = outline_geojson
SQL["outline_geojson"] = """WITH s AS (SELECT n_nationkey * 4.0::DOUBLE AS x, n_regionkey * 4.0::DOUBLE AS y, 2.0::DOUBLE AS s FROM nation
  UNION ALL SELECT n_nationkey * 4 + 0.5::DOUBLE, n_regionkey * 4 + 0.5::DOUBLE, 1 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey * 4.0::DOUBLE, n_regionkey * 4 + 100.0::DOUBLE, 2 FROM nation WHERE n_nationkey % 3 = 0)
SELECT x + a * s AS ax, y + b * s AS ay, x + c * s AS bx, y + d * s AS by FROM s, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) e(a, b, c, d)"""


def surface_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as a table of nodes with places, read as a surface and sampled."""
    own, (nx, ny) = rasters.raster(spark, sf_dir)
    full = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    nodes = full.join(own, ["ix", "iy"], "left")  # missing nodes have no value
    path = formats.scratch(spark, "surface")
    nodes.select((F.col("ix") / 8).alias("x"), F.col("iy").cast("double").alias("y"), "z").orderBy(F.desc("y"), F.desc("x")).write.parquet(path)
    made = tables.read_surface(spark, path)(rasters._points(spark, sf_dir), "surface")
    return made.select(*world.POINT, "z", F.round("surface", 6).alias("surface"))


QUERIES["surface_file"] = surface_file
SQL["surface_file"] = f"WITH {world.SQL_POINTS}, {rasters.SQL_RASTER.format(value='z')}, {rasters.SQL_LOOKUP} {rasters._HEAD} round(CASE WHEN NOT outside THEN zs END, 6) AS surface FROM zz"


def mesh_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh of parts, written twice and read as one set: numbers of the second follow those of the first."""
    own, paths = construction.part_mesh(spark, sf_dir), [formats.scratch(spark, f"mesh{n}") for n in "ab"]
    for p in paths:
        formats.write_mesh(*own, p)
    models, vertices, tets = tables.read_meshes(spark, paths)
    counts = [t.groupBy("model_id").agg(F.count(F.lit(1)).alias(n)) for t, n in ((vertices, "n_vertices"), (tets, "n_tets"))]
    return models.select("model_id", "name", "priority").join(counts[0], "model_id").join(counts[1], "model_id")


QUERIES["mesh_files"] = mesh_files
SQL["mesh_files"] = f"""WITH {construction.SQL_PARTS}
SELECT m AS model_id, 'parts' AS name, 7 AS priority, (SELECT count(*) FROM nd) AS n_vertices, (SELECT count(*) FROM tv) AS n_tets FROM (VALUES (0), (1)) v(m)"""


def part_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a sampled model of two blocks."""
    key, price, size = F.col("p_partkey"), F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")
    k = F.floor(key / 1000)
    place = {"i": key % 40, "j": F.floor(key / 40) % 25, "k": k, "x": key % 40 * 100.0, "y": F.floor(key / 40) % 25 * 100.0, "z": k * 50.0 - key % 7 * 0.25 + 25, "depth": k * 50.0, "nominal_depth": k * 48.0}
    values = {"rho": price, "vp": price * 2, "vs": size * 10, "qp": size, "qs": size * 0.5, "alpha": F.lit(1.0)}
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.when(key % 2 == 0, "fine").otherwise("coarse").alias("grid"), *(c.alias(n) for n, c in (place | values).items()))


SQL_MODEL = """m AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'fine' ELSE 'coarse' END AS grid, p_partkey % 40 AS i, p_partkey // 40 % 25 AS j, p_partkey // 1000 AS k,
  p_partkey % 40 * 100.0::DOUBLE AS x, p_partkey // 40 % 25 * 100.0::DOUBLE AS y, p_partkey // 1000 * 50.0::DOUBLE - p_partkey % 7 * 0.25::DOUBLE + 25 AS z,
  p_partkey // 1000 * 50.0::DOUBLE AS depth, p_partkey // 1000 * 48.0::DOUBLE AS nominal_depth, p_retailprice::DOUBLE AS rho, p_retailprice::DOUBLE * 2 AS vp,
  p_size * 10.0::DOUBLE AS vs, p_size::DOUBLE AS qp, p_size * 0.5::DOUBLE AS qs, 1.0::DOUBLE AS alpha FROM part)"""
_SINGLES = ("x", "y", "z", "depth", "nominal_depth", *COMPONENTS)
_SINGLE_SQL = ", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in _SINGLES)


def _doubles(model: DataFrame) -> DataFrame:
    return model.select("grid", *(F.col(c).cast("long").alias(c) for c in "ijk"), *(F.col(c).cast("double").alias(c) for c in _SINGLES))


def model_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, path = part_model(spark, sf_dir), f"{formats.scratch(spark, 'model')}/model.csv"
    formats.write(model, path)
    return _doubles(spark.read.schema(formats.flatten(model).schema).csv(path, header=True))


def model_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised coordinates, appended to in two runs."""
    model, path = part_model(spark, sf_dir), f"{formats.scratch(spark, 'model')}/model.parquet"
    formats.write(model.filter("i < 20"), path, quantise=True)
    formats.append(formats.flatten(formats.quantised(model.filter("i >= 20"))), path, by=("grid",))
    return _doubles(formats.read_back(spark, path))


QUERIES |= {"model_csv": model_csv, "model_parquet": model_parquet}
SQL["model_csv"] = f"WITH {SQL_MODEL} SELECT grid, i, j, k, {_SINGLE_SQL} FROM m"
SQL["model_parquet"] = f"WITH {SQL_MODEL} SELECT grid, i, j, k, {_SINGLE_SQL} FROM (SELECT * REPLACE ({', '.join(f'round({c} / 0.5::DOUBLE) * 0.5::DOUBLE AS {c}' for c in ('x', 'y', 'z', 'depth'))}) FROM m)"


def sfile_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each column of a block begins and ends for a solver that takes nominal depths."""
    path = f"{formats.scratch(spark, 'model')}/model.sfile"
    formats.write(part_model(spark, sf_dir), path, solver="nominal")
    return spark.read.parquet(f"{path}/interfaces").select("grid", "j", "i", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))


def sfile_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{formats.scratch(spark, 'model')}/model.sfile"
    formats.write(part_model(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/material").select("grid", "j", "i", "k", *(F.col(c).cast("double").alias(c.lower()) for c in ("Rho", "Cp", "Cs", "Qp", "Qs")))


QUERIES |= {"sfile_interfaces": sfile_interfaces, "sfile_material": sfile_material}
SQL["sfile_interfaces"] = f"WITH {SQL_MODEL} SELECT grid, j, i, min(nominal_depth) AS top, max(nominal_depth) AS bottom FROM m GROUP BY ALL"
SQL["sfile_material"] = f"WITH {SQL_MODEL} SELECT grid, j, i, k, rho::FLOAT::DOUBLE AS rho, vp::FLOAT::DOUBLE AS cp, vs::FLOAT::DOUBLE AS cs, qp::FLOAT::DOUBLE AS qp, qs::FLOAT::DOUBLE AS qs FROM m"


def basin_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for each nation, clockwise ones among them, with a point given twice."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    ways = F.when(k % 2 == 0, F.array(*map(F.lit, (0, 1, 2, 2, 3)))).otherwise(F.array(*map(F.lit, (0, 3, 2, 2, 1))))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.cast("long").alias("basin"), (1.25 + k * 1.25).alias("x0"), (0.5 + r * 0.5).alias("y0"), F.posexplode(ways).alias("n", "c"))
    return rows.select("basin", "n", (F.col("x0") + F.when(F.col("c").isin(1, 2), 1.0).otherwise(0.0)).alias("x"), (F.col("y0") + F.when(F.col("c") >= 2, 1.0).otherwise(0.0)).alias("y"))


def outline_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.areas(basin_outlines(spark, sf_dir)).select("basin", "area", "points")


def basin_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each basin's area and volume, by its tetrahedra between two sloping surfaces of the raster."""
    nodes, shape = rasters.raster(spark, sf_dir)
    x, y = F.col("ix"), F.col("iy")
    sloping = nodes.select("ix", "iy", (4 + x / 8).alias("roof"), (10 + x / 4 + y / 2).alias("floor"))
    made = basins.triangulated(basins.cleaned(basin_outlines(spark, sf_dir)), sloping, shape, {"roof": 0.01, "floor": 0.01}, max_edge=0.75)
    vertices, tets = basins.prism_model(made, sloping, shape, "roof", "floor")
    sizes = meshes.gather(tets, vertices, ("x", "y", "z")).groupBy("model_id").agg(F.sum(meshes.volume()).alias("v"), F.count(F.lit(1)).alias("n"))
    return sizes.select(F.col("model_id").alias("basin"), F.round("v", 6).alias("volume"), (F.col("n") >= 12).alias("refined"))


QUERIES |= {"outline_areas": outline_areas, "basin_mesh": basin_mesh}
SQL["outline_areas"] = "SELECT n_nationkey::BIGINT AS basin, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS area, 4::BIGINT AS points FROM nation"
SQL["basin_mesh"] = """SELECT n_nationkey::BIGINT AS basin, round(6 + (1.75::DOUBLE + n_nationkey * 1.25::DOUBLE) / 8 + (1.0::DOUBLE + n_regionkey * 0.5::DOUBLE) / 2, 6) AS volume,
       true AS refined FROM nation"""


ROTATED = ((1.0, 0.5, 0.25), (-0.5, 1.0, 4.0))  # from the world to the raster's own coordinates


def tiled(spark: SparkSession, sf_dir: str, tile: int = 8) -> tiles.Tiled:
    """The raster of parts as a surface in a turned frame, written by tile and opened."""
    nodes, shape = rasters.raster(spark, sf_dir, holes=True)
    path = formats.scratch(spark, "tiled")
    tiles.write(nodes, path, shape, spacing=(0.125, 1.0), frame=ROTATED, tile=tile)
    return tiles.read(spark, path)


def surface_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface in its turned frame, sampled at lineitem's places."""
    made = tiled(spark, sf_dir).sample(rasters._points(spark, sf_dir), "surface")
    return made.select(*world.POINT, "z", F.round("surface", 6).alias("surface"))


QUERIES["surface_rotated"] = surface_rotated
SQL["surface_rotated"] = f"""WITH {world.SQL_POINTS.replace("pts AS (", "pts0 AS (", 1)}, pts AS (SELECT * REPLACE (x + y / 2 + 0.25 AS x, y - x / 2 + 4 AS y) FROM pts0),
{rasters.SQL_RASTER.format(value="CASE WHEN key % 11 != 0 THEN z END")}, {rasters.SQL_LOOKUP} {rasters._HEAD} round(CASE WHEN NOT outside THEN zs END, 6) AS surface FROM zz"""


def surface_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of blocks of four by four nodes around a box in the world: the tiles that the box meets are read, others aren't."""
    return tiled(spark, sf_dir).window(tiles.box_outline(0.5, 1.5, 0.25, 1.25), spacing=0.5).select("ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


QUERIES["surface_window"] = surface_window
# The box's corners in the raster's coordinates are 0.875 .. 2.375 and 3.5 .. 5; with the margin of four nodes of 0.125, on whole blocks of four.
SQL["surface_window"] = f"""WITH {rasters.SQL_RASTER.format(value="CASE WHEN key % 11 != 0 THEN z END")},
w AS (SELECT *, greatest(least(greatest(ceil(0.375 * 8), 0), 40) - 1, 0)::BIGINT // 4 * 4 AS x0, least(ceil(least(least(greatest(ceil(2.875 * 8), 0), 40) + 1, 40) / 4.0) * 4, 40) AS x1,
  greatest(least(greatest(ceil(3.0), 0), ny) - 1, 0)::BIGINT // 4 * 4 AS y0, least(ceil(least(least(greatest(ceil(5.5), 0), ny) + 1, ny) / 4.0) * 4, ny) AS y1 FROM ras),
b AS (SELECT ix // 4 AS bx, iy // 4 AS bz, avg(v) AS z FROM w WHERE ix >= x0 AND ix < x1 AND iy >= y0 AND iy < y1 AND ix // 4 < 10 AND iy // 4 < ny // 4 GROUP BY ALL),
f AS (SELECT bx::BIGINT AS ix, bz::BIGINT AS iy, z, (bx * 4 + 1.5::DOUBLE) / 8 - 0.25 AS fx, bz * 4 + 1.5::DOUBLE - 4 AS fy FROM b)
SELECT ix, iy, round((fx - fy / 2) / 1.25, 6) AS x, round((fy + fx / 2) / 1.25, 6) AS y, round(z, 6) AS z FROM f"""


def emod3d_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a block of five by four nodes to each i, written as the solver's files by executors and read back from their bytes."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey") - rasters.p_first(p)
    own = p.select(key.alias("at"), (F.col("p_size") * 64.0 + 1024).alias("rho"), (F.col("p_size") * 32.0 + 2048).alias("vp"), F.col("p_retailprice").alias("vs"))
    full = spark.range(-(-p.count() // 20) * 20).select(F.col("id").alias("at")).join(own, "at", "left")
    block = full.select(F.lit("a").alias("grid"), F.floor(F.col("at") / 20).alias("i"), (F.floor(F.col("at") / 4) % 5).alias("j"), (F.col("at") % 4).alias("k"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rho", "vp", "vs")))
    path = formats.scratch(spark, "emod3d")
    shape = binary.write(block, path)
    return binary.read(spark, path, shape).select("i", "j", "k", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in binary.FILES))


QUERIES["emod3d_bytes"] = emod3d_bytes
SQL["emod3d_bytes"] = """WITH p AS (SELECT p_partkey - min(p_partkey) OVER () AS n, p_size, p_retailprice FROM part),
f AS (SELECT r.n AS n, p_size, p_retailprice FROM (SELECT unnest(generate_series(0, (SELECT (count(*) + 19) // 20 * 20 - 1 FROM part))) AS n) r LEFT JOIN p ON p.n = r.n)
SELECT (n // 20)::BIGINT AS i, (n // 4 % 5)::BIGINT AS j, (n % 4)::BIGINT AS k, round(coalesce((p_size * 64.0::DOUBLE + 1024) / 1000, 0)::FLOAT::DOUBLE, 6) AS rho,
       round(coalesce((p_size * 32.0::DOUBLE + 2048) / 1000, 0)::FLOAT::DOUBLE, 6) AS vp, round(coalesce(p_retailprice / 1000, 0)::FLOAT::DOUBLE, 6) AS vs FROM f"""


TIFF_PLACE = ((0.5, -0.25, 100.0), (-0.25, -0.5, 200.0))  # from a pixel's column and row to the world


def _tiff(spark: SparkSession, sf_dir: str) -> str:
    """The raster of parts as a deflated file of two bands in tiles of 16: sizes with holes, and sizes by column."""
    nodes, shape = rasters.raster(spark, sf_dir, holes=True)
    path = f"{formats.scratch(spark, 'tiff')}/parts.tif"
    tiff_sink.write(nodes.withColumn("w", F.col("z") * 64 + F.col("ix")), path, shape, ("z", "w"), TIFF_PLACE, tile=16)
    return path


def tiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of both bands in a range of columns and rows: tiles outside aren't read."""
    rows = tiff.read(spark, _tiff(spark, sf_dir), [2, 1]).filter("ix >= 9 AND ix < 31 AND iy > 2")
    return rows.select("ix", "iy", F.col("b1").alias("z"), F.col("b2").alias("w"))


def tiff_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's first band as a surface of depths: means of blocks of two by two pixels, with their places."""
    path = _tiff(spark, sf_dir)
    own = convert_tiff(spark, path, formats.scratch(spark, "converted"), 1, 2, True, tile=8)
    return own.window().filter("z IS NOT NULL").select("ix", "iy", *(F.round(c, 6).alias(c) for c in "xyz"))


QUERIES |= {"tiff_window": tiff_window, "tiff_surface": tiff_surface}
_TIFF = rasters.SQL_RASTER.format(value="CASE WHEN key % 11 != 0 THEN z END")
SQL["tiff_window"] = f"""WITH {_TIFF}, px AS (SELECT n % 40 AS ix, n // 40 AS iy FROM (SELECT unnest(generate_series(0, (SELECT max(ny) * 40 - 1 FROM ras))) AS n))
SELECT px.ix::BIGINT AS ix, px.iy::BIGINT AS iy, v AS z, v * 64 + px.ix AS w FROM px LEFT JOIN ras ON ras.ix = px.ix AND ras.iy = px.iy WHERE px.ix >= 9 AND px.ix < 31 AND px.iy > 2"""
SQL["tiff_surface"] = f"""WITH {_TIFF}, e AS (SELECT min(ix) AS x0, min(iy) AS y0, max(ix) - min(ix) + 1 AS nx, max(iy) - min(iy) + 1 AS nz FROM ras WHERE v IS NOT NULL),
b AS (SELECT (ix - x0) // 2 AS bx, (iy - y0) // 2 AS bz, avg(-v) AS z, any_value(x0) AS x0, any_value(y0) AS y0 FROM ras, e
  WHERE ix >= x0 AND iy >= y0 AND (ix - x0) // 2 < nx // 2 AND (iy - y0) // 2 < nz // 2 GROUP BY ALL HAVING z IS NOT NULL),
p AS (SELECT *, x0 + 2 * bx + 0.5::DOUBLE AS px, y0 + 2 * bz + 0.5::DOUBLE AS pz FROM b)
SELECT bx::BIGINT AS ix, bz::BIGINT AS iy, round(100 + 0.5::DOUBLE * px - 0.25::DOUBLE * pz, 6) AS x, round(200 - 0.25::DOUBLE * px - 0.5::DOUBLE * pz, 6) AS y, round(z, 6) AS z FROM p"""


def zarr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as two blocks of chunked arrays, read again but for the first columns: nodes that no part stands for are missing."""
    path = f"{formats.scratch(spark, 'arrays')}/model.zarr"
    arrays.write(part_model(spark, sf_dir), path, chunk=(16, 16, 8))
    return _doubles(arrays.read(spark, path).filter("i >= 17 AND j < 24 AND x IS NOT NULL"))


QUERIES["zarr_round_trip"] = zarr_round_trip
SQL["zarr_round_trip"] = f"WITH {SQL_MODEL} SELECT grid, i, j, k, {_SINGLE_SQL} FROM m WHERE i >= 17 AND j < 24"


def basin_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of three stacked layers of each basin, and whether each layer's bottom is the next one's top at every vertex."""
    nodes, shape = rasters.raster(spark, sf_dir)
    x, y = F.col("ix"), F.col("iy")
    names = ["roof", "shelf", "ledge", "floor"]
    sloping = nodes.select("ix", "iy", (4 + x / 8).alias("roof"), (6 + x / 8 + y / 4).alias("shelf"), (6 + x / 8 + y / 4 + 1).alias("ledge"), (10 + x / 4 + y / 2).alias("floor"))
    made = basins.triangulated(basins.cleaned(basin_outlines(spark, sf_dir)), sloping, shape, dict.fromkeys(names, 0.01), max_edge=0.75).persist()
    columns = basins.at_vertices(made, sloping, shape, names).persist()
    vertices, tets = basins.layered(made, columns, names)
    vertices = vertices.persist()
    sizes = meshes.gather(tets, vertices, ("x", "y", "z")).groupBy("model_id").agg(F.sum(meshes.volume()).alias("v"))
    # a column's odd vertex is its bottom, the even one before it the top
    ends = [vertices.filter(F.col("vid") % 2 == k).select((F.col("model_id") - (1 - k)).alias("model_id"), F.floor(F.col("vid") / 2).alias("c"), F.col("z").alias(f"z{k}")) for k in (0, 1)]
    met = ends[1].join(ends[0], ["model_id", "c"], "left").groupBy("model_id").agg(F.max(F.abs(F.col("z0") - F.col("z1"))).alias("gap"))
    layer = (F.col("model_id") % 3).alias("layer")
    return sizes.join(met, "model_id").select(F.floor(F.col("model_id") / 3).alias("basin"), layer, F.round("v", 6).alias("volume"), F.when(layer < 2, F.col("gap")).alias("gap"))


_BAND, _STEP, _SHORE = 0.5, 0.0625, 0.8125


def basin_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as places around the basins: their opacity, and whether a basin with its band of water holds them; NULL within two steps of the border."""
    o, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "nation"))
    at = o.join(nations, F.col("o_custkey") % 25 == F.col("n_nationkey"))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    x, y = 0.5 + k * 1.25 + F.col("o_orderkey") * 37 % 1024 * 0.00244140625, r * 0.5 - 0.25 + F.col("o_orderkey") * 11 % 1021 * 0.00244140625
    places = at.select("o_orderkey", k.cast("long").alias("basin"), x.alias("x"), y.alias("y"), (1.25 + k * 1.25).alias("x0"), (0.5 + r * 0.5).alias("y0"))
    rings = basins.cleaned(basin_outlines(spark, sf_dir)).persist()
    shore = [(-9.0, -9.0), (99.0, -9.0), (99.0, _SHORE), (-9.0, _SHORE)]
    land = spark.createDataFrame([("land", n, px, py) for n, (px, py) in enumerate(shore)], "ring string, n int, x double, y double")
    border = basins.outline_segments(bands.grown(rings, _BAND, _STEP, land)).select("basin", "ax", "ay", "bx", "by")
    held = bands.odd(places.select("basin", "x", "y"), border, 1.0, ("basin",)).withColumn("held", F.lit(True))
    told = bands.opacity(places, rings, _BAND).join(held, ["basin", "x", "y"], "left")
    # the border as it would be without a lattice, told by the squares' own distances
    px, py, x0, y0 = (F.col(c) for c in ("x", "y", "x0", "y0"))
    out, zero = (lambda low, high, p: F.greatest(low - p, p - high, F.lit(0.0))), F.lit(0.0)
    within = F.least(px - x0, x0 + 1 - px, py - y0, y0 + 1 - py)
    own = F.when(within > 0, -within).otherwise(F.hypot(out(x0, x0 + 1, px), out(y0, y0 + 1, py)))
    water = F.hypot(out(x0, x0 + 1, px), out(F.greatest(y0, zero + _SHORE), y0 + 1, py)) - _BAND
    clear = F.abs(F.least(own, F.greatest(water, _SHORE - py))) > 2 * _STEP
    return told.select("o_orderkey", "basin", F.round("alpha", 6).alias("alpha"), F.when(clear, F.coalesce("held", F.lit(False))).alias("held"))


QUERIES |= {"basin_layers": basin_layers, "basin_band": basin_band}
SQL["basin_layers"] = """SELECT n_nationkey::BIGINT AS basin, layer::BIGINT AS layer, CASE WHEN layer < 2 THEN 0.0::DOUBLE END AS gap,
       round(CASE layer WHEN 0 THEN 2 + (1.0::DOUBLE + n_regionkey * 0.5::DOUBLE) / 4 WHEN 1 THEN 1.0::DOUBLE
             ELSE 3 + (1.75::DOUBLE + n_nationkey * 1.25::DOUBLE) / 8 + (1.0::DOUBLE + n_regionkey * 0.5::DOUBLE) / 4 END, 6) AS volume
FROM nation CROSS JOIN range(3) t(layer)"""
SQL["basin_band"] = f"""WITH p AS (SELECT o_orderkey, n_nationkey::BIGINT AS basin, 0.5::DOUBLE + n_nationkey * 1.25::DOUBLE + o_orderkey * 37 % 1024 * 0.00244140625::DOUBLE AS x,
             n_regionkey * 0.5::DOUBLE - 0.25::DOUBLE + o_orderkey * 11 % 1021 * 0.00244140625::DOUBLE AS y, 1.25::DOUBLE + n_nationkey * 1.25::DOUBLE AS x0, 0.5::DOUBLE + n_regionkey * 0.5::DOUBLE AS y0
      FROM orders JOIN nation ON o_custkey % 25 = n_nationkey),
d AS (SELECT *, least(x - x0, x0 + 1 - x, y - y0, y0 + 1 - y) AS within, greatest(x0 - x, x - x0 - 1, 0.0::DOUBLE) AS dx, greatest(y0 - y, y - y0 - 1, 0.0::DOUBLE) AS dy,
             greatest(greatest(y0, {_SHORE}::DOUBLE) - y, y - y0 - 1, 0.0::DOUBLE) AS wy FROM p),
f AS (SELECT *, sqrt(dx * dx + dy * dy) AS far, least(CASE WHEN within > 0 THEN -within ELSE sqrt(dx * dx + dy * dy) END, greatest(sqrt(dx * dx + wy * wy) - {_BAND}::DOUBLE, {_SHORE}::DOUBLE - y)) AS f FROM d)
SELECT o_orderkey, basin, round(CASE WHEN within > 0 THEN 1.0::DOUBLE ELSE 1 - least(far / {_BAND}::DOUBLE, 1.0::DOUBLE) END, 6) AS alpha,
       CASE WHEN abs(f) > {2 * _STEP}::DOUBLE THEN f < 0 END AS held FROM f"""
