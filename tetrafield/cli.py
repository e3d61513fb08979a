"""python -m tetrafield.cli: generate a model from a request, make and check the meshes it needs, list what is registered, or run a query."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import SparkSession

from .functions import crs, numeric
from .operators import basins
from .plans import config, construction, plugins
from .sinks import formats
from .sources import tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tetrafield", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="sample a request's grid and write the model")
    generate.add_argument("request")
    generate.add_argument("output")
    generate.add_argument("--format", choices=sorted(formats.formats()))
    generate.add_argument("--config-format", choices=["toml", "yaml", "json"])
    generate.add_argument("--quantise", action="store_true")
    commands.add_parser("plugins", help="list grids, layers and formats")
    query = commands.add_parser("query", help="run a registered query and print its first rows")
    query.add_argument("name")
    query.add_argument("tables")
    tomography = commands.add_parser("tomography", help="a mesh of a tomography table")
    tomography.add_argument("table")
    tomography.add_argument("output")
    tomography.add_argument("--name", default="tomography")
    tomography.add_argument("--origin", type=float, nargs=2, metavar=("LON", "LAT"), help="of the table's frame, in degrees; without one it is in the world's kilometres")
    tomography.add_argument("--turn", type=float, default=0.0, help="of the frame, in degrees")
    tomography.add_argument("--mirror", action="store_true", help="the frame's x axis runs the other way")
    surface = commands.add_parser("surface", help="an upright surface in metres of a raster in degrees")
    surface.add_argument("raster")
    surface.add_argument("output")
    surface.add_argument("--value", default="value")
    surface.add_argument("--spacing", type=float)
    surface.add_argument("--flip", action="store_true", help="turn elevations into depths")
    convert = commands.add_parser("convert-tiff", help="a tiled surface of a TIFF's band")
    convert.add_argument("tiff")
    convert.add_argument("band", type=int)
    convert.add_argument("output")
    convert.add_argument("--downsample", type=int, default=1, help="means of blocks of this many pixels along each axis")
    convert.add_argument("--flip", action="store_true", help="turn elevations into depths")
    basin = commands.add_parser("basin", help="meshes of basins of one layer or several between surfaces")
    basin.add_argument("outlines", help="GeoJSON")
    basin.add_argument("surfaces", help="Parquet table of nodes x, y and surfaces")
    basin.add_argument("output")
    basin.add_argument("--bottom", required=True, nargs="+", help="the surface under each layer, from the top down")
    basin.add_argument("--top")
    basin.add_argument("--ground")
    basin.add_argument("--model", required=True, nargs="+", help="of each layer: a 1-D model's file, or rho=..,vp=..,vs=..,qp=..,qs=..")
    basin.add_argument("--layer-bottoms", type=float, nargs="+")
    basin.add_argument("--name", default="basin")
    basin.add_argument("--priority", type=int, nargs="+", default=[10], help="of each layer, or of all")
    basin.add_argument("--smoothing", type=float, default=0.0, help="width in metres of the band over water in which the basin fades out")
    basin.add_argument("--coastline", help="GeoJSON of the land, without which there is no band")
    basin.add_argument("--no-pad-top", action="store_true", help="don't raise the first layer's top")
    basin.add_argument("--tolerance", type=float, default=10.0, help="metres")
    basin.add_argument("--max-edge", type=float, default=math.inf)
    basin.add_argument("--least-area", type=float, default=0.0)
    validate = commands.add_parser("validate", help="check meshes; fails where a tetrahedron is flat")
    validate.add_argument("meshes", nargs="+")
    validate.add_argument("--least-volume", type=float, default=1e-6)
    synthetic = commands.add_parser("synthetic", help="write a small world's inputs")
    synthetic.add_argument("folder")
    synthetic.add_argument("--spacing", type=float, default=1000.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tetrafield").getOrCreate()
    if args.command == "plugins":
        plugins.discover()
        plugins.listing(spark).show(200, truncate=False)
    elif args.command == "query":
        from .queries import QUERIES

        QUERIES[args.name](spark, args.tables).show()
    elif args.command == "tomography":
        frame = numeric.model_frame(*(crs.TransverseMercator().point(*args.origin) if args.origin else (0.0, 0.0)), args.turn, args.mirror)
        formats.write_mesh(*construction.tomography_model(spark, args.table, args.name, frame), args.output)
    elif args.command == "surface":
        construction.upright_surface(spark, args.raster, args.value, args.spacing, args.flip).write.mode("overwrite").parquet(args.output)
    elif args.command == "convert-tiff":
        construction.convert_tiff(spark, args.tiff, args.output, args.band, args.downsample, args.flip)
    elif args.command == "basin":
        count = len(args.bottom)
        priorities = args.priority * count if len(args.priority) == 1 else args.priority
        if len(args.model) != count or len(priorities) != count:
            parser.error(f"{count} surfaces to end layers at, {len(args.model)} models and {len(args.priority)} priorities")
        layers = [construction.Layer(b, construction.model_of(spark, m, args.layer_bottoms), p) for b, m, p in zip(args.bottom, args.model, priorities)]
        band = None
        if args.smoothing > 0 and args.coastline:
            band = construction.Band(args.smoothing, tables.read_geojson(spark, args.coastline))
        pad = 0.0 if args.no_pad_top else basins.PAD
        made = construction.basin_layers(spark, args.outlines, args.surfaces, layers, args.name, args.top, args.ground, args.tolerance, args.max_edge, args.least_area, band, pad)
        formats.write_mesh(*made, args.output)
    elif args.command == "validate":
        wrong = False
        for path in args.meshes:
            found = construction.report(spark, path, args.least_volume).persist()
            found.show(200, truncate=False)
            wrong |= not found.filter("NOT ok").isEmpty()
        return int(wrong)
    elif args.command == "synthetic":
        construction.write_synthetic(spark, args.folder, spacing=args.spacing)
    else:
        try:
            request = config.load(args.request, args.config_format)
        except config.ConfigError as e:
            print(f"{args.request}: {e}")
            return 2
        try:
            made = config.run(spark, request)
        except config.ConfigError as e:
            print(f"{args.request}: {e}")
            return 2
        formats.write(made, args.output, args.format, args.quantise)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
