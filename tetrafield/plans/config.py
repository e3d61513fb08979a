"""Requests as files: a grid, a chain of layers, metadata; checked before anything runs."""

from __future__ import annotations

import json
import math
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..operators import footprints, grids, layers, locate, meshes, tiles
from ..sources import tables


class ConfigError(ValueError):
    pass


# Keys by type: those that must be given, and those that may be.
GRIDS = {
    "regular": ({"surface", "extent_x", "extent_y", "thickness", "resolution_x", "resolution_y", "resolution_z"}, {"orientation", "chunks"}),
    "sw4": ({"surface", "extent_x", "extent_y", "refinements"}, {"orientation", "decay", "chunks"}),
    "emod3d": ({"surface", "nx", "ny", "nz", "resolution", "decay"}, {"orientation", "chunks"}),
    "borehole": ({"surface", "sites", "depth", "resolution_z"}, {"projection", "sites_crs", "keep_extra_columns", "chunks"}),
}
LAYERS = {
    "query": ({"model_path"}, {"model_globs"}), "coastline": ({"coastline"}, set()), "ely": ({"vs30"}, {"depth_t"}), "offshore": ({"basin_depth", "model"}, set()),
    "clamp": (set(), {"clamps", "min_vp_vs_ratio", "max_vp_vs_ratio"}), "backus": ({"samples"}, set()), "constant": (set(), {"rho", "vp", "vs", "qp", "qs", "alpha"}),
}
# Keys below those, by where they stand.
ORIENTATION = {"origin_x", "origin_y", "origin_lon", "origin_lat", "azimuth", "crs"}
NESTED = {
    "chunks": {"i", "j", "k"}, "decay": {"type", "length", "ratio", "scale"}, "refinements": {"resolution", "bottom"},
    "basin_depth": {"distance", "bottom_depth"}, "model": {"bottom_depth", "rho", "vp", "vs", "qp", "qs", "alpha"},
    "clamps": {"min", "max", "min_ref", "max_ref", "floors"}, "floors": {"depth", "elevation", "min"},
}
# Metadata, fixed values: texts, and lists of texts.
METADATA_TEXTS = {
    "title", "id", "description", "version", "history", "comment", "license", "auxiliary", "creator_name", "creator_email", "creator_institution",
    "acknowledgement", "repository_doi", "repository_name", "repository_url",
}
METADATA_LISTS = {"keywords", "authors", "references"}
METADATA = METADATA_TEXTS | METADATA_LISTS
WORLD = "EPSG:2193"  # where no system is named
LONGITUDES, LATITUDES = (-180.0, 180.0), (-90.0, 90.0)
_CLASSES = {"query": layers.Query, "coastline": layers.Coastline, "ely": layers.Ely, "offshore": layers.Offshore, "clamp": layers.Clamp, "backus": layers.Backus, "constant": layers.Constant}
_GRID_BUILDERS: dict[str, Callable] = {}
_LAYER_BUILDERS: dict[str, Callable] = {}


def register_grid(name: str, build: Callable[..., DataFrame], required: set[str], optional: set[str] = frozenset()) -> None:
    """build(spark, config, surface) makes the points."""
    if name in GRIDS:
        raise ConfigError(f"grid type {name!r} exists")
    GRIDS[name], _GRID_BUILDERS[name] = (set(required), set(optional)), build


def register_layer(name: str, build: Callable[..., layers.Layer], required: set[str] = frozenset(), optional: set[str] = frozenset(), kind: type = layers.Layer) -> None:
    """build(below, config, resources) makes the layer."""
    if name in LAYERS:
        raise ConfigError(f"layer type {name!r} exists")
    LAYERS[name], _LAYER_BUILDERS[name], _CLASSES[name] = (set(required), set(optional)), build, kind


@dataclass
class Request:
    grid: dict[str, Any]
    layers: list[dict[str, Any]]
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        _check("grid", self.grid, GRIDS)
        _metadata(self.metadata)
        _orientation(self.grid.get("orientation", {}))
        for where in ("chunks", "decay"):
            _only(f"grid.{where}", self.grid.get(where) or {}, NESTED[where])
        for name, block in (self.grid.get("refinements") or {}).items():
            _only(f"grid.refinements.{name}", block, NESTED["refinements"], NESTED["refinements"])
        for key in ("projection", "sites_crs"):
            given = self.grid.get(key)
            if isinstance(given, dict):
                _only(f"grid.{key}", given, {"crs"}, {"crs"})
                given = given["crs"]
            if given is not None:
                self.grid = self.grid | {key: crs_name(given)}
                if key == "sites_crs" and crs.number(given) not in crs.DEGREES:
                    raise ConfigError(f"grid.sites_crs: sites come in degrees, which {crs_name(given)} isn't known for; projected ones go through grids.borehole")
                if key == "projection":
                    _projection("grid.projection", given)
        for n, layer in enumerate(self.layers):
            _check(f"layer {n}", layer, LAYERS)
            for where in ("basin_depth", "model"):
                for own in layer.get(where, []) if layer["type"] == "offshore" else []:
                    _only(f"layer {n}: {where}", own, NESTED[where], NESTED[where] - {"alpha"})
            for c, bound in layer.get("clamps", {}).items() if layer["type"] == "clamp" else []:
                _only(f"layer {n}: clamps.{c}", bound, NESTED["clamps"])
                for floor in bound.get("floors", []):
                    _only(f"layer {n}: floors of {c}", floor, NESTED["floors"], {"min"})
        for key in ("extent_x", "extent_y", "thickness", "resolution", "resolution_x", "resolution_y", "resolution_z", "depth", "nx", "ny", "nz"):
            if key in self.grid and not (_is_number(self.grid[key]) and self.grid[key] > 0):
                raise ConfigError(f"grid.{key} must be a positive number")
        if self.grid["type"] == "borehole":
            if self.grid["depth"] < self.grid["resolution_z"]:
                raise ConfigError("grid.depth must be at least grid.resolution_z")
            if isinstance(self.grid["sites"], list):
                _sites(self.grid["sites"], self.grid.get("keep_extra_columns", True))
            elif not isinstance(self.grid["sites"], str):
                raise ConfigError("grid.sites is a list of sites or a path")
        if self.grid["type"] == "regular" and self.grid["thickness"] < self.grid["resolution_z"]:
            raise ConfigError("grid.thickness must be at least grid.resolution_z")
        if "refinements" in self.grid:
            grids.check_refinements({k: (v["resolution"], v["bottom"]) for k, v in self.grid["refinements"].items()})
        try:
            layers.check_order([_CLASSES[x["type"]] for x in self.layers])
        except ValueError as e:
            raise ConfigError(str(e)) from e


def _only(where: str, given: Any, known: set[str], needed: set[str] = frozenset()) -> None:
    if not isinstance(given, dict):
        raise ConfigError(f"{where} must be a table")
    if extra := set(given) - known:
        raise ConfigError(f"{where} has unknown keys {sorted(extra)}")
    if lacking := needed - set(given):
        raise ConfigError(f"{where} lacks {sorted(lacking)}")


def _is_number(given: Any) -> bool:
    return isinstance(given, (int, float)) and not isinstance(given, bool) and math.isfinite(given)


def _metadata(given: Any) -> None:
    _only("metadata", given, METADATA)
    for key, value in given.items():
        if key in METADATA_LISTS:
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ConfigError(f"metadata.{key} must be a list of texts")
        elif not isinstance(value, str):
            raise ConfigError(f"metadata.{key} must be a text")


def crs_name(given: Any) -> str:
    """A reference system as text, from that or from its number."""
    try:
        return f"EPSG:{crs.number(given)}"
    except ValueError as e:
        raise ConfigError(str(e)) from e


def _projection(where: str, given: Any) -> crs.TransverseMercator:
    try:
        return crs.of(given)
    except ValueError as e:
        raise ConfigError(f"{where}: {e}") from e


def _place(where: str, lon: Any, lat: Any) -> None:
    for name, value, (low, high) in (("longitude", lon, LONGITUDES), ("latitude", lat, LATITUDES)):
        if not _is_number(value) or not low <= value <= high:
            raise ConfigError(f"{where}: the {name} must be between {low:g} and {high:g}, not {value!r}")


def _sites(sites: list, keep: bool) -> None:
    """Inline sites: at least one, each with a place and the same labels, none of which names a column of the grid."""
    if not sites:
        raise ConfigError("a borehole grid needs at least one site")
    labels: set[str] | None = None
    for n, site in enumerate(sites):
        _only(f"grid.sites {n}", site, set(site) if isinstance(site, dict) else set(), {"longitude", "latitude"})
        _place(f"grid.sites {n}", site["longitude"], site["latitude"])
        own = set(site) - {"longitude", "latitude"}
        labels = own if labels is None else labels
        if own != labels:
            raise ConfigError(f"grid.sites {n} has the labels {sorted(own)}, and the first site {sorted(labels)}")
        if odd := [k for k in sorted(own) if not isinstance(site[k], (str, int, float, bool))]:
            raise ConfigError(f"grid.sites {n}: labels {odd} must be texts, numbers or truth values")
    if keep:
        try:
            grids.check_labels(sorted(labels or ()))
        except ValueError as e:
            raise ConfigError(f"grid.sites: {e}; rename them or set keep_extra_columns = false") from e


def _orientation(o: dict[str, Any]) -> None:
    _only("grid.orientation", o, ORIENTATION)
    for pair in (("origin_x", "origin_y"), ("origin_lon", "origin_lat")):
        if len(set(pair) & set(o)) == 1:
            raise ConfigError(f"grid.orientation needs both {pair[0]} and {pair[1]}")
    if {"origin_x", "origin_lon"} <= set(o):
        raise ConfigError("grid.orientation has two origins")
    for key in set(o) - {"crs"}:
        if not _is_number(o[key]):
            raise ConfigError(f"grid.orientation.{key} must be a number")
    if "origin_lon" in o:
        _place("grid.orientation", o["origin_lon"], o["origin_lat"])
    _projection("grid.orientation.crs", o.get("crs", WORLD))


def frame_of(orientation: dict[str, Any]) -> grids.Frame:
    """The frame of a request: an origin in degrees is projected, and its azimuth, which is from true north, turned to grid north."""
    o, azimuth = orientation, float(orientation.get("azimuth", 0.0))
    if "origin_lon" in o:
        system, place = _projection("grid.orientation.crs", o.get("crs", WORLD)), (o["origin_lon"], o["origin_lat"])
        return grids.Frame(*system.point(*place), grids.grid_azimuth(azimuth, *place, system))
    return grids.Frame(o.get("origin_x", 0.0), o.get("origin_y", 0.0), azimuth)


def _check(where: str, given: dict[str, Any], types: dict) -> None:
    kind = given.get("type")
    if kind not in types:
        raise ConfigError(f"{where}: unknown type {kind!r}; there are {sorted(types)}")
    required, optional = types[kind]
    own = set(given) - {"type"}
    if lacking := required - own:
        raise ConfigError(f"{where} ({kind}) lacks {sorted(lacking)}")
    if extra := own - required - optional:
        raise ConfigError(f"{where} ({kind}) has unknown keys {sorted(extra)}")


def load(path: str | Path, format: str | None = None) -> Request:
    """From TOML, YAML or JSON, by suffix; TOML where the suffix says nothing."""
    text, kind = Path(os.path.expandvars(path)).read_text(encoding="utf-8"), format or Path(path).suffix.lstrip(".").lower()
    if kind in ("yaml", "yml"):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text) if kind == "json" else tomllib.loads(text)
    if extra := set(raw) - {"grid", "layers", "metadata"}:
        raise ConfigError(f"unknown sections {sorted(extra)}")
    if "grid" not in raw:
        raise ConfigError("a request needs a grid")
    return Request(_expanded(raw["grid"]), _expanded(raw.get("layers", [])), raw.get("metadata", {}))


def _expanded(given: Any) -> Any:
    """Environment variables in a request's texts, such as $DATA/dem.parquet, at any depth; unknown ones stay."""
    if isinstance(given, dict):
        return {k: _expanded(v) for k, v in given.items()}
    if isinstance(given, list):
        return [_expanded(v) for v in given]
    return os.path.expandvars(given) if isinstance(given, str) else given


def build_points(spark: SparkSession, request: Request, surface: grids.Surface) -> DataFrame:
    g = request.grid
    frame = frame_of(g.get("orientation", {}))
    decay = dict(g.get("decay") or {})
    kind = decay.pop("type", None)
    match g["type"]:
        case "regular":
            return grids.regular(spark, surface, g["extent_x"], g["extent_y"], g["thickness"], g["resolution_x"], g["resolution_y"], g["resolution_z"], frame)
        case "sw4":
            return grids.sw4(spark, surface, g["extent_x"], g["extent_y"], {k: (v["resolution"], v["bottom"]) for k, v in g["refinements"].items()}, frame, kind, **decay)
        case "emod3d":
            return grids.emod3d(spark, surface, g["nx"], g["ny"], g["nz"], g["resolution"], kind, frame, **decay)
        case "borehole":
            sites = tables.inline_sites(spark, g["sites"]) if isinstance(g["sites"], list) else tables.read_sites(spark, g["sites"])
            x, y = _projection("grid.projection", g.get("projection", WORLD)).forward(F.col("longitude"), F.col("latitude"))
            labels = [c for c in sites.columns if c not in ("i", "longitude", "latitude")] if g.get("keep_extra_columns", True) else []
            return grids.borehole(sites.withColumns({"x": x, "y": y}), surface, g["depth"], g["resolution_z"], labels)
    return _GRID_BUILDERS[g["type"]](spark, g, surface)


def check_levels(spark: SparkSession, request: Request, lowest: float, highest: float) -> None:
    """Raises where the request's levels cross over a surface between the two."""
    g = request.grid
    options = dict(g.get("decay") or {})
    kind = options.pop("type", None)
    if g["type"] == "emod3d":
        levels = [k * float(g["resolution"]) for k in range(int(g["nz"]))]
        options = {"length": g["nz"] * g["resolution"]} | options
    elif g["type"] == "sw4":
        blocks = grids.check_refinements({k: (v["resolution"], v["bottom"]) for k, v in g["refinements"].items()})
        if kind is None:  # only the first block is bent: to its flat bottom
            kind, options, blocks = "linear", {"length": blocks[0][2]}, blocks[:1]
        else:
            options = {"length": blocks[0][2]} | options
        tops = [0.0, *(b for _, _, b in blocks)]
        levels = sorted({top + k * r for top, (_, r, bottom) in zip(tops, blocks) for k in range(round((bottom - top) / r) + 1)})
    else:
        return
    try:
        grids.check_folds(spark, lowest, highest, levels, kind, **options)
    except ValueError as e:
        raise ConfigError(str(e)) from e


def surface_of(spark: SparkSession, given: Any) -> grids.Surface:
    """A request's surface: a number, the path of a Parquet table of nodes (x, y, z), or of a tiled surface's folder (.surface), whose edge extends."""
    if isinstance(given, (int, float)) and not isinstance(given, bool):
        return lambda rows, name: rows.withColumn(name, F.lit(float(given)))
    if isinstance(given, str) and given.rstrip("/").lower().endswith(".surface"):
        own = tiles.read(spark, given.rstrip("/"))
        return lambda rows, name: own.sample(rows, name, extrapolate=True)
    if not isinstance(given, str) or not given.rstrip("/").lower().endswith((".parquet", ".pq")):
        raise ConfigError(f"a surface is a number or the path of a Parquet table of nodes x, y, z or of a .surface folder; not {given!r}")
    return tables.read_surface(spark, given)


def resources_of(spark: SparkSession, request: Request) -> dict[str, Any]:
    """What the layers refer to by path: outlines as segments, site velocities as surfaces."""
    from ..operators import coastline

    found: dict[str, Any] = {}
    for x in request.layers:
        if x["type"] == "coastline":
            found[x["coastline"]] = coastline.segments(tables.read_rings(spark, x["coastline"]))
        elif x["type"] == "ely":
            found[x["vs30"]] = surface_of(spark, x["vs30"])
    return found


def load_models(spark: SparkSession, paths: list[str], domain: footprints.Outline | None = None) -> locate.Index:
    """The index of checked meshes. Those whose footprints miss the domain, a convex outline, are left out and not read."""
    models, vertices, tets = tables.read_meshes(spark, paths, (lambda m: footprints.prune(m, domain)) if domain else None)
    if domain and models.isEmpty():
        raise ConfigError(f"none of the {len(paths)} models meets the request's points, which lie between {', '.join(f'({x:g}, {y:g})' for x, y in domain)}")
    meshes.validate(models, tets)
    return locate.build_index(models, vertices, tets)


def looked_at(points: DataFrame, frame: grids.Frame) -> tuple[footprints.Outline | None, tuple[float, float] | None]:
    """The corners of the box, along the frame's axes, around the points, and the range of the surface, from the first level of each column: None where there is none."""
    ground, turn = F.col("z") - F.col("depth"), frame.matrix[:2, :2]
    u, v = (F.col("x") * float(a) + F.col("y") * float(b) for a, b in np.linalg.inv(turn))
    r = points.filter("k = 0").agg(F.min(u), F.max(u), F.min(v), F.max(v), F.min(ground), F.max(ground)).first()
    box = None if None in r[:4] else [tuple(map(float, turn @ p)) for p in ((r[0], r[2]), (r[1], r[2]), (r[1], r[3]), (r[0], r[3]))]
    return box, (None if None in r[4:] else (r[4], r[5]))


def build_chain(spark: SparkSession, request: Request, resources: dict[str, Any], domain: footprints.Outline | None = None) -> layers.Layer:
    """resources: named surfaces and segment tables that layers refer to; domain: where the points are, so that models elsewhere aren't indexed."""

    def make(x: dict[str, Any], below: layers.Layer) -> layers.Layer:
        match x["type"]:
            case "query":
                found = layers.discover(x["model_path"], x.get("model_globs", ["*.mesh"]))
                return layers.Query(load_models(spark, [str(p) for p in found], domain))
            case "coastline":
                return layers.Coastline(below, resources[x["coastline"]])
            case "ely":
                return layers.Ely(below, resources[x["vs30"]], x.get("depth_t", 450.0))
            case "offshore":
                return layers.Offshore(below, [(d["distance"], d["bottom_depth"]) for d in x["basin_depth"]], [layers.OffshoreLayer(**m) for m in x["model"]])
            case "clamp":
                bounds = {c: layers.Bound(**{**b, "floors": tuple(("depth", f["depth"], f["min"]) if "depth" in f else ("elevation", f["elevation"], f["min"]) for f in b.get("floors", []))}) for c, b in x.get("clamps", {}).items()}
                return layers.Clamp(below, bounds, x.get("min_vp_vs_ratio"), x.get("max_vp_vs_ratio"))
            case "backus":
                return layers.Backus(below, x["samples"])
            case "constant":
                return layers.Constant(**{k: v for k, v in x.items() if k != "type"})
        return _LAYER_BUILDERS[x["type"]](below, x, resources)

    chain: layers.Layer = layers.Layer()
    for x in reversed(request.layers):
        chain = make(x, chain)
    return chain


def run(spark: SparkSession, request: Request, surface: grids.Surface | None = None, resources: dict[str, Any] | None = None) -> DataFrame:
    """The sampled model: one plan from points to components. What isn't given is read from the paths in the request."""
    surface = surface_of(spark, request.grid["surface"]) if surface is None else surface
    resources = resources_of(spark, request) if resources is None else resources
    points = build_points(spark, request, surface)
    domain = None
    if any(x["type"] == "query" for x in request.layers) or request.grid["type"] in ("sw4", "emod3d"):
        domain, ground = looked_at(points, frame_of(request.grid.get("orientation", {})))
        if ground is not None:
            check_levels(spark, request, *ground)
    return layers.evaluate(build_chain(spark, request, resources, domain), points)
