"""Surfaces on disk by tile: windows read the tiles they meet, and a frame places a raster anywhere in the world.

A surface is a folder: `cells`, a Parquet table partitioned by (tile_x, tile_y) with a row for each node that holds its own value and
those of its neighbours to the right, below and across, and `about`, its shape, place and frame. A tile so needs no other
tile: looking values up is a scan of the tiles in question and an equi-join on the cell, without windows over rows and columns.

The frame is an affine map from the world to the raster's own coordinates, in which its axes are upright and evenly spaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from . import surfaces

TILE = 512
EDGE_POINTS = 21  # on each side of a box in degrees, whose sides are curves in metres

Box = tuple[float, float, float, float]  # least and greatest x, least and greatest y


@dataclass
class Tiled:
    """An opened surface."""

    spark: SparkSession
    path: str
    shape: tuple[int, int]
    origin: tuple[float, float]
    spacing: tuple[float, float]
    frame: list[list[float]] = field(default_factory=lambda: [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    tile: int = TILE

    def to_frame(self, x: Column, y: Column) -> tuple[Column, Column]:
        return tuple(numeric.affine(self.frame, x, y))

    def place(self, x: float, y: float) -> tuple[float, float]:
        """A point of the world in the raster's coordinates."""
        a = np.asarray(self.frame) @ (x, y, 1.0)
        return float(a[0]), float(a[1])

    @property
    def inverse(self) -> list[list[float]]:
        """From the raster's coordinates to the world."""
        linear = np.linalg.inv(np.asarray(self.frame)[:, :2])
        return np.column_stack([linear, -linear @ np.asarray(self.frame)[:, 2]]).tolist()

    def from_frame(self, x: Column, y: Column) -> tuple[Column, Column]:
        return tuple(numeric.affine(self.inverse, x, y))

    @property
    def corners(self) -> np.ndarray:
        """The world's (x, y) of the four corner nodes."""
        ends = [(o, o + (n - 1) * s) for o, s, n in zip(self.origin, self.spacing, self.shape, strict=True)]
        own = np.array([(x, y, 1.0) for y in ends[1] for x in ends[0]])
        return own @ np.asarray(self.inverse).T

    @property
    def box(self) -> Box:
        c = self.corners
        return c[:, 0].min(), c[:, 0].max(), c[:, 1].min(), c[:, 1].max()

    def numbers(self, outline: Sequence[tuple[float, float]] | None, factor: int = 1) -> tuple[tuple[int, int], tuple[int, int]]:
        """Ranges of (ix, iy), ends excluded, that cover an outline in the world with a margin, on whole blocks of `factor`."""
        if outline is None:
            return (0, self.shape[0]), (0, self.shape[1])
        own = np.array([self.place(*p) for p in outline])
        margin, out = factor * min(self.spacing), []
        for a in (0, 1):
            n = self.shape[a]
            at = lambda v: min(max(math.ceil((v - self.origin[a]) / self.spacing[a] - 1e-9), 0), n)  # noqa: B023, E731  the first node at or beyond
            start, stop = max(at(own[:, a].min() - margin) - 1, 0), min(at(own[:, a].max() + margin) + 1, n)
            out.append((start // factor * factor, min(-(-stop // factor) * factor, n)))
        return out[0], out[1]

    def cells(self, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> DataFrame:
        """Rows of cells whose numbers lie in the ranges, ends excluded. The scan leaves out all other tiles."""
        rows = self.spark.read.parquet(f"{self.path}/cells")
        for a, r in (("x", x), ("y", y)):
            if r is not None:
                rows = rows.filter(F.col(f"tile_{a}").between(r[0] // self.tile, max(r[1] - 1, 0) // self.tile) & (F.col(f"i{a}") >= r[0]) & (F.col(f"i{a}") < r[1]))
        return rows.drop("tile_x", "tile_y")

    def placed(self, nodes: DataFrame) -> DataFrame:
        """nodes (ix, iy, ...; numbers may lie between two nodes) with the world's x and y."""
        own = [F.lit(o) + F.col(f"i{a}") * s for a, o, s in zip("xy", self.origin, self.spacing, strict=True)]
        x, y = self.from_frame(*own)
        return nodes.withColumns({"x": x, "y": y})

    def window(self, outline: Sequence[tuple[float, float]] | None = None, spacing: float | None = None) -> DataFrame:
        """(ix, iy, x, y, z) of the nodes around an outline, or of blocks of nodes of about `spacing`, whose mean z ignores missing values.

        Blocks begin at multiples of their size, so those of any two windows agree; what the raster cuts off isn't a block.
        """
        factor = 1 if spacing is None else max(1, round(spacing / min(self.spacing)))
        x, y = self.numbers(outline, factor)
        nodes = self.cells(x, y).select("ix", "iy", F.col("z00").alias("z"))
        if factor == 1:
            return self.placed(nodes)
        means = surfaces.coarsen(nodes, factor, self.shape)
        middle = {f"i{a}": F.col(f"i{a}") * factor + (factor - 1) / 2 for a in "xy"}
        own = self.placed(means.withColumns({f"_{k}": F.col(k) for k in ("ix", "iy")}).withColumns(middle))
        return own.select(F.col("_ix").alias("ix"), F.col("_iy").alias("iy"), "x", "y", "z")

    def value_range(self, outline: Sequence[tuple[float, float]] | None = None) -> DataFrame:
        return surfaces.value_range(self.cells(*self.numbers(outline)).select(F.col("z00").alias("z")))

    def sample(self, points: DataFrame, name: str = "surface", extrapolate: bool = False, outline: Sequence[tuple[float, float]] | None = None) -> DataFrame:
        """points (x, y, ...) with the surface's value. An outline that holds all points keeps the scan to its tiles."""
        x, y = self.numbers(outline)
        table = self.cells(x, y).select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "z00", "z10", "z01", "z11")
        size = max(x[1] - x[0], 0) * max(y[1] - y[0], 0)
        return surfaces.bilinear(points, table, self.shape, self.origin, self.spacing, self.frame, extrapolate, name, table=F.broadcast(table) if size <= surfaces.BROADCAST_NODES else table)


def write(nodes: DataFrame, path: str, shape: tuple[int, int], origin: tuple[float, float] = (0.0, 0.0), spacing: tuple[float, float] = (1.0, 1.0), frame: Sequence[Sequence[float]] | None = None, tile: int = TILE, value: str = "z") -> None:
    """nodes (ix, iy, value) as a surface. A node hands its value to the up to four cells that it is a corner of, so no row or column has to come together."""
    frame = [list(map(float, row)) for row in (frame if frame is not None else ((1, 0, 0), (0, 1, 0)))]
    if abs(np.linalg.det(np.asarray(frame)[:, :2])) < 1e-300:
        raise ValueError("a surface's frame must be invertible")
    if min(shape) < 2 or min(spacing) <= 0:
        raise ValueError("a surface needs two nodes and a positive spacing along each axis")
    z = numeric.not_nan(F.col(value).cast("double"))
    corner = F.explode(F.array(*(F.struct((F.col("ix") - a).alias("ix"), (F.col("iy") - b).alias("iy"), F.lit(f"z{a}{b}").alias("of")) for a in (0, 1) for b in (0, 1))))
    spread = nodes.withColumn("_z", z).select(corner.alias("c"), "_z").select("c.ix", "c.iy", "c.of", "_z").filter("ix >= 0 AND iy >= 0")
    tiles = {f"tile_{a}": F.floor(F.col(f"i{a}") / tile).cast("int") for a in "xy"}
    cells = spread.withColumns(tiles).groupBy("tile_x", "tile_y", "ix", "iy").agg(*(F.max(F.when(F.col("of") == c, F.col("_z"))).alias(c) for c in ("z00", "z10", "z01", "z11")))
    cells.repartition("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", "iy", "ix").write.mode("overwrite").option("compression", "zstd").partitionBy("tile_x", "tile_y").parquet(f"{path}/cells")
    about = {"shape": list(shape), "origin": list(map(float, origin)), "spacing": list(map(float, spacing)), "frame": frame, "tile": tile}
    nodes.sparkSession.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")


def read(spark: SparkSession, path: str) -> Tiled:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Tiled(spark, path, tuple(about["shape"]), tuple(about["origin"]), tuple(about["spacing"]), about["frame"], about["tile"])


def box_outline(x0: float, x1: float, y0: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def degrees_outline(low_lat: float, high_lat: float, low_lon: float, high_lon: float) -> list[tuple[float, float]]:
    """A box in degrees as an outline in metres, with points along its sides."""
    from ..functions.crs import TransverseMercator

    to, steps = TransverseMercator(), np.linspace(0, 1, EDGE_POINTS)
    sides = [(low_lon + t * (high_lon - low_lon), lat) for lat in (low_lat, high_lat) for t in steps] + [(lon, low_lat + t * (high_lat - low_lat)) for lon in (low_lon, high_lon) for t in steps]
    return [to.point(float(lon), float(lat)) for lon, lat in sides]
