"""A closed-form world to test on: a plain that slopes into the sea, ridges on it, and bowls of sediment."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import clip

# Fixed values of the world: its rectangle, slope, shoreline, ridges, site velocities, and its two basins and profile.
LON_MIN, LON_MAX, LAT_MIN, LAT_MAX = 172.0, 172.6, -43.8, -43.4
SLOPE, COASTLINE_U, RIDGE_AMPLITUDE, RIDGE_PERIODS = 1000.0, 0.75, 200.0, 3.0
VS30_MIN, VS30_MAX, VS30_PLATEAU = 200.0, 700.0, 800.0
TOMOGRAPHY = {"vp": 2.5, "gradient": 0.35, "undulation": 0.05, "wavelength": 40.0, "ratio": 1.8}


@dataclass(frozen=True)
class Basin:
    """A paraboloid of sediment in an elliptical outline, by centre and half axes in degrees and thickness in metres."""

    lon: float
    lat: float
    radius_lon: float
    radius_lat: float
    thickness: float


GULLY, TERRACE = Basin(172.15, -43.70, 0.08, 0.06, 900.0), Basin(172.30, -43.53, 0.09, 0.07, 500.0)
PROFILE = [
    (1.80, 0.50, 1.81, 100.0, 50.0, 0.10),
    (2.10, 0.68, 1.95, 120.0, 60.0, 0.30),
    (2.50, 0.98, 2.09, 150.0, 75.0, 0.80),
    (2.85, 1.28, 2.19, 180.0, 90.0, 2.00),
    (3.20, 1.60, 2.30, 200.0, 100.0, 5.00),
]  # vp, vs, rho, qp, qs, bottom depth in km and km/s


def uv(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Shares of the rectangle's width and height."""
    return (lon - LON_MIN) / (LON_MAX - LON_MIN), (lat - LAT_MIN) / (LAT_MAX - LAT_MIN)


def elevation(lon: Column, lat: Column) -> Column:
    u, v = uv(lon, lat)
    return SLOPE * (COASTLINE_U - u) + RIDGE_AMPLITUDE * F.sin(RIDGE_PERIODS * math.pi * v)


def vs30(lon: Column, lat: Column) -> Column:
    return VS30_MIN + (VS30_MAX - VS30_MIN) * clip(elevation(lon, lat) / VS30_PLATEAU, 0, 1)


def coastline_u(v: Column) -> Column:
    """Where the elevation is 0, as a share of the width."""
    return COASTLINE_U + RIDGE_AMPLITUDE / SLOPE * F.sin(RIDGE_PERIODS * math.pi * v)


def radius(b: Basin, lon: Column, lat: Column) -> Column:
    return F.hypot((lon - b.lon) / b.radius_lon, (lat - b.lat) / b.radius_lat)


def sediment(b: Basin, lon: Column, lat: Column) -> Column:
    r = radius(b, lon, lat)
    return b.thickness * F.greatest(1 - r * r, F.lit(0.0))


def basement(b: Basin, lon: Column, lat: Column) -> Column:
    return elevation(lon, lat) - sediment(b, lon, lat)


def raster(spark: SparkSession, nx: int, ny: int, field=elevation) -> DataFrame:
    """(ix, iy, lon, lat, z) of a field over the rectangle."""
    lon = LON_MIN + (LON_MAX - LON_MIN) * (F.col("id") % nx) / (nx - 1)
    lat = LAT_MIN + (LAT_MAX - LAT_MIN) * F.floor(F.col("id") / nx) / (ny - 1)
    nodes = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"), lon.alias("lon"), lat.alias("lat"))
    return nodes.withColumn("z", field(F.col("lon"), F.col("lat")))


def land_ring(spark: SparkSession, pad: float = 1.0, samples: int = 256) -> DataFrame:
    """(ring, n, x, y): the land's outline in degrees, anticlockwise and closed; only the east follows the shore."""
    t = (F.col("id") - 1) / (samples - 1)
    v = F.when(F.col("id").between(1, samples), -pad + t * (1 + 2 * pad)).when(F.col("id") == samples + 1, F.lit(1.0 + pad)).otherwise(F.lit(-pad))
    u = F.when(F.col("id").between(1, samples), coastline_u(v)).otherwise(F.lit(-pad))
    return spark.range(samples + 3).select(F.lit(0).alias("ring"), F.col("id").alias("n"), (LON_MIN + (LON_MAX - LON_MIN) * u).alias("x"), (LAT_MIN + (LAT_MAX - LAT_MIN) * v).alias("y"))


def outline(spark: SparkSession, b: Basin, samples: int = 128) -> DataFrame:
    a = 2 * math.pi * F.col("id") / (samples - 1)
    return spark.range(samples).select(F.lit(0).alias("ring"), F.col("id").alias("n"), (b.lon + b.radius_lon * F.cos(a)).alias("x"), (b.lat + b.radius_lat * F.sin(a)).alias("y"))


def tomography(spark: SparkSession, xs: list[float], ys: list[float], zs: list[float]) -> DataFrame:
    """(x, y, z, vp, vs, rho) in km, km/s and g/cm3 on a grid: faster with depth, gently undulating; density by Gardner."""
    n = len(ys) * len(zs)
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, map(float, values))), (at + 1).cast("int"))
    i = F.col("id")
    nodes = spark.range(len(xs) * n).select(pick(xs, F.floor(i / n)).alias("x"), pick(ys, F.floor(i / len(zs)) % len(ys)).alias("y"), pick(zs, i % len(zs)).alias("z"))
    turn = 2 * math.pi / TOMOGRAPHY["wavelength"]
    vp = (TOMOGRAPHY["vp"] + TOMOGRAPHY["gradient"] * F.col("z")) * (1 + TOMOGRAPHY["undulation"] * F.sin(turn * F.col("x")) * F.cos(turn * F.col("y")))
    return nodes.withColumn("vp", vp).withColumns({"vs": F.col("vp") / TOMOGRAPHY["ratio"], "rho": 1.74 * F.pow("vp", F.lit(0.25))})


def profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILE, "vp double, vs double, rho double, qp double, qs double, bottom_depth double")
