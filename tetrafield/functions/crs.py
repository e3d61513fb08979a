"""Transverse Mercator by Krüger's series, as column expressions and for single points, and the reference systems that are built of it.

Systems are told apart by their number, as 2193, "2193" or "EPSG:2193". Their datums are taken as one, as they agree within metres: no shift is applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Defaults are the public parameters of EPSG:2193 (New Zealand Transverse Mercator). Columns are no less good for lon0, easting0 and northing0."""

    lon0: float = 173.0
    k0: float = 0.9996
    easting0: float = 1_600_000.0
    northing0: float = 10_000_000.0
    a: float = 6_378_137.0
    inverse_flattening: float = 298.257222101
    lat0: float = 0.0  # whose northing on the central meridian is northing0

    def _series(self) -> tuple[float, float, list[float], list[float]]:
        f = 1 / self.inverse_flattening
        n = f / (2 - f)
        radius = self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return n, radius, alpha, beta

    def _north(self) -> float | Column:
        """The northing of the equator."""
        if not self.lat0:
            return self.northing0
        n, radius, alpha, _ = self._series()
        e, phi = 2 * math.sqrt(n) / (1 + n), math.radians(self.lat0)
        xi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
        return self.northing0 - self.k0 * radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(easting, northing) of degrees."""
        n, radius, alpha, _ = self._series()
        e = 2 * math.sqrt(n) / (1 + n)
        phi, dlon = F.radians(lat), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
        east, north = eta, xi
        for j, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.easting0 + self.k0 * radius * east, self._north() + self.k0 * radius * north

    def inverse(self, easting: Column, northing: Column) -> tuple[Column, Column]:
        """(longitude, latitude) in degrees."""
        n, radius, _, beta = self._series()
        e = 2 * math.sqrt(n) / (1 + n)
        xi, eta = (northing - self._north()) / (self.k0 * radius), (easting - self.easting0) / (self.k0 * radius)
        x, y = xi, eta
        for j, b in enumerate(beta, 1):
            x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        tau0 = F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))
        sin_phi = tau0 / F.sqrt(1 + tau0 * tau0)
        psi = F.asinh(tau0)
        for _ in range(4):  # conformal to geographic latitude: a contraction by e squared
            sin_phi = F.tanh(psi + e * F.atanh(e * sin_phi))
        return self.lon0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(F.asin(sin_phi))

    def point(self, lon: float, lat: float) -> tuple[float, float]:
        n, radius, alpha, _ = self._series()
        e = 2 * math.sqrt(n) / (1 + n)
        phi, dlon = math.radians(lat), math.radians(lon - self.lon0)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(dlon)), math.atanh(math.sin(dlon) / math.sqrt(1 + t * t))
        east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
        north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
        return self.easting0 + self.k0 * radius * east, self._north() + self.k0 * radius * north

    def convergence(self, lon: float, lat: float) -> float:
        """Degrees from grid north to true north, clockwise, by a small step along the meridian."""
        (e0, n0), (e1, n1) = self.point(lon, lat - 1e-4), self.point(lon, lat + 1e-4)
        return math.degrees(math.atan2(e1 - e0, n1 - n0))


NZTM = TransverseMercator()
# The world's ellipsoid of 1984, and the zones' scale and offsets: fixed values.
WGS84 = TransverseMercator(easting0=500_000.0, northing0=0.0, inverse_flattening=298.257223563)
GRS80 = replace(WGS84, inverse_flattening=NZTM.inverse_flattening)
SOUTH = 10_000_000.0
# Families of zones, as (first number, first zone, last zone, ellipsoid, offset north): fixed values.
FAMILIES = (
    (32601, 1, 60, WGS84, 0.0), (32701, 1, 60, WGS84, SOUTH), (2133, 58, 60, GRS80, SOUTH), (25828, 28, 38, GRS80, 0.0), (26901, 1, 23, GRS80, 0.0),
    (28348, 48, 58, GRS80, SOUTH), (7846, 46, 59, GRS80, SOUTH),
)
DEGREES = (4326, 4167)  # systems of longitude and latitude: fixed values


def meridian(zone: Column | int) -> Column | int:
    return 6 * zone - 183


def number(given: str | int) -> int:
    """A system's number, from that or from text such as "EPSG:2193"."""
    text = str(given).strip().upper().removeprefix("EPSG:")
    if isinstance(given, bool) or not text.isdecimal():
        raise ValueError(f"{given!r} isn't the number of a reference system")
    return int(text)


def of(given: str | int) -> TransverseMercator:
    code = number(given)
    if code == 2193:
        return NZTM
    for first, low, high, ellipsoid, offset in FAMILIES:
        if first <= code <= first + high - low:
            return replace(ellipsoid, lon0=float(meridian(code - first + low)), northing0=offset)
    raise ValueError(f"EPSG:{code} isn't known: 2193 and the zones of {', '.join(f'{f} to {f + b - a}' for f, a, b, _, _ in FAMILIES)} are")


def zone_of(lon: Column) -> Column:
    """Zones of six degrees, from 1 at the date line; any whole turn of the longitude is the same."""
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("long") + 1


def utm(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(number, easting, northing) of each row in a zone of its own, north and south of the equator by its offset."""
    zone, south = zone_of(lon), lat < 0
    own = replace(WGS84, lon0=meridian(zone), northing0=F.when(south, SOUTH).otherwise(0.0))
    east, north = own.forward(lon, lat)
    return zone + F.when(south, 32700).otherwise(32600), east, north


def from_utm(code: Column, easting: Column, northing: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of rows whose zones have their own numbers; NULL for other systems."""
    south = code > 32700
    zone = code - F.when(south, 32700).otherwise(32600)
    own = replace(WGS84, lon0=meridian(F.when(zone.between(1, 60), zone)), northing0=F.when(south, SOUTH).otherwise(0.0))
    lon, lat = own.inverse(easting, northing)
    return lon, F.when(lon.isNotNull(), lat)
