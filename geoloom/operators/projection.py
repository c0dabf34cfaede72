"""Map projections of the WGS 84 ellipsoid as expressions, by the published series: UTM and the cylindrical
equal-area grid with its true scale at 30 degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ellipsoid.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)
SCALE = 0.9996
N = FLAT / (2 - FLAT)
#: Rectifying radius, and the series of the transverse Mercator projection to the third order.
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3, 13 / 48 * N**2 - 3 / 5 * N**3, 61 / 240 * N**3)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3, N**2 / 48 + N**3 / 15, 17 / 480 * N**3)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3, 7 / 3 * N**2 - 8 / 5 * N**3, 56 / 15 * N**3)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone (north)."""
    central = F.radians(zone * 6 - 183)
    phi, lam = F.radians(lat), F.radians(lon) - central
    k = 2 * math.sqrt(N) / (1 + N)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - k * atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return 500000 + SCALE * RADIUS * x, SCALE * RADIUS * y


def from_utm(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi, eta = y / (SCALE * RADIUS), (x - 500000) / (SCALE * RADIUS)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), F.lit(0.0))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


_K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)


def _q(s: Column) -> Column:
    return (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * E1) * F.log((1 - E1 * s) / (1 + E1 * s)))


_QP = (1 - E2) * (1 / (1 - E2) - 1 / (2 * E1) * math.log((1 - E1) / (1 + E1)))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * (A * _K0), _q(F.sin(F.radians(lat))) * (A / (2 * _K0))


def from_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    beta = F.asin(y * (2 * _K0 / A / _QP))
    lat = beta + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * F.sin(2 * beta) + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * F.sin(4 * beta) + 761 * E2**3 / 45360 * F.sin(6 * beta)
    return F.degrees(x / (A * _K0)), F.degrees(lat)


def reproject(ring: Column, target: str, zone: int | None = None) -> Column:
    """A ring of longitudes and latitudes in another grid: 'utm' or 'equal_area'."""
    def one(p: Column) -> Column:
        x, y = to_utm(p["x"], p["y"], F.lit(zone)) if target == "utm" else to_equal_area(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)
