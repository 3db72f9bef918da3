"""Map projections as closed column expressions (Snyder, USGS Professional Paper 1395), degrees and metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def step_m(degrees: float) -> float:
    """Length of an arc of the equator."""
    return A * math.radians(degrees)


def _meridian(phi: Column) -> Column:
    """Distance along the meridian from the equator."""
    e4, e6 = E2**2, E2**3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))


def _footpoint(m: Column) -> Column:
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    return mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)


def sinusoidal(lon: Column, lat: Column) -> Column:
    phi = F.radians(lat)
    return F.struct((A * F.radians(lon) * F.cos(phi) / F.sqrt(1 - E2 * F.sin(phi) ** 2)).alias("x"), _meridian(phi).alias("y"))


def sinusoidal_inverse(x: Column, y: Column) -> Column:
    phi = _footpoint(y)
    return F.struct(F.degrees(F.try_divide(x * F.sqrt(1 - E2 * F.sin(phi) ** 2), A * F.cos(phi))).alias("x"), F.degrees(phi).alias("y"))


# Robinson's table of parallel length and distance from the equator, every 5 degrees.
ROBINSON_X = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_Y = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)


def robinson(lon: Column, lat: Column) -> Column:
    """Between table rows linearly, which keeps within a few kilometres of smoother interpolations."""
    at = F.least(F.abs(lat) / 5, F.lit(18.0))
    k = F.least(F.floor(at), F.lit(17)).cast("int")
    table = lambda values: F.array(*[F.lit(v) for v in values])
    between = lambda values: F.get(table(values), k) + (at - k) * (F.get(table(values), k + 1) - F.get(table(values), k))
    return F.struct((0.8487 * A * F.radians(lon) * between(ROBINSON_X)).alias("x"), (1.3523 * A * F.signum(lat) * between(ROBINSON_Y)).alias("y"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | None = None) -> Column:
    """Transverse Mercator of the point's (or a given) zone by Snyder's series."""
    zone = utm_zone(lon) if zone is None else zone
    phi, k0, ep = F.radians(lat), 0.9996, E2 / (1 - E2)
    n = A / F.sqrt(1 - E2 * F.sin(phi) ** 2)
    t, c = F.tan(phi) ** 2, ep * F.cos(phi) ** 2
    a = F.radians(lon - (zone * 6 - 183)) * F.cos(phi)
    x = k0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * a**5 / 120) + 500000
    y = k0 * (_meridian(phi) + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * a**6 / 720))
    return F.struct(x.alias("x"), F.when(lat < 0, y + 1e7).otherwise(y).alias("y"))
