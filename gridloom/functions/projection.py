"""Map projections as Column expressions on the WGS 84 ellipsoid.

Transverse Mercator uses the Krueger series to sixth order in the third flattening; the other two
are the ellipsoidal cylindrical equal-area and the two-parallel conformal conic of the textbooks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
N = FLAT / (2 - FLAT)
K0 = 0.9996
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)

# Krueger's series, fixed values.
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
]


# Geographic from conformal latitude, fixed values.
DELTA = [
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45 + 26 * N**5 / 45 - 2854 * N**6 / 675,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45 + 2704 * N**5 / 315 + 2323 * N**6 / 945,
    56 * N**3 / 15 - 136 * N**4 / 35 - 1262 * N**5 / 105 + 73814 * N**6 / 2835,
    4279 * N**4 / 630 - 332 * N**5 / 35 - 399572 * N**6 / 14175,
    4174 * N**5 / 315 - 144838 * N**6 / 6237,
    601676 * N**6 / 22275,
]

#: Metres of a whole meridian circle in a zone: the northings of one place differ by multiples of it.
CIRCLE = 2 * math.pi * K0 * RECTIFYING


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def _conformal(tan_lat: Column) -> Column:
    """Tangent of the conformal latitude from that of the geographic one."""
    sigma = F.sinh(E * F.atanh(E * tan_lat / F.sqrt(1 + tan_lat * tan_lat)))
    return tan_lat * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tan_lat * tan_lat)


def utm_forward(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y) in metres of the UTM zone ``epsg``."""

    def project(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        return F.struct((500000.0 + K0 * RECTIFYING * east).alias("x"), (K0 * RECTIFYING * north + F.when(epsg >= 32700, 1e7).otherwise(0.0)).alias("y"))

    def sphere(p: Column) -> Column:
        lam, t = p["lam"], p["t"]
        return let(F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam))).alias("eta")), project)

    start = F.struct(F.radians(lon - central_meridian(epsg)).alias("lam"), let(F.tan(F.radians(lat)), _conformal).alias("t"))
    return let(start, sphere)


def utm_inverse(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) in degrees."""

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        a = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
        b = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
        return let(F.struct(a.alias("a"), b.alias("b")), degrees)

    def degrees(q: Column) -> Column:
        lon = central_meridian(epsg) + F.degrees(F.atan2(F.sinh(q["b"]), F.cos(q["a"])))
        lat = let(F.asin(F.sin(q["a"]) / F.cosh(q["b"])), lambda chi: chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)))
        return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))

    xi = (y - F.when(epsg >= 32700, 1e7).otherwise(0.0)) / (K0 * RECTIFYING)
    return let(F.struct(xi.alias("xi"), ((x - 500000.0) / (K0 * RECTIFYING)).alias("eta")), sphere)


def _q(sin_lat: Column | float):
    if isinstance(sin_lat, float):
        return (1 - E2) * (sin_lat / (1 - E2 * sin_lat**2) + math.atanh(E * sin_lat) / E)
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat * sin_lat) + F.atanh(E * sin_lat) / E)


def equal_area_scale(parallel: float) -> float:
    s = math.sin(math.radians(parallel))
    return math.cos(math.radians(parallel)) / math.sqrt(1 - E2 * s * s)


def equal_area(lon: Column, lat: Column, parallel: float = 30.0) -> Column:
    """struct(x, y): ellipsoidal cylindrical equal-area with the given standard parallel."""
    k = equal_area_scale(parallel)
    return F.struct((A * k * F.radians(lon)).alias("x"), (A * _q(F.sin(F.radians(lat))) / (2 * k)).alias("y"))


def conic_constants(first: float, second: float, lat0: float) -> tuple[float, float, float]:
    """Cone constant, scale factor and radius of the origin's parallel."""
    m = lambda p: math.cos(math.radians(p)) / math.sqrt(1 - E2 * math.sin(math.radians(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - math.radians(p) / 2) / ((1 - E * math.sin(math.radians(p))) / (1 + E * math.sin(math.radians(p)))) ** (E / 2)
    n = (math.log(m(first)) - math.log(m(second))) / (math.log(t(first)) - math.log(t(second)))
    f = m(first) / (n * t(first) ** n)
    return n, f, A * f * t(lat0) ** n


def conformal_conic(lon: Column, lat: Column, first: float = 25.0, second: float = 47.0, lat0: float = 0.0, lon0: float = 105.0) -> Column:
    """struct(x, y): Lambert conformal conic with two standard parallels."""
    n, f, origin = conic_constants(first, second, lat0)
    s = F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2))
    rho, theta = A * f * F.pow(t, F.lit(n)), n * F.radians(lon - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (origin - rho * F.cos(theta)).alias("y"))
