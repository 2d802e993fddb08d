"""WGS84 degrees to British National Grid metres and back, as column arithmetic.

A seven-parameter Helmert shift and the transverse Mercator series; without the correction grid results are good to
about five metres. Heights are taken as 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-axes of the ellipsoids, the projection, and the shift from WGS84 to OSGB36.
WGS84 = (6378137.0, 6356752.314245)
AIRY = (6377563.396, 6356256.909)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT = (-446.448, 125.157, -542.060)
TURN = tuple(math.radians(x / 3600) for x in (-0.1502, -0.2470, -0.8421))
PPM = 20.4894e-6


def _let(value: Column, body) -> Column:
    """body of a name bound to the value: written out, the series would grow with every use of a name."""
    return F.transform(F.array(value), body)[0]


def _shifted(lat: Column, lon: Column, source: tuple, target: tuple, sign: int) -> Column:
    """Radians on one ellipsoid to radians on the other, as a struct of lat and lon."""
    a, b = source
    e2 = 1 - (b / a) ** 2
    c, d = target
    f2 = 1 - (d / c) ** 2
    tx, ty, tz = (sign * t for t in SHIFT)
    rx, ry, rz = (sign * t for t in TURN)
    s = 1 + sign * PPM

    def turned(v: Column) -> Column:
        x, y, z = v["n"] * F.cos(v["p"]) * F.cos(v["l"]), v["n"] * F.cos(v["p"]) * F.sin(v["l"]), v["n"] * (1 - e2) * F.sin(v["p"])
        return F.struct((tx + s * x - rz * y + ry * z).alias("x"), (ty + rz * x + s * y - rx * z).alias("y"), (tz - ry * x + rx * y + s * z).alias("z"))

    def back(v: Column) -> Column:
        side = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        out = F.atan2(v["z"], side * (1 - f2))
        for _ in range(4):
            out = _let(out, lambda q: F.atan2(v["z"] + f2 * (c / F.sqrt(1 - f2 * F.sin(q) * F.sin(q))) * F.sin(q), side))
        return F.struct(out.alias("lat"), F.atan2(v["y"], v["x"]).alias("lon"))

    start = _let(F.struct(lat.alias("p"), lon.alias("l")), lambda v: F.struct(v["p"].alias("p"), v["l"].alias("l"), (F.lit(a) / F.sqrt(1 - e2 * F.sin(v["p"]) * F.sin(v["p"]))).alias("n")))
    return _let(_let(start, turned), back)


def _meridian(lat: Column) -> Column:
    """Length of the meridian from the true origin."""
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(lat: Column) -> tuple[Column, Column, Column]:
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    w = 1 - e2 * F.sin(lat) * F.sin(lat)
    nu, rho = a * SCALE / F.sqrt(w), a * SCALE * (1 - e2) / (w * F.sqrt(w))
    return nu, rho, nu / rho - 1


def to_grid(lon: Column, lat: Column) -> dict[str, Column]:
    """Degrees to easting and northing."""

    def project(v: Column) -> Column:
        phi = v["lat"]
        nu, rho, eta = _radii(phi)
        d, c, t = v["lon"] - LON0, F.cos(phi), F.tan(phi)
        north = _meridian(phi) + NORTH0 + nu / 2 * F.sin(phi) * c * d**2 + nu / 24 * F.sin(phi) * c**3 * (5 - t**2 + 9 * eta) * d**4 + nu / 720 * F.sin(phi) * c**5 * (61 - 58 * t**2 + t**4) * d**6
        east = EAST0 + nu * c * d + nu / 6 * c**3 * (nu / rho - t**2) * d**3 + nu / 120 * c**5 * (5 - 18 * t**2 + t**4 + 14 * eta - 58 * t**2 * eta) * d**5
        return F.struct(east.alias("x"), north.alias("y"))

    at = _let(_shifted(F.radians(lat), F.radians(lon), WGS84, AIRY, 1), project)
    return {"x": at["x"], "y": at["y"]}


def to_degrees(x: Column, y: Column) -> dict[str, Column]:
    """Easting and northing to degrees."""

    def unproject(v: Column) -> Column:
        phi = v["phi"]
        nu, rho, eta = _radii(phi)
        d, t, c = v["x"] - EAST0, F.tan(phi), F.cos(phi)
        lat = phi - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta - 9 * t**2 * eta) * d**4 - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * d**6
        lon = LON0 + d / (c * nu) - (nu / rho + 2 * t**2) / (6 * c * nu**3) * d**3 + (5 + 28 * t**2 + 24 * t**4) / (120 * c * nu**5) * d**5
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    phi = (y - NORTH0) / (AIRY[0] * SCALE) + LAT0
    for _ in range(5):
        phi = _let(phi, lambda q: q + (y - NORTH0 - _meridian(q)) / (AIRY[0] * SCALE))
    flat = _let(F.struct(phi.alias("phi"), x.alias("x")), unproject)
    at = _let(flat, lambda v: _shifted(v["lat"], v["lon"], AIRY, WGS84, -1))
    return {"lon": F.degrees(at["lon"]), "lat": F.degrees(at["lat"])}
