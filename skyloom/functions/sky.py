"""Positions on the sphere, in degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotation from equatorial to galactic unit vectors (J2000).
GALACTIC = (
    (-0.054875539, -0.873437105, -0.483834992),
    (0.494109454, -0.444829594, 0.746982249),
    (-0.867666136, -0.198076390, 0.455983795),
)
#: Arcseconds in the units that searches take.
ARCSEC = {"deg": 3600.0, "rad": 206264.80624709636, "arcmin": 60.0, "arcsec": 1.0}


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance, stable for small and for opposite angles."""
    a1, d1, a2, d2 = (F.radians(x) for x in (ra1, dec1, ra2, dec2))
    da = a2 - a1
    across = F.hypot(F.cos(d2) * F.sin(da), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da))
    along = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)
    return F.degrees(F.atan2(across, along))


def vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a position."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def near_box(ra: Column, dec: Column, ra0: float, dec0: float, degrees: float) -> Column:
    """Bounds in declination and right ascension that hold a cone; plain comparisons, which a scan can prune by."""
    inside = dec.between(dec0 - degrees - 1e-9, dec0 + degrees + 1e-9)
    if abs(dec0) + degrees >= 89.9 or degrees >= 80:
        return inside
    reach = math.degrees(math.asin(min(1.0, math.sin(math.radians(degrees)) / math.cos(math.radians(dec0))))) + 1e-6
    low, high = (ra0 - reach) % 360, (ra0 + reach) % 360
    own = F.pmod(ra, F.lit(360.0)) if reach < 180 else ra
    return inside & ((own.between(low, high)) if low <= high else (own >= low) | (own <= high))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return separation(ra1, dec1, ra2, dec2) * 3600.0


def galactic(ra: Column, dec: Column) -> Column:
    """struct<l, b>, l in (-180, 180]."""
    a, d = F.radians(ra), F.radians(dec)
    v = (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    x, y, z = (sum((F.lit(m) * c for m, c in zip(row[1:], v[1:])), F.lit(row[0]) * v[0]) for row in GALACTIC)
    return F.struct(F.degrees(F.atan2(y, x)).alias("l"), F.degrees(F.atan2(z, F.hypot(x, y))).alias("b"))


def geojson(ra: Column, dec: Column) -> Column:
    """A point whose longitude is right ascension less 180 degrees."""
    return F.struct(F.lit("Point").alias("type"), F.array(ra - 180.0, dec).alias("coordinates"))


def coordinates(ra: Column, dec: Column) -> Column:
    g = galactic(ra, dec)
    return F.struct(geojson(ra, dec).alias("radec_geojson"), g["l"].alias("l"), g["b"].alias("b"))


def match_radius(z: Column, furthest: float, near: float) -> Column:
    """Arcseconds of a match that scales with redshift: ``near`` below 0.01, else what ``furthest`` at 0.05 becomes."""
    return F.when(z < 0.01, F.lit(float(near))).otherwise(F.lit(furthest * 0.05) / z)


def distance_kpc(arcsec: Column, z: Column) -> Column:
    """Projected distance, -1 where the redshift is too small to tell."""
    return F.when(z > 0.005, arcsec * z / 0.05).otherwise(F.lit(-1.0))


def number(x: Column) -> Column:
    """A finite double, else null."""
    y = x.cast("string").try_cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def to_arcsec(radius: float, unit: str) -> float:
    return radius * ARCSEC[unit]


def centroid(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Aggregates: the direction of the mean unit vector."""
    a, d = F.radians(ra), F.radians(dec)
    x, y, z = F.avg(F.cos(d) * F.cos(a)), F.avg(F.cos(d) * F.sin(a)), F.avg(F.sin(d))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.hypot(x, y)))


def offsets(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    """struct<east, north, radial> in arcseconds from a centre, right ascension wrapped."""
    da = F.pmod(ra - ra0 + 180.0, F.lit(360.0)) - 180.0
    east, north = da * F.cos(F.radians(dec0)) * 3600.0, (dec - dec0) * 3600.0
    return F.struct(east.alias("east"), north.alias("north"), F.hypot(east, north).alias("radial"))
