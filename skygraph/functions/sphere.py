"""Sky positions as native column expressions: angles, Galactic latitude, Cartesian axes, HEALPix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The north Galactic pole in ICRS, degrees.
POLE_RA_DEG = 192.8594812065348
POLE_DEC_DEG = 27.12825118085622


def map_longitude(ra_deg: Column) -> Column:
    """Longitude in radians, shifted to [-pi, pi) for a whole-sky map."""
    return F.radians(ra_deg) - F.lit(math.pi)


def galactic_latitude_deg(ra_deg: Column, dec_deg: Column) -> Column:
    d = F.radians(dec_deg)
    sine = F.lit(math.sin(math.radians(POLE_DEC_DEG))) * F.sin(d) + F.lit(math.cos(math.radians(POLE_DEC_DEG))) * F.cos(d) * F.cos(F.radians(ra_deg) - F.lit(math.radians(POLE_RA_DEG)))
    return F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))))


def is_north(ra_deg: Column, dec_deg: Column) -> Column:
    """Galactic b > 0. b = 0, NaN and null positions belong to the south."""
    b = galactic_latitude_deg(ra_deg, dec_deg)
    return F.coalesce((b > 0.0) & ~F.isnan(b), F.lit(False))


def cartesian(distance: Column, ra_deg: Column, dec_deg: Column) -> dict[str, Column]:
    a, d = F.radians(ra_deg), F.radians(dec_deg)
    return {"x_mpc": distance * F.cos(d) * F.cos(a), "y_mpc": distance * F.cos(d) * F.sin(a), "z_mpc": distance * F.sin(d)}


def _spread(v: Column) -> Column:
    """The bits of v moved to the even places: its binary digits read with base four. ``v`` is named once, so that plans stay small."""
    return F.conv(F.bin(v), 4, 10).cast("bigint")


def healpix_nested(nside: int, ra_deg: Column, dec_deg: Column) -> Column:
    """NESTED pixel number; nside is a power of two."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    n, z = F.lit(float(nside)), F.sin(F.radians(dec_deg))
    tt = F.pmod(ra_deg, F.lit(360.0)) / F.lit(90.0)
    whole = lambda c: F.floor(c).cast("bigint")
    top = F.lit(nside - 1).cast("bigint")
    side = F.lit(nside).cast("bigint")

    jp, jm = whole(n * (F.lit(0.5) + tt) - n * z * F.lit(0.75)), whole(n * (F.lit(0.5) + tt) + n * z * F.lit(0.75))
    ifp, ifm = F.floor(jp / side).cast("bigint"), F.floor(jm / side).cast("bigint")
    belt_face = F.when(ifp == ifm, F.pmod(ifp, F.lit(4)) + 4).when(ifp < ifm, ifp).otherwise(ifm + 8)
    belt_x, belt_y = F.pmod(jm, side), top - F.pmod(jp, side)

    ntt = F.least(F.lit(3).cast("bigint"), whole(tt))
    part, t = tt - ntt, n * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    kp, km = F.least(top, whole(part * t)), F.least(top, whole((F.lit(1.0) - part) * t))
    north = z >= 0
    cap_face = F.when(north, ntt).otherwise(ntt + 8)
    cap_x, cap_y = F.when(north, top - km).otherwise(kp), F.when(north, top - kp).otherwise(km)

    belt = F.abs(z) <= F.lit(2.0 / 3.0)
    pick = lambda a, b: F.when(belt, a).otherwise(b)
    inside = _spread(pick(belt_x, cap_x)) + F.lit(2).cast("bigint") * _spread(pick(belt_y, cap_y))
    return pick(belt_face, cap_face) * F.lit(nside * nside).cast("bigint") + inside
