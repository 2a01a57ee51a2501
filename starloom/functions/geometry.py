"""Scalar functions of positions: periodic boxes, distortions, sky coordinates.

All are column expressions: nothing here leaves code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def wrap(x: Column, length: float, low: float = 0) -> Column:
    """``x`` moved into [low, low + length) by whole lengths."""
    return F.pmod(x - F.lit(low), F.lit(length)) + F.lit(low) if low else F.pmod(x, F.lit(length))


def min_image(d: Column, length: float | None) -> Column:
    """A difference brought to the nearest periodic image; exactly half a box stays as it is."""
    if length is None or math.isinf(length):
        return d
    half = length / 2
    return F.when(d > half, d - F.lit(length)).when(d < -half, d + F.lit(length)).otherwise(d)


def redshift_space(x: Column, v: Column, h_times_a: float, length: float, low: float = 0) -> Column:
    """Position along the line of sight in redshift space, wrapped into the box."""
    return wrap(x + v / F.lit(h_times_a), length, low)


def alcock_paczynski(columns: dict[str, Column], los: str, q_par: float, q_perp: float) -> dict[str, Column]:
    """Axes divided by the line-of-sight or transverse scale."""
    if los not in columns:
        raise ValueError(f"line of sight {los!r} is not one of {sorted(columns)}")
    return {a: c / F.lit(float(q_par if a == los else q_perp)) for a, c in columns.items()}


def scaled_box(length: float | tuple, los: str, q_par: float, q_perp: float) -> tuple:
    """Side lengths after scaling; the argument is left alone."""
    sides = (length,) * 3 if not isinstance(length, (tuple, list)) else tuple(length)
    return tuple(s / (q_par if a == los else q_perp) for a, s in zip(AXES, sides, strict=True))


def rotate_los(los: str) -> tuple[str, str, str]:
    """Axis names such that the last one is the line of sight."""
    return {"x": ("y", "z", "x"), "y": ("z", "x", "y"), "z": ("x", "y", "z")}[los]


def projected(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    """(transverse separation, absolute line-of-sight separation), line of sight along z."""
    return F.sqrt(dx * dx + dy * dy), F.abs(dz)


def sky_to_cartesian(ra: Column, dec: Column, distance: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return distance * F.cos(d) * F.cos(a), distance * F.cos(d) * F.sin(a), distance * F.sin(d)


def cartesian_to_sky(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(right ascension in [0, 360), declination, distance); the origin has declination 0."""
    r = F.sqrt(x * x + y * y + z * z)
    dec = F.when(r == 0, 0.0).otherwise(F.degrees(F.asin(z / r)))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), dec, r


def radial_shift(x: Column, y: Column, z: Column, vx: Column, vy: Column, vz: Column, h_times_a: float) -> tuple[Column, Column, Column]:
    """Positions moved along their own direction by the radial velocity."""
    r2 = x * x + y * y + z * z
    f = F.when(r2 == 0, 0.0).otherwise((x * vx + y * vy + z * vz) / r2 / F.lit(h_times_a))
    return x + x * f, y + y * f, z + z * f


def effective_radius(cells: Column, cell: float) -> Column:
    """Radius of the sphere with the volume of so many cells."""
    return F.cbrt(F.lit(3.0 / (4.0 * math.pi) * cell**3) * cells)


def sphericity(volume: Column, area: Column) -> Column:
    return F.lit(math.pi ** (1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / area


def gaussian_kernel(k2: Column, radius: float) -> Column:
    return F.exp(-k2 * F.lit(radius * radius / 2))


def tophat_kernel(k: Column, radius: float) -> Column:
    kr = k * F.lit(radius)
    return F.when(k == 0, 1.0).otherwise(3 * (F.sin(kr) / F.pow(kr, F.lit(3)) - F.cos(kr) / F.pow(kr, F.lit(2))))


def flat_distance(z: float, omega_m: float = 0.3, h: float = 1.0, steps: int = 512) -> float:
    """Comoving distance (in 1/h if h is 1) of a flat universe, by Simpson's rule."""
    c = 299792.458 / (100.0 * h)
    n = 2 * steps
    total = 0.0
    for i in range(n + 1):
        x = z * i / n
        total += (1 if i in (0, n) else 4 if i % 2 else 2) / math.sqrt(1 - omega_m + omega_m * (1 + x) ** 3)
    return c * total * z / (3 * n)
