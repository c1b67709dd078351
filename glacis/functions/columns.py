"""Scalar expressions on columns: variogram models, tapers, units, reconstruction and ray migration."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steepness below which slopes count as this many degrees; share of the largest depth, and depth, that caps thickness.
LEAST_DEGREES, CAP_FACTOR, CAP_LEAST = 2.0, 1.5, 500.0
LEAST_SINE = math.sin(math.radians(LEAST_DEGREES))


def lit(x) -> Column:
    return F.lit(float(x))


def rise(q, model: str, exp, least):
    """The variogram models from 0 to 1, on distances over the range; names are matched by a part of them, others are spherical.

    Of columns or arrays, as ``exp`` and ``least`` (of a value and 1) are.
    """
    name = model.lower()
    if "exp" in name:
        return 1.0 - exp(-3.0 * q)
    if "gauss" in name:
        return 1.0 - exp(-3.0 * q * q)
    t = least(q)
    return t if "lin" in name else 1.5 * t - 0.5 * t * t * t


def spherical(h: Column, a, c, c0) -> Column:
    """Spherical variogram with nugget: rises to c0 + c at range a."""
    a, c, c0 = (x if isinstance(x, Column) else lit(x) for x in (a, c, c0))
    return c0 + c * rise(h / a, "spherical", F.exp, lambda q: F.least(q, lit(1)))


def semivariance(h: Column, model: str, a: float, sill: float, nugget: float = 0.0) -> Column:
    """The kriging models; zero at distance zero."""
    return F.when(h == 0, lit(0)).otherwise(lit(nugget) + lit(sill) * rise(h / lit(max(a, 1e-6)), model, F.exp, lambda q: F.least(q, lit(1))))


def cosine_taper(distance: Column, width: float) -> Column:
    """0 at the margin, 1 from ``width`` on."""
    t = F.greatest(F.least(distance / lit(max(width, 1e-6)), lit(1)), lit(0))
    return lit(0.5) * (lit(1) - F.cos(lit(math.pi) * t))


def one_way(value: Column, kind: str) -> Column:
    """Two-way travel times are halved; other kinds are left alone."""
    return value / 2 if kind.lower() in ("two_way_travel_time", "twt", "two_way") else value


def is_thickness(kind: str) -> bool:
    return kind.lower() in ("thickness", "ice_thickness", "depth")


def stress_product(value: Column, sine: Column) -> Column:
    """Value times the sine of the slope; an unknown slope counts as 0.1."""
    return value * F.greatest(F.coalesce(F.nanvl(sine, F.lit(None)), lit(0.1)), lit(1e-4))


def field_from_product(product: Column, sine: Column) -> Column:
    return F.greatest(product / F.greatest(sine, lit(LEAST_SINE)), lit(0))


def thickness_from_product(product: Column, sine: Column, inside: Column, deepest: float) -> Column:
    """Thickness between 0 and the cap; 0 outside."""
    cap = max(CAP_FACTOR * deepest, CAP_LEAST)
    return F.when(inside, F.least(field_from_product(product, sine), lit(cap))).otherwise(lit(0))


def product_variance(variance: Column, sine: Column, inside: Column) -> Column:
    safe = F.greatest(sine, lit(LEAST_SINE))
    return F.when(inside, variance / (safe * safe)).otherwise(lit(0))


def uncertainty(variance: Column, inside: Column) -> Column:
    return F.when(inside, F.sqrt(F.greatest(variance, lit(0)))).otherwise(lit(0))


def final_thickness(z: Column, bed: Column, inside: Column) -> Column:
    """Surface less bed, never below zero; 0 outside."""
    return F.when(inside, F.greatest(z - bed, lit(0))).otherwise(lit(0))


def ice_drift(sine: Column) -> Column:
    """Inverse sine of the slope, flat places counting as LEAST_DEGREES."""
    return lit(1) / F.greatest(sine, lit(LEAST_SINE))


def displacement(t: Column, tx: Column, ty: Column, zx: Column, zy: Column, velocity: float) -> tuple[Column, Column, Column]:
    """Ray displacement of a reflection: from travel time ``t``, its gradient and the surface's.

    Along the surface the slowness is the gradient of ``t``; the part into the ground
    completes it to 1/velocity. Turned into x, y, z and stretched by -t v^2.
    """
    ax, ay = F.atan(zx), F.atan(zy)
    sx, cx, sy, cy = F.sin(ax), F.cos(ax), F.sin(ay), F.cos(ay)
    along = tx * tx + ty * ty + lit(2) * tx * ty * sx * sy
    down = F.sqrt(F.greatest(lit((1 / max(velocity, 1e-4)) ** 2) - along, lit(0)))
    area = F.greatest(cy * cy * cx * cx + sy * sy * cx * cx + sx * sx * cy * cy, lit(1e-6))
    root, stretch = F.sqrt(area), -t * lit(velocity**2)
    px = cx * (cy * cy + sy * sy) / area * tx - sx * cx * sy / area * ty - sx * cy / root * down
    py = cy * (cx * cx + sx * sx) / area * ty - sy * sx * cy / area * tx - cx * sy / root * down
    pz = cy * cy * sx / area * tx + cx * cx * sy / area * ty + cx * cy / root * down
    return stretch * px, stretch * py, stretch * pz
