"""Column functions: magnitudes, projections on a heading, angles, surrogate safety measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 12.5
PI = math.pi


def speed(vx: Column, vy: Column) -> Column:
    return F.hypot(vx, vy)


acceleration = speed


def longitudinal(x: Column, y: Column, heading: Column) -> Column:
    """Component along the heading."""
    return x * F.cos(heading) + y * F.sin(heading)


def lateral(x: Column, y: Column, heading: Column) -> Column:
    """Component to the left of the heading."""
    return -x * F.sin(heading) + y * F.cos(heading)


def time_headway(gap: Column, v: Column) -> Column:
    return gap / (v + 1e-6)


def wrap(angle: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def folded_difference(a: Column, b: Column) -> Column:
    """Absolute difference of two headings in [-pi, pi], at most pi."""
    d = F.abs(a - b)
    return F.when(d > PI, 2 * PI - d).otherwise(d)


def heading_deviation(heading: Column, lane_angle: Column) -> Column:
    """Heading against the lane's angle, in [-pi, pi)."""
    return wrap(heading - lane_angle)


def density(count: Column, radius: float) -> Column:
    return count / (PI * radius**2)


def time_to_collision(dx: Column, dy: Column, vx: Column, vy: Column, r_safe: Column, horizon: float) -> Column:
    """Time to the safety radius, the discriminant clamped at 0; not approaching, or inside already: the horizon."""
    dv2, dot = vx * vx + vy * vy, dx * vx + dy * vy
    root = F.sqrt(F.greatest(dot * dot - dv2 * (dx * dx + dy * dy - r_safe * r_safe), F.lit(0.0)))
    t = F.when(dv2 > 1e-6, F.try_divide(-dot - root, dv2))
    return F.when(t > 0, F.least(t, F.lit(horizon))).otherwise(F.lit(horizon))


def distance_at_closest_approach(dx: Column, dy: Column, vx: Column, vy: Column, horizon: float) -> Column:
    dv2, dot = vx * vx + vy * vy, dx * vx + dy * vy
    t = F.when(dv2 > 1e-6, F.least(F.greatest(F.try_divide(-dot, dv2), F.lit(0.0)), F.lit(horizon))).otherwise(0.0)
    return F.sqrt((dx + vx * t) * (dx + vx * t) + (dy + vy * t) * (dy + vy * t))


def deceleration_to_avoid(dx: Column, dy: Column, vx: Column, vy: Column, r_safe: Column, s_min: float = 0.2, a_max: float = 15.0) -> Column:
    """Null unless closing in from outside the safety radius."""
    d = F.sqrt(dx * dx + dy * dy)
    v = F.try_divide(-(dx * vx + dy * vy), d)
    return F.when((v > 0) & (d > r_safe), F.least(v * v / (2 * F.greatest(d - r_safe, F.lit(s_min))), F.lit(a_max)))


def all_finite(*columns: str) -> Column:
    """Whether none of the columns is missing, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < float("inf"), F.nanvl(x, F.lit(None).cast("double")))
