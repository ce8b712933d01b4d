"""Column expressions of geometry, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def homography(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def mapped(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    """`homography` with the nine numbers in a column."""
    return homography(x, y, [h[k] for k in range(9)])


def inverse(h: Column) -> Column:
    """The nine numbers of the inverse of a homography, up to a factor; null for a singular one."""
    a, b, c, d, e, f, g, p, q = (h[k] for k in range(9))
    inner = [e * q - f * p, c * p - b * q, b * f - c * e, f * g - d * q, a * q - c * g, c * d - a * f, d * p - e * g, b * g - a * p, a * e - b * d]
    whole = a * inner[0] + b * inner[3] + c * inner[6]
    return F.when(whole != 0, F.array(*(x / whole for x in inner)))


def product(g: Column, h: Column) -> Column:
    """The homography that maps by h first, then by g."""
    return F.array(*(sum((g[3 * r + k] * h[3 * k + c] for k in range(1, 3)), g[3 * r] * h[c]) for r in range(3) for c in range(3)))


def contains(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Half open: the left and upper edges belong to a rectangle, the right and lower don't."""
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def ratio(a: Column, b: Column) -> Column:
    """Null, never a perfect score, where nothing was measured."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def spline_kernel(r2: Column) -> Column:
    return F.when(r2 > 1e-12, r2 * F.log(r2)).otherwise(F.lit(0.0))


def crop_inside(x: Column, y: Column, half: Column, width: Column, height: Column) -> Column:
    """Whether a square of 2 x half around a point lies in the frame."""
    return (x - half >= 0) & (y - half >= 0) & (x + half <= width) & (y + half <= height)


def pixels_per_mm(px: Column, mm: Column) -> Column:
    """Scale from a measured distance of 1 to 100 mm; null beyond."""
    return F.when(mm.between(1, 100) & (px > 0), px / mm)


def radius_px(diameter_mm: Column, scale: Column) -> Column:
    """Pixels of half a diameter of 0.5 to 20 mm; null beyond."""
    return F.when(diameter_mm.between(0.5, 20), diameter_mm * scale / 2)


def euler_degrees(r: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Rotation about x, y and z (degrees) of a rotation matrix, z-y-x order; near the poles of y
    the rotation about z counts as none."""
    flat = F.hypot(r[0][0], r[1][0])
    pole = flat < 1e-6
    x = F.when(pole, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))
    z = F.when(pole, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))
    return F.degrees(x), F.degrees(F.atan2(-r[2][0], flat)), F.degrees(z)


def disc_pixels(x: Column, y: Column, radius: Column) -> Column:
    """Pixels (x, y) whose centres are in a disc; the box around it, filtered."""
    box = lambda c: F.sequence(F.floor(c - radius).cast("int"), F.ceil(c + radius).cast("int"))
    inside = lambda i, j: (i - x) * (i - x) + (j - y) * (j - y) <= radius * radius
    return F.flatten(F.transform(box(y), lambda j: F.filter(F.transform(box(x), lambda i: F.struct(i.alias("x"), j.alias("y"))), lambda p: inside(p["x"], p["y"]))))
