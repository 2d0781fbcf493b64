"""Colour distance and harmony."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ, and the D65 white.
MATRIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB components in [0, 1]."""
    linear = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    xyz = [sum((m * c for m, c in zip(row, linear)), F.lit(0.0)) / w for row, w in zip(MATRIX, WHITE)]
    x, y, z = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(lab(*a), lab(*b))), F.lit(0.0)))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in [0, 1); 0 for greys."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    six = F.when(hi == r, (g - b) / span).when(hi == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    return F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(six / 6, F.lit(1.0)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.30 * r + 0.59 * g + 0.11 * b


def harmony(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """0.4 of nearness in hue (not circular), 0.4 of 100 less the distance, 0.2 of contrast."""
    return 0.4 * F.greatest(F.lit(0.0), 1 - F.abs(hue(*a) - hue(*b))) + 0.4 * (100 - delta_e(a, b)) + 0.2 * F.abs(luma(*a) - luma(*b))
