"""Colour conversions as column arithmetic; components from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIE XYZ (D65) to linear sRGB; the Bradford cone response matrix and its inverse; the D65 white point.
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_BACK = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
D65 = (0.95047, 1.0, 1.08883)

Triple = tuple[Column, Column, Column]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN and infinities give the low bound."""
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good, F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(F.lit(low))


def _times(m, v: Triple) -> Triple:
    return tuple(v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in m)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Triple:
    return tuple(1 - F.least(F.lit(1.0), x * (1 - k) + k) for x in (c, m, y))


def encode_srgb(x: Column) -> Column:
    x = clamp(x)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def adapt_to_d65(xyz: Triple, white: tuple[float, float, float]) -> Triple:
    """Bradford adaptation from a white point."""
    cone = lambda w: [sum(a * b for a, b in zip(r, w)) for r in BRADFORD]
    have, want = cone(white), cone(D65)
    scaled = tuple(x * F.lit(want[i] / have[i]) for i, x in enumerate(_times(BRADFORD, xyz)))
    return _times(BRADFORD_BACK, scaled)


def xyz_to_srgb(xyz: Triple, white: tuple[float, float, float] = D65) -> Triple:
    return tuple(encode_srgb(x) for x in _times(XYZ_TO_RGB, adapt_to_d65(xyz, white)))


def lab_to_xyz(lightness: Column, a: Column, b: Column, white: tuple[float, float, float]) -> Triple:
    m = (lightness + 16) / 116
    g = lambda x: F.when(x >= 6 / 29, x * x * x).otherwise((108 / 841) * (x - 4 / 29))
    return g(m + a / 500) * white[0], g(m) * white[1], g(m - b / 200) * white[2]


def lab_to_srgb(lightness: Column, a: Column, b: Column, white: tuple[float, float, float]) -> Triple:
    return xyz_to_srgb(lab_to_xyz(lightness, a, b, white), white)


def cal_gray_to_srgb(a: Column, gamma: float, white: tuple[float, float, float]) -> Triple:
    x = F.pow(clamp(a), F.lit(gamma))
    return xyz_to_srgb((x * white[0], x * white[1], x * white[2]), white)


def cal_rgb_to_srgb(rgb: Triple, gamma: tuple[float, float, float], m: tuple[float, ...], white: tuple[float, float, float]) -> Triple:
    """m: the nine numbers of /Matrix, column by column."""
    x = tuple(F.pow(clamp(v), F.lit(g)) for v, g in zip(rgb, gamma))
    return xyz_to_srgb(tuple(x[0] * m[i] + x[1] * m[3 + i] + x[2] * m[6 + i] for i in range(3)), white)


def indexed(value: Column, high: int, table: Column, parts: int) -> tuple[Column, ...]:
    """Components, from 0 to 1, of an entry of a lookup table of bytes; the index is rounded, halves to even, and clamped."""
    at = F.least(F.greatest(F.bround(value, 0).cast("int"), F.lit(0)), F.lit(high))
    return tuple(F.conv(F.hex(F.substring(table, at * parts + i + 1, F.lit(1))), 16, 10).cast("double") / 255 for i in range(parts))
