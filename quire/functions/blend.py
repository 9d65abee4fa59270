"""The sixteen blend modes and straight-alpha compositing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import clamp, cmyk_to_rgb

Triple = tuple[Column, Column, Column]


def _soft(b: Column, s: Column) -> Column:
    d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))


def _hard(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, b * 2 * s).otherwise(b + (2 * s - 1) - b * (2 * s - 1))


SEPARABLE = {
    "Normal": lambda b, s: s,
    "Multiply": lambda b, s: b * s,
    "Screen": lambda b, s: b + s - b * s,
    "Overlay": lambda b, s: _hard(s, b),
    "Darken": lambda b, s: F.least(b, s),
    "Lighten": lambda b, s: F.greatest(b, s),
    "ColorDodge": lambda b, s: F.when(b == 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(b, 1 - s))),
    "ColorBurn": lambda b, s: F.when(b >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - b, s))),
    "HardLight": _hard,
    "SoftLight": _soft,
    "Difference": lambda b, s: F.abs(b - s),
    "Exclusion": lambda b, s: b + s - 2 * b * s,
}


def _lum(c: Triple) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _sat(c: Triple) -> Column:
    return F.greatest(*c) - F.least(*c)


def _set_lum(c: Triple, want: Column) -> Triple:
    shift = want - _lum(c)
    c = tuple(x + shift for x in c)
    lum, low, high = _lum(c), F.least(*c), F.greatest(*c)
    c = tuple(F.when(low < 0, lum + F.coalesce(F.try_divide((x - lum) * lum, lum - low), F.lit(0.0))).otherwise(x) for x in c)
    return tuple(F.when(high > 1, lum + F.coalesce(F.try_divide((x - lum) * (1 - lum), high - lum), F.lit(0.0))).otherwise(x) for x in c)


def _set_sat(c: Triple, want: Column) -> Triple:
    low, span = F.least(*c), _sat(c)
    return tuple(F.coalesce(F.try_divide((x - low) * want, span), F.lit(0.0)) for x in c)


NON_SEPARABLE = {
    "Hue": lambda b, s: _set_lum(_set_sat(s, _sat(b)), _lum(b)),
    "Saturation": lambda b, s: _set_lum(_set_sat(b, _sat(s)), _lum(b)),
    "Color": lambda b, s: _set_lum(s, _lum(b)),
    "Luminosity": lambda b, s: _set_lum(b, _lum(s)),
}


def blend(mode: str, backdrop: Triple, source: Triple) -> Triple:
    """Colours of source on backdrop; an unknown mode is Normal."""
    if mode in NON_SEPARABLE:
        return NON_SEPARABLE[mode](backdrop, source)
    own = SEPARABLE.get(mode, SEPARABLE["Normal"])
    return tuple(own(b, s) for b, s in zip(backdrop, source))


def composite(mode: str, backdrop: Triple, backdrop_alpha: Column, source: Triple, alpha: Column) -> tuple[Column, Column, Column, Column]:
    """Straight-alpha colour and alpha of source over backdrop."""
    out = backdrop_alpha + alpha - backdrop_alpha * alpha
    mixed = blend(mode, backdrop, source)
    return *(F.coalesce(F.try_divide((1 - alpha) * backdrop_alpha * b + alpha * ((1 - backdrop_alpha) * s + backdrop_alpha * m), out), F.lit(0.0)) for b, s, m in zip(backdrop, source, mixed)), out


def process_overprint(backdrop: Triple, cmyk: tuple[Column, Column, Column, Column]) -> Triple:
    """Colour of a CMYK source on backdrop in overprint mode 1: parts of the source that are 0 leave the backdrop's. A gray of g is (0, 0, 0, 1 - g)."""
    black = 1 - F.greatest(*backdrop)
    ink = [F.when(black >= 1 - 1e-12, F.lit(0.0)).otherwise(clamp(F.try_divide(1 - x - black, 1 - black))) for x in backdrop]
    below = [*ink, F.when(black >= 1 - 1e-12, F.lit(1.0)).otherwise(clamp(black))]
    return cmyk_to_rgb(*[F.when(s > 1e-12, s).otherwise(b) for s, b in zip(cmyk, below)])
