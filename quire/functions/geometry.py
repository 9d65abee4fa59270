"""Rectangles, matrices and angles as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rectangle(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    return F.struct(left.alias("l"), bottom.alias("b"), right.alias("r"), top.alias("t"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def normalised_box(box: Column, media: Column) -> Column:
    """box with its corners in order, inside media; media itself if box is null, not finite or empty after that."""
    low, high = (lambda a, b: F.least(box[a], box[b])), (lambda a, b: F.greatest(box[a], box[b]))
    cut = rectangle(F.greatest(low("l", "r"), media["l"]), F.greatest(low("b", "t"), media["b"]), F.least(high("l", "r"), media["r"]), F.least(high("b", "t"), media["t"]))
    good = finite(box["l"]) & finite(box["b"]) & finite(box["r"]) & finite(box["t"]) & (cut["l"] < cut["r"]) & (cut["b"] < cut["t"])
    return F.when(good, cut).otherwise(media)


def page_box(which: Column, media: Column, crop: Column, bleed: Column, trim: Column, art: Column) -> Column:
    """The box asked for by name; bleed, trim and art boxes that a page lacks, and unknown names, are the crop box."""
    own = F.when(which == "MediaBox", media).when(which == "BleedBox", bleed).when(which == "TrimBox", trim).when(which == "ArtBox", art)
    return F.coalesce(own, crop)


def contains(box: Column, x: Column, y: Column) -> Column:
    """Edges included."""
    return x.between(box["l"], box["r"]) & y.between(box["b"], box["t"])


def intersects(a: Column, b: Column) -> Column:
    """Edges included."""
    return (a["l"] <= b["r"]) & (a["r"] >= b["l"]) & (a["b"] <= b["t"]) & (a["t"] >= b["b"])


def matrix(*cells: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(cells, "abcdef")])


def apply_matrix(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m["a"] + y * m["c"] + m["e"], x * m["b"] + y * m["d"] + m["f"]


def multiply(p: Column, q: Column) -> Column:
    """First p, then q."""
    return matrix(
        p["a"] * q["a"] + p["b"] * q["c"], p["a"] * q["b"] + p["b"] * q["d"], p["c"] * q["a"] + p["d"] * q["c"], p["c"] * q["b"] + p["d"] * q["d"],
        p["e"] * q["a"] + p["f"] * q["c"] + q["e"], p["e"] * q["b"] + p["f"] * q["d"] + q["f"],
    )


def invert(m: Column) -> Column:
    """null for a singular matrix."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    return F.when(F.abs(det) > 1e-12, matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det))


def rotation(dx: Column, dy: Column) -> Column:
    """Whole degrees from 0 to 359 of an advance, halves to even."""
    return F.pmod(F.bround(F.degrees(F.atan2(dy, dx)), 0).cast("int"), F.lit(360))


def page_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def orientation(degrees: Column) -> Column:
    return F.when(degrees == 90, "Landscape").when(degrees == 180, "UpsideDown").when(degrees == 270, "Seascape").otherwise("Portrait")


def appearance_matrix(bbox: Column, m: Column, rect: Column) -> Column:
    """The matrix that maps a form's transformed box onto an annotation's rectangle; null where the box is empty."""
    corners = [apply_matrix(m, bbox[x], bbox[y]) for x in ("l", "r") for y in ("b", "t")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    left, bottom, width, height = F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
    sx, sy = (rect["r"] - rect["l"]) / width, (rect["t"] - rect["b"]) / height
    fit = matrix(sx, F.lit(0.0), F.lit(0.0), sy, rect["l"] - left * sx, rect["b"] - bottom * sy)
    return F.when((width > 0) & (height > 0), multiply(m, fit))
