"""Texts for display, and arrays of numbers read from files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import finite


def single_line(x: Column) -> Column:
    """Each carriage return and line feed is a space."""
    return F.translate(x, "\r\n", "  ")


def truncate(x: Column, length: int) -> Column:
    """At most `length` characters, the last one an ellipsis where some are left out."""
    return F.when(F.length(x) <= length, x).otherwise(F.concat(F.substring(x, 1, length - 1), F.lit("…")))


def wrap(x: Column, width: int) -> Column:
    """array of lines of at most `width` characters, broken at the last space that fits and amid a word only where none does.

    White space at both ends and after a break is left out. Null for null, empty for a blank text.
    """
    body = F.regexp_replace(x, r"(?U)\s+\z", "")
    line = rf"(?sU)\S.{{0,{width - 1}}}\z|\S.{{0,{width - 1}}}(?= )|\S.{{0,{width - 1}}}"
    return F.regexp_extract_all(body, F.lit(line), F.lit(0))


def kept_numbers(x: Column) -> Column:
    """The finite entries."""
    return F.filter(x, finite)


def all_numbers(x: Column) -> Column:
    """The array if it has entries and all are finite, else null."""
    return F.when((F.size(x) > 0) & F.forall(x, finite), x)


def point_pairs(x: Column) -> Column:
    """array of points (x, y) of numbers taken two by two; a pair with an entry that is not finite is left out, an odd last one too."""
    places = F.sequence(F.lit(0), F.greatest(F.floor(F.size(x) / 2) - 1, F.lit(0)).cast("int"))
    pairs = F.transform(places, lambda i: F.struct(F.get(x, 2 * i).alias("x"), F.get(x, 2 * i + 1).alias("y")))
    return F.coalesce(F.filter(pairs, lambda p: finite(p["x"]) & finite(p["y"])), F.array().cast("array<struct<x double, y double>>"))


def ink_paths(x: Column) -> Column:
    """Paths of points of an array of arrays, without those that have no point."""
    return F.filter(F.transform(x, point_pairs), lambda p: F.size(p) > 0)
