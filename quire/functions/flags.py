"""Bit flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Permission bits of the standard security handler, counted from 1.
PERMISSION_BITS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11}
# Annotation flags.
INVISIBLE, HIDDEN, NO_VIEW = 1, 2, 32


def bit(value: Column, number: int) -> Column:
    return value.bitwiseAND(F.lit(1 << (number - 1))) != 0


def permissions(value: Column, revision: Column, is_owner: Column, is_locked: Column) -> Column:
    """struct of the eight permissions. High resolution printing needs bits 3 and 12, in revision 2 bit 3 only; owners may do all, and nothing may be done while locked."""
    high = bit(value, 3) & ((revision == 2) | bit(value, 12))
    named = {name: bit(value, n) for name, n in PERMISSION_BITS.items()} | {"print_high_res": high}
    return F.struct(*[(~is_locked & (is_owner | x)).alias(name) for name, x in named.items()])


def annotation_visible(flags: Column, is_popup: Column, is_open: Column, layer_visible: Column) -> Column:
    """Not invisible, hidden or kept from view, a popup only while open, and its layer visible."""
    return (flags.bitwiseAND(F.lit(INVISIBLE | HIDDEN | NO_VIEW)) == 0) & (~is_popup | is_open) & F.coalesce(layer_visible, F.lit(True))


def annotation_painted(flags: Column, rect: Column, layer_visible: Column) -> Column:
    """Not invisible, hidden or kept from view, its layer visible and its rectangle (l, b, r, t) not empty; popups are painted open or not."""
    return (flags.bitwiseAND(F.lit(INVISIBLE | HIDDEN | NO_VIEW)) == 0) & (rect["l"] < rect["r"]) & (rect["b"] < rect["t"]) & F.coalesce(layer_visible, F.lit(True))
