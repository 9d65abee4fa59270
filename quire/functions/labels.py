"""Page label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits by decimal place.
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def _digit(names: list[str], n: Column, place: int) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.floor(n / place) % 10).cast("int"))


def roman(n: Column) -> Column:
    """Upper-case Roman numeral; empty for 0 and less."""
    text = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), _digit(HUNDREDS, n, 100), _digit(TENS, n, 10), _digit(ONES, n, 1))
    return F.when(n > 0, text).otherwise("")


def letters(n: Column) -> Column:
    """A to Z, then AA, BB and so on; empty for 0 and less."""
    return F.when(n > 0, F.repeat(F.char((65 + (n - 1) % 26).cast("int")), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")


def page_label(prefix: Column, style: Column, n: Column) -> Column:
    """The label of a page: prefix, and its number in the style D, R, r, A or a; another style gives the prefix only."""
    number = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", letters(n)).when(style == "a", F.lower(letters(n))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), number)
