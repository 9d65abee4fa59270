"""Font names, types and how well one font stands in for another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a family or a style; points for what agrees and for what does not.
MONO_WANTED, MONO_FOUND = ("courier", "mono"), ("mono", "courier")
SERIF_WANTED, SERIF_FOUND = ("times", "serif", "roman"), ("serif", "times", "roman")
SANS_FOUND = ("sans", "arial", "helvetica")
BOLD, ITALIC = ("bold",), ("italic", "oblique")
NARROW, WIDE = ("narrow", "condensed", "compressed"), ("expanded", "extended", "wide")
FREE = ("dejavu", "liberation", "nimbus")
FAMILY, STYLE, WIDTH, NAME, FREE_FONT, CONFIGURED = 100, (20, -10), (35, -25), 50, 5, 1000


def plain_name(name: Column) -> Column:
    """Without the six characters and plus sign of a subset, hyphens and underscores, in lower case."""
    return F.lower(F.translate(F.regexp_replace(name, "(?s)^[^+]{6}[+]", ""), "-_", ""))


def is_subset(name: Column) -> Column:
    return name.rlike("^[A-Z]{6}[+].")


def font_type(declared: Column, effective: Column, embedded: Column) -> Column:
    """The type of a font from its own subtype, its descendant's and the format of its program (OpenType, CFF, or another or null)."""
    cid = F.when(effective == "CIDFontType0", "CidType0").when(effective == "CIDFontType2", "CidType2").otherwise("Unknown")
    simple = F.when(declared.isin("Type1", "MMType1"), "Type1").when(declared == "TrueType", "TrueType").otherwise("Unknown")
    return F.when(declared == "Type0", cid).when(declared == "Type3", "Type3").when(embedded == "OpenType", "OpenType").when(embedded == "CFF", "Type1C").otherwise(simple)


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [x.contains(w) for w in words])


def font_score(name: Column, wanted: Column, configured: Column) -> Column:
    """How well the font in a file of this name (without extension) stands in for the plain name wanted; more is better."""
    have = F.lower(F.translate(name, "-_", ""))
    family = F.when(_any(wanted, MONO_WANTED), _any(have, MONO_FOUND)).when(_any(wanted, SERIF_WANTED), _any(have, SERIF_FOUND)).otherwise(_any(have, SANS_FOUND))
    points = lambda hit, yes, no=0: F.when(hit, yes).otherwise(no)
    agree = [points(_any(have, words) == _any(wanted, words), *worth) for words, worth in ((BOLD, STYLE), (ITALIC, STYLE), (NARROW, WIDTH), (WIDE, WIDTH))]
    alike = have.contains(wanted) | wanted.contains(have)
    return sum(agree, points(family, FAMILY)) + points(alike, NAME) + points(_any(have, FREE), FREE_FONT) + points(configured, CONFIGURED)
