"""PDF dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+\-])(\d{2})(?:'?(\d{2}))?)?"


def pdf_date(text: Column) -> Column:
    """struct(ts, offset_min) of `D:YYYYMMDDHHmmSS+HH'mm'`. Parts after the year may be missing; no sign is UTC; what is no date is null. ts is the instant in UTC."""
    part = lambda i, missing: F.coalesce(F.nullif(F.regexp_extract(text, PATTERN, i), F.lit("")), F.lit(missing)).cast("int")
    sign = F.when(F.regexp_extract(text, PATTERN, 7) == "-", -1).otherwise(1)
    hours, minutes = part(8, "0"), part(9, "0")
    offset = sign * (hours * 60 + minutes)
    local = F.try_make_timestamp(part(1, "0"), part(2, "1"), part(3, "1"), part(4, "0"), part(5, "0"), part(6, "0").cast("decimal(8,6)"), F.lit("UTC"))
    good = text.rlike(PATTERN) & (part(4, "0") < 24) & (part(6, "0") < 60) & (F.abs(offset) <= 840) & (minutes < 60) & (part(1, "0") > 0)
    return F.when(good & local.isNotNull(), F.struct(F.timestamp_seconds(F.unix_timestamp(local) - offset * 60).alias("ts"), offset.alias("offset_min")))
