"""Lookups as joins: as-of, range, priority and override."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """rows with `values` of the last mark at or before each one's `order`, within `by`; null where there is none.

    Both have the columns `by` and `order`. Done as a union and one window per group: a
    shuffle by group, no range join. Of marks at one place the values are those of the greatest.
    """
    values_of = F.struct(*values)
    left = rows.select(*rows.columns, F.lit(None).cast(marks.select(values_of.alias("v")).schema["v"].dataType).alias("_mark"), F.lit(1).alias("_kind"))
    right = marks.select(*[F.col(c) if c in (*by, order) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], values_of.alias("_mark"), F.lit(0).alias("_kind"))
    seen = Window.partitionBy(*by).orderBy(order, "_kind", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_mark", F.last("_mark", ignorenulls=True).over(seen))
    return both.where("_kind = 1").select(*rows.columns, *[F.col(f"_mark.{v}").alias(v) for v in values])


def last_before(marks: Column, order: str, at: Column) -> Column:
    """Of an array of marks, each a struct that begins with `order`, the last at or before `at`, as `as_of` finds it; null if there is none. Nothing is shuffled; each look goes over the whole array."""
    return F.array_max(F.filter(marks, lambda m: m[order] <= at))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should end in something unique. An aggregate with map-side combination, no window."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), ranked).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def override(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources with one row per key: that of the last source that has it."""
    ranked = [s.withColumn("_rank", F.lit(-i)) for i, s in enumerate(sources)]
    return first_by(reduce(DataFrame.unionByName, ranked), keys, F.col("_rank")).drop("_rank")


def range_lookup(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int, latest: str) -> DataFrame:
    """rows left-joined with the range that holds `value`, the one with the greatest `latest` if there are several.

    Ranges are dealt into buckets of `width` and joined by bucket, so the plan has an
    equi-join and no product; a range costs a row for each bucket that it meets. The best
    range is found once for each distinct value, which then goes back to its rows.
    """
    spread = ranges.select(F.struct("*").alias("_range"), F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("_bucket"))
    values = rows.select(F.col(value).alias("_value")).where("_value is not null").distinct()
    hit = values.withColumn("_bucket", F.floor(F.col("_value") / width)).join(spread, "_bucket").where(F.col("_value").between(F.col(f"_range.{low}"), F.col(f"_range.{high}")))
    best = hit.groupBy("_value").agg(F.max_by("_range", f"_range.{latest}").alias("_found"))
    return rows.join(best, F.col(value) == F.col("_value"), "left").select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in ranges.columns])


def page_of_label(wanted: DataFrame, pages: DataFrame, keys: list[str], label: str, page: str, strict: bool = False) -> DataFrame:
    """wanted (keys, label, ...) with the first page of that label, null where no page has it; `strict` makes that an error.

    The first page of each label is an aggregate with map-side combination.
    """
    first = pages.groupBy(*keys, label).agg(F.min(page).alias(page))
    found = F.coalesce(page, F.raise_error(F.concat(F.lit("no page has label "), F.coalesce(label, F.lit("null"))))) if strict else F.col(page)
    return wanted.join(first, [*keys, label], "left").select(*wanted.columns, found.alias(page))


def page_rows(rows: DataFrame, pages: Column, number: Column, page: str) -> DataFrame:
    """rows of the page of a number from 1; a number that a document of so many `pages` lacks is an error."""
    told = F.when(number.between(1, pages), number - 1).otherwise(F.raise_error(F.concat(F.lit("no page "), number.cast("string"))).cast("int"))
    return rows.where(F.col(page) == told)


def having(rows: DataFrame, others: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """rows whose keys are in others (where a condition on these holds), each once: fields with a widget on a page."""
    return rows.join((others if where is None else others.where(where)).select(*keys), keys, "left_semi").select(*rows.columns)


def unknown(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys no row of `known` has, such as overrides of layers that are not there."""
    return rows.join(known.select(*keys), keys, "left_anti").select(*rows.columns)


def all_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows; a row whose keys no row of `known` has is an error when it is read."""
    marked = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    names = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    sure = F.coalesce("_known", F.raise_error(F.concat(F.lit("unknown identifier "), names)).cast("boolean"))
    return rows.join(marked, keys, "left").where(sure).select(*rows.columns)


def linked(rows: DataFrame, keys: list[str], id: str, links: dict[str, list[str]]) -> DataFrame:
    """rows with columns of the row that each link names by its id, within keys: links maps a column with an id to the columns to bring, named link_column. Null where none has the id, the least where several do."""
    out = rows
    for link, columns in links.items():
        target = rows.where(F.col(id).isNotNull()).groupBy(*keys, F.col(id).alias(link)).agg(F.min(F.struct(*columns)).alias("_target"))
        out = out.join(target, [*keys, link], "left").select(*out.columns, *[F.col(f"_target.{c}").alias(f"{link}_{c}") for c in columns])
    return out


def in_order(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All rows of the parts, those of the first before those of the next; `order` counts them anew from 0 within keys."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", order)) - 1
    return reduce(DataFrame.unionByName, marked).withColumn(order, place.cast("int")).drop("_part")
