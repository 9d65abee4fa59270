"""Form choices, appearance states and destinations as expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice_options(options: Column, values: Column, chosen: Column) -> Column:
    """Options (export, display) with selected: by their places where /I names any, else by whether the value has their export."""
    by_place = F.size(F.coalesce(chosen, F.array().cast("array<int>"))) > 0
    return F.transform(options, lambda o, i: F.struct(o["export"].alias("export"), o["display"].alias("display"), F.when(by_place, F.array_contains(chosen, i)).otherwise(F.coalesce(F.array_contains(values, o["export"]), F.lit(False))).alias("selected")))


def appearance_state(states: Column, value: Column, current: Column, is_toggle: Column) -> Column:
    """The appearance to show: for check boxes and radio buttons value before current, for others current before value, then Off, then the first by name; only of those that there are."""
    of = lambda x: F.when(F.array_contains(states, x), x)
    first, second = F.when(is_toggle, value).otherwise(current), F.when(is_toggle, current).otherwise(value)
    return F.coalesce(of(first), of(second), of(F.lit("Off")), F.array_min(states))


def first_page(rows: DataFrame, lookups: list[tuple[DataFrame, str]], key: str, page: str) -> DataFrame:
    """rows with `page` from the first lookup (table of a name and `page`) that has the row's `key`; null where none has, the least page where a lookup has several of a name."""
    out = rows
    for i, (table, name) in enumerate(lookups):
        out = out.join(table.groupBy(F.col(name).alias(f"_k{i}")).agg(F.min(page).alias(f"_p{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    return out.select(*rows.columns, F.coalesce(*[f"_p{i}" for i in range(len(lookups))]).alias(page))


def point_count(lists: list[Column], ink: Column) -> Column:
    """Points of all lists and of all ink paths."""
    total = F.aggregate(F.transform(ink, F.size), F.lit(0), lambda a, b: a + b)
    for x in lists:
        total = total + F.size(x)
    return total


def bounds(xs: Column, ys: Column) -> Column:
    """The box of points."""
    return F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("b"), F.array_max(xs).alias("r"), F.array_max(ys).alias("t"))


def gradient(x: Column, stops: list[tuple[float, float]]) -> Column:
    """A component at x, linear between the stops (place, value) around it, flat beyond them; of stops at one place the last counts from there on."""
    out = F.lit(float(stops[-1][1]))
    for (a, va), (b, vb) in reversed(list(zip(stops, stops[1:]))):
        inside = F.lit(float(va)) if a == b else F.lit(float(va)) + (x - a) * ((vb - va) / (b - a))
        out = F.when(x < b, inside).otherwise(out)
    return F.when(x < stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)
