"""Visibility policies, counts and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("AnyOn", "AllOn", "AnyOff", "AllOff")


def membership_visible(policy: Column, states: Column) -> Column:
    """Whether a set of layers' states is visible; an empty or null set is, and an unknown policy is AnyOn."""
    on, off = F.exists(states, lambda s: s), F.exists(states, lambda s: ~s)
    return F.when(states.isNull() | (F.size(states) == 0), F.lit(True)).when(policy == "AllOn", ~off).when(policy == "AnyOff", off).when(policy == "AllOff", ~on).otherwise(on)


def layer_states(layers: DataFrame) -> DataFrame:
    """layers (base, is_on, is_off, view_state, ...) with visible: base state, then ON, then OFF, then the automatic view state, the later the stronger. Unchanged counts as on."""
    return layers.withColumn("visible", F.coalesce("view_state", F.when(F.col("is_off"), False), F.when(F.col("is_on"), True), F.col("base") != "OFF"))


def expression_visible(expression: list | str, states: dict[str, Column]) -> Column:
    """A visibility expression ["And"|"Or"|"Not", ...] over layer names, compiled to a column; what is malformed is visible."""
    if isinstance(expression, str):
        return states.get(expression, F.lit(True))
    if not expression or expression[0] not in ("And", "Or", "Not"):
        return F.lit(True)
    parts = [expression_visible(x, states) for x in expression[1:]]
    if expression[0] == "Not":
        return ~parts[0] if len(parts) == 1 else F.lit(True)
    out = F.lit(expression[0] == "And")
    for x in parts:
        out = out & x if expression[0] == "And" else out | x
    return out


def count_kinds(elements: DataFrame, by: list[str], kind: str, names: dict[str, list[str]]) -> DataFrame:
    """by and for each name the number of elements of its kinds, in one pass."""
    return elements.groupBy(*by).agg(*[F.count_if(F.col(kind).isin(kinds)).alias(name) for name, kinds in names.items()])


def top_k(rows: DataFrame, score: Column, k: int, *ties: str) -> DataFrame:
    """The k rows of highest score, ties in the order of `ties`. One pass with a heap per task."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(k)


def unique_names(files: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """files with file_name: characters that are not safe replaced, and from the second of a name on a number before its extension."""
    safe = F.regexp_replace(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("file")), r'[\x00-\x1f<>:"/\\|?*]', "_")
    nth = F.row_number().over(Window.partitionBy(*by, F.lower("_safe")).orderBy(*order))
    stem, extension = F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_safe", safe).withColumn("_nth", nth).withColumn("file_name", F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(F.concat(stem, F.lit("-"), F.col("_nth").cast("string"), extension))).drop("_safe", "_nth")
