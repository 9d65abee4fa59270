"""Connected components: of few edges in one task, of more by alternating stars, without any group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Edges, counted, that one task takes: 16 bytes each. More are spread.
ONE_TASK = 1 << 20


def least_reached(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges, and the least that each reaches: labels fall along edges and are followed until none changes."""
    names, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(rows)
    if held:
        v, u = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("v", "u"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(v, u)], ["v", "root"])


def _near(edges: DataFrame) -> DataFrame:
    """v, u both ways."""
    return edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))


def components(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex that each vertex of an edge reaches; edges has longs v and u.

    Up to ONE_TASK edges are one task's work on an executor. Of more, large and small stars alternate until the edges no longer change. A vertex's least
    neighbour comes from an aggregate with map-side combination and is joined back, so
    a vertex with very many edges is spread over tasks by the skew join. Each round's
    edges are written to the shared folder. Loops and repeated edges are harmless; no
    edges give no rows.
    """
    now = written(edges.where("v != u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        roots = written(now.repartition(1).mapInArrow(_whole, "v long, root long"), "roots")
        discard(now)
        return roots
    state = None
    while True:
        near = _near(now)
        least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = near.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        large = written(large, "large")
        # each vertex points to lesser ones only
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).where("v != u").distinct()
        before, now = now, written(small, "edges")
        discard(before, large)
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if new == state:
            break
        state = new
    roots = written(now.select("v", F.col("u").alias("root")).union(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct()), "roots")
    discard(now)
    return roots
