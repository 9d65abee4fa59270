"""Mixing sources to target weights by the cube method.

A source that shall give r times its words takes each of its documents floor(r) times,
and once more with the rest of r as probability, chosen by balanced sampling: the vector
of probabilities moves at random inside the null-space of the constraints (sum of words,
number of documents) until it meets a face of the cube, so that a document is decided and
both sums are what they were. Three undecided documents are enough for a move, so a task
streams over its documents with that many at hand.

Equal rows are one unit with their number of rows, which is taken as often as all of them.
Units of a source are dealt by hash into blocks; each block leaves two undecided at most.
These form new blocks, and so on, until two are left of each source. A few units of every
order of size are held back before: with them the rest lands, by the choice among all
their subsets whose words come nearest to what is due.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Units to a block; orders of size, as powers of two, below which two units are held back for a source's landing, from which on one.
BLOCK, TWICE = 4_096, 6
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words that each source gives: `share` of all sizes by weight, none over `most` times its own size; what is over is shared again by weight."""
    total, capped = share * sum(sizes), set()
    out = [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / weight
        over = [i for i in free if out[i] > most * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = most * sizes[i]
        capped |= set(over)
        if len(capped) == len(sizes):
            return out


def _walk(units: list[list], draw: int) -> None:
    """Moves the chances of two or three units [chance, size, ...] until one of them is 0 or 1; draw: a number from 0 to 2**32 - 1."""
    sizes = [u[1] for u in units]
    if len(units) == 3:
        move = [sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1]]
        if not any(move):
            move = [1, -1, 0]
    else:
        move = [1, -1]
    scale = max(map(abs, move))
    move = [m / scale for m in move]
    up = min((1 - u[0]) / m if m > 0 else u[0] / -m for u, m in zip(units, move) if m)
    down = min(u[0] / m if m > 0 else (1 - u[0]) / -m for u, m in zip(units, move) if m)
    step = up if draw * (up + down) < down * 4294967296.0 else -down
    for u, m in zip(units, move):
        x = u[0] + step * m
        u[0] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def _flight(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the units of each block; rows come ordered by source and block, and by size from the largest, so that what stays undecided is small. Three undecided ones are held."""
    held: list[list] = []
    of = None
    for batch in rows:
        out: list[tuple] = []
        for number, block, draw, doc, mark, size, n, chance in zip(*(c.to_pylist() for c in batch.columns)):
            if (number, block) != of:
                out += [(of[0], *u[2:], u[1], u[0]) for u in held]
                held, of = [], (number, block)
            held.append([chance, size, draw, doc, mark, n])
            while len(held) == 3:
                _walk(held, draw & 0xFFFFFFFF)
                out += [(number, *u[2:], u[1], u[0]) for u in held if u[0] in (0.0, 1.0)]
                held = [u for u in held if u[0] not in (0.0, 1.0)]
        if out:
            yield _batch(out)
    if held:
        yield _batch([(of[0], *u[2:], u[1], u[0]) for u in held])


_FIELDS = "number int, draw long, doc_id long, mark long, n long, size long, chance double"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _FIELDS.split(", ")])


def _subsets(units: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and number of units of each subset; bit i says whether unit i is in."""
    words, count = np.zeros(1), np.zeros(1)
    for _, size in units:
        words, count = np.concatenate([words, words + size]), np.concatenate([count, count + 1])
    return words, count


def land(units: list[tuple[float, int]]) -> list[int]:
    """0 or 1 for each (chance, size): words as near as any choice goes to the sum of chance * size, then a number of units near to the sum of chances. Subsets of either half are listed, and each of the first is met with the nearest of the second."""
    want, number = sum(c * s for c, s in units), sum(c for c, _ in units)
    half = len(units) // 2
    (words, count), (others, other_count) = _subsets(units[:half]), _subsets(units[half:])
    order = np.lexsort((other_count, others))
    at = np.searchsorted(others[order], want - words)
    best = None
    for to in (at - 1, at):
        to = order[np.clip(to, 0, len(order) - 1)]
        away, off = np.abs(words + others[to] - want).round(6), np.abs(count + other_count[to] - number).round(6)
        i = int(np.lexsort((off, away))[0])
        best = min(best or (np.inf,), (away[i], off[i], i, int(to[i])))
    chosen = best[2] | best[3] << half
    return [chosen >> i & 1 for i in range(len(units))]


def _landing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the last units of each source, which are few; rows come ordered by source."""
    held: list[tuple] = []

    def landed() -> pa.RecordBatch:
        return _batch([(*u[:6], float(x)) for u, x in zip(held, land([(u[6], u[5]) for u in held]))])

    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield landed()
                held = []
            held.append(row)
    if held:
        yield landed()


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, mark: Column | None = None) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source, ...).

    size: words `[^\\x20\\x09-\\x0D]+` of the text; mark: xxhash64 of it, or another long that
    tells rows apart. Sources in the order of their code points, null last, have the weights
    in turn. Every row is taken `copies` times, ceil(most) at most. Draws are hashes of doc_id,
    size and mark under the seed, so reruns agree on any number of tasks. Rows equal in source,
    doc_id, size and mark are one unit, whose copies are dealt out evenly, so that two of them
    differ by 1 at most. Null doc_id is a value like others; null and empty texts have size 0
    and a part in the number of documents. A source without words has target 0 and is taken 0
    times. An empty table gives no rows. Sources are listed at the driver; all else is spread.
    """
    spark = docs.sparkSession
    mark = F.xxhash64("text") if mark is None else mark
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), mark.alias("mark"))
    sized = written(sized.groupBy("source", "doc_id", "size", "mark").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).orderBy(F.asc_nulls_last("source")).collect()
    weight = [float(weights[i % len(weights)]) for i in range(len(sources))]
    share_of = targets([r["size"] for r in sources], weight, share, most) if sources else []
    known = spark.createDataFrame([(i, r["source"], r["size"], float(t), t / r["size"] if r["size"] else 0.0) for i, (r, t) in enumerate(zip(sources, share_of))], "number int, of_source string, source_size long, target double, rate double")
    due = F.col("n") * F.col("rate")
    units = sized.join(known, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size", "mark")).withColumn("chance", due - F.floor(due))
    open_ = F.col("chance").between(1e-9, 1 - 1e-9)
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    sure = units.where(~open_).withColumn("chance", F.round("chance")).select(names)
    order = F.length(F.bin("size"))
    left = units.where(open_).withColumn("order", order).withColumn("half", F.when(F.col("order") <= TWICE, F.pmod("draw", F.lit(2))).otherwise(0))
    first = left.groupBy(F.col("number").alias("of_number"), F.col("order").alias("of_order"), F.col("half").alias("of_half")).agg(F.min("draw").alias("least"))
    left = left.join(first, (F.col("number") == F.col("of_number")) & (F.col("order") == F.col("of_order")) & (F.col("half") == F.col("of_half"))).withColumn("held", F.col("draw") == F.col("least"))
    left = written(left.select(*names, "held"), "units")
    back, left = left.where("held").select(names), left.where("not held").select(names)
    decided, last = [sure], False
    while not last:
        counted = left.groupBy("number").agg(F.count(F.lit(1)).alias("n_left"))
        blocks = counted.select(F.col("number").alias("of_number"), F.ceil(F.col("n_left") / BLOCK).cast("long").alias("blocks"))
        last = not blocks.where("blocks > 1").limit(1).count()
        dealt = left.join(F.broadcast(blocks) if len(sources) <= 100_000 else blocks, F.col("number") == F.col("of_number"))
        dealt = dealt.select("number", F.pmod(F.xxhash64(F.lit(len(decided)), "draw"), F.col("blocks")).cast("int").alias("block"), "draw", "doc_id", "mark", "size", "n", "chance")
        flown = dealt.repartition("number", "block").sortWithinPartitions("number", "block", F.desc("size"), "draw", F.asc_nulls_first("doc_id"), "mark", "chance").mapInArrow(_flight, _FIELDS)
        flown = written(flown, "flown")
        decided.append(flown.where(F.col("chance").isin(0.0, 1.0)))
        left = flown.where(~F.col("chance").isin(0.0, 1.0))
    decided.append(left.union(back).repartition("number").sortWithinPartitions("number", "draw", F.asc_nulls_first("doc_id"), "size", "mark", "chance").mapInArrow(_landing, _FIELDS))
    found = reduce(DataFrame.union, decided).join(known, "number").withColumn("taken_of_all", (F.floor(due) + F.col("chance")).cast("long"))
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.expr("taken_of_all div n") + (F.col("nth") <= F.col("taken_of_all") % F.col("n")).cast("long")
    return each.select("doc_id", "mark", F.col("of_source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
