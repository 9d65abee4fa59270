"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import batches, encode_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: `limit` each, but for the first, which takes what is over."""
    first = n % limit or limit
    at = [0, *range(first, n, limit)]
    return list(zip(at, [b - a for a, b in zip(at, [*at[1:], n])]))


def pieces(docs: DataFrame, path: str, limit: int, end_id: int = 0) -> DataFrame:
    """A row for each piece, with its task and its place among the task's pieces of that length."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, tail = TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for part, texts in batches(rows):
            out = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode_bytes(texts, path)):
                ids += tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    out.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, nth))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Bins of one filling are handled as a group (first sequence, how many). Returns
    (length, first rank, last rank + 1, first sequence, pieces to a sequence, offset):
    the piece of rank r goes to sequence first + (r - first rank) // pieces, at offset +
    (r - first rank) % pieces * length. Each length splits two groups at most, so there
    are at most a few slots for each length, however many documents there are.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []  # ascending, of groups with bins
    slots, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                bisect.insort(open_rooms, room)
            free.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(open_rooms, length)
            if k < len(open_rooms):
                room = open_rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], open_rooms[k]
            else:
                room, first, n = limit, bins, -(-left // (limit // length))
                bins += n
            each = room // length
            full, over = min(n, left // each), 0
            if full < n:
                over = left - full * each
            took = full * each + over
            slots.append((length, rank, rank + took, first, each, limit - room))
            put(room - each * length, first, full)
            put(room - over * length, first + full, bool(over))
            put(room, first + full + bool(over), n - full - bool(over))
            rank, left = rank + took, left - took
    return slots


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text, ...).

    A null or empty text is a piece of the end id alone. Repeated rows are packed as often
    as they come; pieces of equal length take the planned slots in the order of tasks.
    Other columns are left out; an empty table gives no rows. To the driver go at most
    `limit` rows, the histogram of lengths. The slots, of which there are a few for each
    length, are broadcast; their number is bounded by `limit`, not by the documents.
    """
    spark = docs.sparkSession
    cut_up = written(pieces(docs, path, limit, end_id), "pieces")
    counts = cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(best_fit(histogram, limit), "slot_length long, low long, high long, sequence long, each long, base long")
    before = counts.select(F.col("length").alias("of_length"), F.col("task").alias("of_task"), (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut_up.join(before, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task"))).withColumn("rank", F.col("before") + F.col("nth"))
    at = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
