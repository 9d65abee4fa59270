"""Quartile bucket digests of texts, and their likeness.

A digest counts hashed byte triplets of a text in 256 buckets, writes of each bucket in
which quartile of the text's own counts it lies (two bits), and puts the text's length,
on a logarithmic scale, before that. Digests differ by the sum of the buckets' distances,
where opposite ends count double, and of a capped distance of lengths; the likeness is
1 less the difference over the most that it can be.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, slices
from .substrings import _squeezed

BUCKETS = 256
#: Offsets of the bytes that make a triplet with the first one.
TRIPLETS = ((3, 6), (4, 9))
#: Most that a bucket's and the length's distances count.
FAR, FAR_LENGTH = 6, 2 * BUCKETS
DISTANCE = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
#: Bytes whose triplets are counted at once.
COUNT_BYTES = 1 << 20


def _bucket_of(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    x = a.astype(np.uint32) | (b.astype(np.uint32) << np.uint32(8)) | (c.astype(np.uint32) << np.uint32(16))
    x = (x ^ np.uint32(0x9E3779B9 * salt & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return (x >> np.uint32(24)).astype(np.int64)


def counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text in each bucket."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= COUNT_BYTES):
            size += len(texts[to])
            to += 1
        part = texts[at:to]
        if len(part) == 1:
            for i in range(0, len(part[0]), COUNT_BYTES):
                _add(out[at:to], [part[0][i : i + COUNT_BYTES + max(q for _, q in TRIPLETS)]], limit=COUNT_BYTES)
        else:
            _add(out[at:to], part)
        at = to
    return out


def _add(out: np.ndarray, texts: list[bytes], limit: int | None = None) -> None:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    for salt, (p, q) in enumerate(TRIPLETS, 1):
        if len(data) <= q:
            continue
        bucket = _bucket_of(data[:-q], data[p : len(data) - q + p], data[q:], salt)
        same = row[:-q] == row[q:]
        if limit:
            same[limit:] = False
        out += np.bincount((row[:-q] * BUCKETS + bucket)[same], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def length_code(n: int) -> int:
    return min(255, round(8 * math.log2(n + 1)))


def digests(texts: list[bytes]) -> list[str]:
    """Hex of the length code and of the buckets' quartiles, two bits each; equal texts, equal digests."""
    if not texts:
        return []
    n = counts(texts)
    ordered = np.sort(n, axis=1)
    code = sum((n > ordered[:, BUCKETS * i // 4 - 1 : BUCKETS * i // 4]).astype(np.uint8) for i in (1, 2, 3))
    packed = code[:, 0::4] | (code[:, 1::4] << 2) | (code[:, 2::4] << 4) | (code[:, 3::4] << 6)
    return [f"{length_code(len(x)):02x}{bytes(row).hex()}" for x, row in zip(texts, packed)]


def _unpacked(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(found)), np.uint8).reshape(len(found), -1)
    codes = np.stack([(raw[:, 1:] >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(found), -1)
    return raw[:, 0].astype(np.int64), codes


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests down to 0."""
    if not a:
        return np.empty(0)
    (la, ca), (lb, cb) = _unpacked(a), _unpacked(b)
    far = DISTANCE[ca, cb].sum(axis=1) + np.minimum(np.abs(la - lb) * 4, FAR_LENGTH)
    return np.maximum(0.0, 1 - far / (FAR * BUCKETS // 2))


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many, or all, of another."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealt(rows: Iterator[pa.RecordBatch], bounds: list[int], low: int | None) -> Iterator[pa.RecordBatch]:
    """Rows with the range of doc_id that they lie in, and once more, as extra, the first rows of each range, in the one before; the first of all go to the last."""
    at = np.array(bounds, np.int64)
    for batch in rows:
        doc, null = batch.column("doc_id"), np.asarray(batch.column("doc_id").is_null())
        ids = np.asarray(doc.fill_null(0))
        part = np.where(null, 0, np.searchsorted(at, ids, "right"))
        first = np.flatnonzero(~null & np.isin(ids, at))
        whole = np.flatnonzero(null if low is None else ~null & (ids == low))
        take = pa.array(np.concatenate([np.arange(len(ids)), first, whole]))
        parts = np.concatenate([part, part[first] - 1, np.full(len(whole), len(at))]).astype(np.int32)
        extra = np.arange(len(take)) >= len(ids)
        yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns] + [pa.array(parts), pa.array(extra)], [*batch.schema.names, "part", "extra"])


def _followed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows in the order of extra, doc_id and mark; what comes after a range's last document is there as extra."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[list] = []  # [key, text, rows to return, digest], distinct keys

    def done(entries: list[list], following: list[list]) -> Iterator[pa.RecordBatch]:
        pairs = [(e, f) for e, f in zip(entries, following) if e[2]]
        if not pairs:
            return
        new = [edited(e[1], f[1]).encode() for e, f in pairs]
        other = digests(new)
        near = likeness([e[3] for e, _ in pairs], other)
        after = likeness([e[3] for e, _ in pairs], [f[3] for _, f in pairs])
        out = [(e[0][0], len(e[1]), hashlib.sha256(x).hexdigest(), e[3], d, float(p), float(q), e[2]) for (e, _), x, d, p, q in zip(pairs, new, other, near, after)]
        take = np.repeat(np.arange(len(out)), [x[-1] for x in out])
        columns = list(zip(*out))[:-1]
        whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], [x.split()[0] for x in RESULT.split(", ")])
        for i in range(0, len(take), 50_000):
            yield whole.take(pa.array(take[i : i + 50_000]))

    for batch in rows:
        for part in slices(batch, "text", 1 << 19):
            new: list[list] = []
            for doc, mark, z, extra in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text", "extra"))):
                last = new[-1] if new else held[-1] if held else None
                if last and last[0] == (doc, mark):
                    last[2] += not extra
                else:
                    new.append([(doc, mark), unpack(z).decode(), int(not extra), ""])
            for e, d in zip(new, digests([e[1].encode() for e in new])):
                e[3] = d
            held += new
            yield from done(held[:-1], held[1:])
            held = held[-1:]
    yield from done(held, held)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of every row of docs (doc_id, text, ...), of its text with the last quarter exchanged, and their likeness to each other and to the next document's.

    The next document is that of the next doc_id, null first; after the last comes the first. Rows
    with one doc_id and different texts follow each other by xxhash64 of the text; rows equal in both are one document, and each gives
    a row. Null texts are empty; an empty text's digest is that of no triplets. A lone document is
    its own next one. Other columns are left out; an empty table gives no rows.

    Documents are dealt into ranges of doc_id once, compressed; a task sees its range in
    order, one document ahead, and the first of the next range.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    spread = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("at"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({x for x in spread.at or [] if x != spread.low or spread.nulls})
    low = None if spread.nulls else spread.low

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(_squeezed(rows), bounds, low)

    ranged = own.mapInArrow(deal, "doc_id long, text binary, mark long, part int, extra boolean")
    return ranged.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("extra", F.asc_nulls_first("doc_id"), "mark").select("doc_id", "text", "mark", "extra").mapInArrow(_followed, RESULT)
