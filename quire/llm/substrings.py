"""Exact repeated passages by prefix-partitioned suffix trees.

Every place where `span` words follow is a suffix, of which the tree is needed down to
depth `span`. Suffixes are parted by prefixes of variable length: one runs from the
suffix's first word to the end of the window's minimizer, the `GRAM`-word sequence of least
hash in it. Equal windows have equal minimizers, so a group - all suffixes of one
minimizer - holds each of its subtrees whole. Prefixes are planned: suffixes are counted by
minimizer, and where more than HEAVY share one, the prefix is lengthened to the whole
window. A first exchange, of places only, tells which prefixes have two suffixes or more;
subtrees of a single leaf end there.

For the others the words themselves go to the groups, neighbouring suffixes of a text in
one row. A block of whole groups that fits in memory is put in order by names of doubling
length: each sequence of 2k words is named by the rank of the names of its two halves, so
that names order suffixes as their words do. Two neighbouring leaves with one name at depth
`span` have an internal node that deep above them, which is a repeat; runs of such leaves
along a text are its maximal repeats. Words are told apart by 64-bit hashes, each by itself;
windows of a lengthened prefix are compared as bytes and never held.

Of suffixes with equal windows in one slice of a task, two go on; more are known to be
repeated there and then. So a passage that a third of all documents hold reaches its group
as two rows of each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .kernels import arrow_bytes, mix, slices, span_hashes, window_starts, word_hashes, words

GRAM = 8
#: Windows in a row at most, and bytes of rows that make a block.
RUN, BLOCK = 1024, 2 << 20
#: Bytes of text in which equal windows are found before they are sent.
SLICE = 2 << 20
#: Kinds of rows: suffixes of one prefix, known repeats, a window that is its prefix.
PARTED, KNOWN, WHOLE = 0, 1, 2
#: Windows of one minimizer beyond which its prefix is lengthened.
HEAVY = 1 << 17


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; breaks[i]: a run begins at i."""
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def _windows(part: pa.RecordBatch, span: int) -> tuple[np.ndarray, ...] | None:
    """Starts of windows, counts of rows, offsets of rows in words, minimizers, digests, and how often a window of its kind came before, 2 at most."""
    data, off = arrow_bytes(part.column("text"))
    s, e, woff = words(data, off)
    starts, counts = window_starts(woff, span)
    if not len(starts):
        return None
    hashes = word_hashes(data, s, e)
    gram = min(GRAM, span)
    at = np.arange(len(hashes) - gram + 1)
    key = sliding_min(span_hashes(hashes, at, at + gram), span - gram + 1)[starts]
    path = span_hashes(hashes, starts, starts + span)
    order = np.argsort(path, kind="stable")
    ordered = path[order]
    before = np.zeros(len(path), np.int8)
    before[order[1:]] += ordered[1:] == ordered[:-1]
    before[order[2:]] += (ordered[2:] == ordered[1:-1]) & (ordered[2:] == ordered[:-2])
    return starts, counts, woff, key, path, before


def _bucket(key: np.ndarray) -> np.ndarray:
    """32 bits of minimizers, by which they are counted; one that shares them with a heavy one is lengthened too, and nothing but bytes is lost."""
    return mix(key).astype(np.uint32).view(np.int32)


def _sizes(part: pa.RecordBatch, span: int) -> pa.RecordBatch | None:
    found = _windows(part, span)
    if found is None:
        return None
    *_, key, _, before = found
    buckets, n = np.unique(_bucket(key[before < 2]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(n.astype(np.int64))], ["bucket", "n"])


_PLACES = "key long, doc_id long, mark long, first long, n int, kind int"
_NAMES = [x.split()[0] for x in _PLACES.split(", ")]


def _suffixes(part: pa.RecordBatch, span: int, heavy: np.ndarray) -> pa.RecordBatch | None:
    """Rows of neighbouring suffixes of one prefix; no two windows of a row are equal."""
    found = _windows(part, span)
    if found is None:
        return None
    starts, counts, woff, key, path, before = found
    row = np.repeat(np.arange(len(counts)), counts)
    kind = np.where(before == 2, KNOWN, np.where(np.isin(_bucket(key), heavy), WHOLE, PARTED)).astype(np.int32)
    key = np.where(kind == WHOLE, path, key)
    breaks = np.ones(len(key), bool)
    breaks[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] == PARTED) & (key[1:] != key[:-1])) | (before[1:] == 1) | (kind[1:] == WHOLE)
    first, _ = _runs(breaks)
    breaks |= (np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))) % RUN == 0
    first, n = _runs(breaks)
    rows = pa.array(row[first])
    mark = part.column("mark").take(rows)
    keys = np.where(kind[first] == KNOWN, np.asarray(mark), key[first].view(np.int64))  # what needs no group goes anywhere
    return pa.RecordBatch.from_arrays([pa.array(keys), part.column("doc_id").take(rows), mark, pa.array(starts[first] - woff[row[first]]), pa.array(n.astype(np.int32)), pa.array(kind[first])], _NAMES)


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by key, those whose prefix another one has too, and what is known. One row is held."""
    last, paired = None, False  # paired: the last row has the key of the one before
    for batch in rows:
        known = batch.filter(pa.array(np.asarray(batch.column("kind")) == KNOWN))
        if known.num_rows:
            yield known
        batch = batch.filter(pa.array(np.asarray(batch.column("kind")) != KNOWN))
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key = np.asarray(batch.column("key"))
        same = np.zeros(len(key) + 1, bool)
        same[0], same[1:-1] = paired, key[1:] == key[:-1]
        last, paired = batch.slice(len(key) - 1), bool(same[-2])
        hit = same[:-1] | same[1:]
        hit[-1] = False
        yield batch.filter(pa.array(hit))
    if paired:
        yield last


def _with_words(rows: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The places of each text with the words of their windows, joined by one space; twice where the text comes in several rows."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in rows:
        for part in slices(batch, "z", 1 << 19):
            out: list[tuple] = []
            for doc, mark, z, times, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "z", "times", "places"))):
                own = unpack(z).split() if z is not None else []
                for x in places:
                    row = (x["key"], doc, mark, x["first"], x["n"], x["kind"], b" ".join(own[x["first"] : x["first"] + x["n"] + span - 1]) if x["kind"] != KNOWN else None)
                    out += [row] * min(2 if x["kind"] != KNOWN else 1, times)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*_NAMES, "words"])


def names_at(hashes: np.ndarray, length: int) -> np.ndarray:
    """The rank, among all sequences of `length` values, of that which begins at each place, by doubling; places at the end have none."""
    _, name = np.unique(hashes, return_inverse=True)
    at = 1
    while at < length:
        step = min(at, length - at)
        _, name = np.unique(name[:-step].astype(np.int64) << 32 | name[step:], return_inverse=True)
        at += step
    return name


def _spans(doc, mark, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc, mark, pa.array(begin), pa.array(end)], ["doc_id", "mark", "begin", "end"])


def _repeats(block: pa.Table, span: int) -> pa.RecordBatch:
    """Maximal runs of repeated windows in whole groups."""
    block = block.combine_chunks()
    n, first = (np.asarray(block.column(c)).astype(np.int64) for c in ("n", "first"))
    data, off = arrow_bytes(block.column("words"))
    s, e, woff = words(data, off)
    starts, _ = window_starts(woff, span)
    name = names_at(word_hashes(data, s, e), span)[starts]
    order = np.argsort(name, kind="stable")
    ordered = name[order]
    deep = np.zeros(len(name) + 1, bool)  # deep[i]: leaves i - 1 and i have a node at the depth above them
    deep[1:-1] = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(name), bool)
    hit[order] = deep[:-1] | deep[1:]
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    ends[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    at, to = np.flatnonzero(begins), np.flatnonzero(ends)
    take = pa.array(row[at])
    return _spans(block.column("doc_id").combine_chunks().take(take), block.column("mark").combine_chunks().take(take), first[row[at]] + place[at], first[row[at]] + place[to] + span)


def _plain(rows: pa.RecordBatch, span: int) -> pa.RecordBatch:
    first, n = (np.asarray(rows.column(c)).astype(np.int64) for c in ("first", "n"))
    return _spans(rows.column("doc_id"), rows.column("mark"), first, first + n - 1 + span)


def _found(rows: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of rows ordered by key and words. Held are a block of groups and the last whole window."""
    held, size, limit = [], 0, BLOCK
    last, paired = None, False  # paired: the last whole window equals the one before
    for batch in rows:
        kind = np.asarray(batch.column("kind"))
        known, whole, batch = (batch.filter(pa.array(kind == k)) for k in (KNOWN, WHOLE, PARTED))
        if known.num_rows:
            yield _plain(known, span)
        if whole.num_rows:
            if last is not None:
                whole = pa.Table.from_batches([last, whole]).combine_chunks().to_batches()[0]
            text, many = whole.column("words"), whole.num_rows
            same = np.zeros(many + 1, bool)
            same[0], same[1:-1] = paired, np.asarray(pc.equal(text.slice(1), text.slice(0, many - 1)))
            last, paired = whole.slice(many - 1), bool(same[-2])
            hit = same[:-1] | same[1:]
            hit[-1] = False
            yield _plain(whole.filter(pa.array(hit)), span)
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        block = pa.Table.from_batches(held)
        keys = np.asarray(block.column("key"))
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield _repeats(block.slice(0, end), span)
        held = block.slice(end).combine_chunks().to_batches()
        size = sum(x.nbytes for x in held)
        limit = max(BLOCK, 2 * size)  # a group of HEAVY suffixes at most
    if held:
        yield _repeats(pa.Table.from_batches(held), span)
    if paired:
        yield _plain(last, span)


def heavy_buckets(docs: DataFrame, span: int) -> np.ndarray:
    """Buckets with more than HEAVY windows: no more of them than the corpus has windows, divided by HEAVY."""

    def sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, "text", SLICE):
                found = _sizes(part, span)
                if found is not None:
                    yield found

    found = docs.select("text").mapInArrow(sizes, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY).select("bucket").toArrow()
    return np.asarray(found.column("bucket").combine_chunks())


def suffix_rows(docs: DataFrame, span: int) -> DataFrame:
    """key, doc_id, mark, first, n, kind: the places that are dealt out by prefix."""
    heavy = heavy_buckets(docs, span)

    def suffixes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, "text", SLICE):
                found = _suffixes(part, span, heavy)
                if found is not None:
                    yield found

    return docs.select("doc_id", "mark", "text").mapInArrow(suffixes, _PLACES)


def repeated_spans(docs: DataFrame, span: int = 35) -> DataFrame:
    """doc_id, mark, begin, end: runs of words covered by repeated windows, not merged; docs has doc_id, mark and text."""
    shared = suffix_rows(docs, span).repartition("key").sortWithinPartitions("key").mapInArrow(_shared, _PLACES)
    own = F.struct("doc_id", "mark").alias("own")  # one key to group and join by, so that neither side is dealt out twice
    places = shared.groupBy(own).agg(F.collect_set(F.struct("key", "first", "n", "kind")).alias("places"))
    small = docs.select("doc_id", "mark", "text").mapInArrow(_squeezed, "doc_id long, mark long, text binary")
    texts = small.groupBy(own).agg(F.first("text").alias("z"), F.count(F.lit(1)).alias("times"))
    both = texts.join(places, "own").select("own.doc_id", "own.mark", "z", "times", "places")
    rows = both.mapInArrow(lambda x: _with_words(x, span), f"{_PLACES}, words binary")
    return rows.repartition("key").sortWithinPartitions("key", "words").mapInArrow(lambda x: _found(x, span), "doc_id long, mark long, begin long, end long")


def _squeezed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column as zstd frames."""
    pack = zstandard.ZstdCompressor(9).compress
    for batch in rows:
        for part in slices(batch, "text", 1 << 20):
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array([None if x is None else pack(x.encode()) for x in part.column(at).to_pylist()], pa.binary()))


def remove_repeats(docs: DataFrame, span: int = 35) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words that no repeated window covers, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A window of `span` words is repeated if the same words
    start anywhere else, in the same text too; windows may overlap. All of docs' columns
    stay; one of these three names is replaced. Null and empty texts have no words, and texts of
    fewer than `span` words lose none. Rows that come twice repeat each other, null doc_id
    or not. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.struct(F.lit(1).alias("one"), *others).alias("rest"))
    key = F.struct("doc_id", "mark").alias("own")
    spans = repeated_spans(own, span).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    schema = own.schema
    kind = schema["rest"].dataType.simpleString()
    small = own.mapInArrow(_squeezed, f"doc_id long, text binary, mark long, rest {kind}")
    joined = small.select("text", "rest", key).join(spans, "own", "left").select("own.doc_id", "text", "rest", "spans")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in rows:
            for part in slices(batch, "text", 1 << 20):
                texts, n_words, n_removed, kept = [], [], [], []
                for z, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    raw = unpack(z) if z is not None else b""
                    found = raw.split()
                    left, at = [], 0
                    for x in spans or ():
                        if x["begin"] > at:
                            left += found[at : x["begin"]]
                        at = max(at, x["end"])
                    left += found[at:]
                    texts.append(None if z is None else raw.decode())
                    n_words.append(len(found))
                    n_removed.append(len(found) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("rest"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text", "rest", "n_words", "n_removed", "kept_text"])

    done = joined.mapInArrow(cut, f"doc_id long, text string, rest {kind}, n_words long, n_removed long, kept_text string")
    new = ("n_words", "n_removed", "kept_text")
    nth = {c: i for i, c in enumerate(docs.columns)}
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{nth[c]}").alias(c) for c in docs.columns if c not in new), *new)
