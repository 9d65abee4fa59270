"""Size-aware heavy-light join of shingle sets by Jaccard similarity, exact.

Texts of equal sets are one vertex. Two sets whose similarity is at least t share
ceil(t * larger size) elements. Light sets, up to a boundary size, list all their subsets
of just so many elements; two light sets that link share one. Heavy sets are in the
inverted lists of their first n - ceil(t * n) + 1 elements, under an order that puts
elements common in the corpus last; two that link share a list, and light sets near the
boundary are in lists too. The boundary is the size at which the rows of subsets begin
to cost more than the list entries that they would save, both counted.

A list of up to FEW sets gives all its pairs that sizes and places in the order allow.
Of a longer list, ordered by size, each set is paired with the smallest one that is near
enough in size, its pivot, and with its next neighbours. Thin sketches rule pairs out, the
texts of the others are compared, and what links is merged. Only where a longer list's
sets end in different components are they compared with each other, in cells of blocks,
by wide sketches in arrays; a cell gives a spanning forest of the components that may
link, nearest pairs first. These are verified and merged, and then every pair that sketches
still leave between two components is verified. So every link between components is
found, and links inside one need not be listed.

A sketch has the parities of the elements that hash to each of its bits: two sketches
differ in no more bits than their sets do in elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .components import components
from .kernels import U, arrow_bytes, mix, shingle_sets, slices, span_hashes
from .substrings import _squeezed

#: Common elements that the order puts last, at most; those of a slice that count for this, and rows of a task from which on one is common.
COMMON, COMMON_OF_SLICE, COMMON_ROWS = 65_536, 2_000, 4
#: Counters, by hash, that a task has to find them.
COUNTERS = 1 << 24
#: Sets up to this size can be light.
LIGHT = 24
#: Sets of a list whose pairs are all listed; following sets that each one of a longer list is paired with; sets of a block.
FEW, NEIGHBOURS, BLOCK = 8, 2, 2_048
#: Rows of three longs that are broadcast; more are dealt out.
BROADCAST = 500_000
#: Words of sketches that are compared at once.
AT_ONCE = 1 << 18
#: Members that one copy of a pivot's text is compared with.
SALT = 256


def _need(n, percent: int, of: int = 100):
    """n * percent / of, rounded up."""
    return -(-percent * n // of)


def common_elements(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles in many rows; a heuristic for the order only, results do not depend on it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint16)
        for batch in rows:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), k))
                found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, U), np.empty(0, np.int64))
                at = (found & U(COUNTERS - 1)).astype(np.int64)
                so_far = np.minimum(seen[at] + n, 60_000)
                seen[at] = so_far
                often = so_far >= COMMON_ROWS
                found, n, so_far = found[often], n[often], so_far[often]
                top = np.argsort(-so_far, kind="stable")[:COMMON_OF_SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(found[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["element", "n"])

    found = docs.select("text").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "element").limit(COMMON).select("element").toArrow()
    return np.sort(np.asarray(found.column("element").combine_chunks()).view(U))


def parity(found: np.ndarray) -> np.ndarray:
    """Bits, 64 or a larger power of two up to four times the set's size, each the parity of the elements that hash to it."""
    size = 64
    while size * 2 <= 4 * len(found):
        size *= 2
    odd = np.bincount(((found >> U(20)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """A sketch of half as many bits, or rows of them."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def thin(sketch: np.ndarray, n: int) -> np.ndarray:
    """The sketch with a bit for each element at most, or with 64: enough to tell unlike sets apart."""
    while len(sketch) > 1 and len(sketch) * 64 > n:
        sketch = folded(sketch)
    return sketch


def may_link(a: str, b: str, percent: int) -> F.Column:
    """Whether the sketches of two sets, columns a.n, a.sketch and so on, let them link; half a larger sketch is folded onto the other half."""
    n, sa, sb = F.col(f"{a}.n") + F.col(f"{b}.n"), F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    words = F.least(F.size(sa), F.size(sb))
    fold = lambda s: F.when(F.size(s) > words, F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(s)
    differ = F.aggregate(F.zip_with(fold(sa), fold(sb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return differ <= n - 2 * F.ceil(n * percent / (100 + percent))


def _longs(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def shingle_rows(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, mark, n, h, sketch, thin and front: the set's size, its digest, its parities, and what the join needs of it, in the order (all of a set of up to LIGHT elements)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, "text"):
                n, h, front, wide, narrow = [], [], [], [], []
                for found in shingle_sets(part.column("text"), k):
                    size = len(found)
                    n.append(size)
                    h.append(int(span_hashes(found, np.array([0]), np.array([size])).view(np.int64)[0]) if size else 0)
                    wide.append(parity(found))
                    narrow.append(thin(wide[-1], size))
                    if len(common) and size:
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        late = common[at] == found
                        found = np.concatenate([found[~late], found[late]])
                    front.append(found[: size if size <= LIGHT else size - _need(size, percent) + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n, pa.int64()), pa.array(h, pa.int64()), _longs(wide), _longs(narrow), _longs(front)], ["doc_id", "mark", "n", "h", "sketch", "thin", "front"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, h long, sketch array<long>, thin array<long>, front array<long>")


def _subset_sizes(n: int, largest: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n elements lists to meet light sets of n elements or more, and smaller ones that meet it."""
    return sorted({_need(b, percent) for b in range(n, largest + 1) if _need(b, percent) <= n})


def boundary(nodes: DataFrame, percent: int) -> int:
    """The largest light size, by cost: subset rows against list entries and the comparisons that they cause."""
    small = nodes.where(F.col("n") <= LIGHT)
    entry = small.select("n", F.explode(F.expr(f"slice(front, 1, cast(n + floor(-{percent} * n / 100) + 1 as int))")).alias("element"))
    lists = entry.groupBy("element").agg(F.count(F.lit(1)).alias("long"))
    in_lists = {r.n: r.cost for r in entry.join(lists, "element").groupBy("n").agg(F.sum(F.least("long", F.lit(SALT)) + 1).alias("cost")).collect()}
    sets = {r.n: r.sets for r in small.groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}

    def cost(largest: int) -> int:
        light = sum(sets[n] * sum(2 * comb(n, c) for c in _subset_sizes(n, largest, percent)) for n in sets if n <= largest)
        return light + sum(in_lists.get(n, 0) for n in sets if n >= _need(largest + 1, percent))

    return min(range(LIGHT + 1), key=cost)


def signatures(nodes: DataFrame, light: int, percent: int) -> DataFrame:
    """key, v, n, rank: list entries of heavy sets and of light ones near them in size, and the subsets of light sets."""

    def subsets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for v, n, front in zip(batch.column("v").to_pylist(), batch.column("n").to_pylist(), batch.column("front").to_pylist()):
                own = sorted(front)
                for c in _subset_sizes(n, light, percent):
                    flat = np.array([x for s in combinations(own, c) for x in s], np.int64).view(U)
                    at = np.arange(0, len(flat), c)
                    keys = mix(span_hashes(flat, at, at + c)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), v)), pa.array(np.full(len(keys), n)), pa.array(np.zeros(len(keys), np.int64))], ["key", "v", "n", "rank"])

    heavy = nodes.where(F.col("n") >= _need(light + 1, percent)).select(F.posexplode(F.expr(f"slice(front, 1, cast(n + floor(-{percent} * n / 100) + 1 as int))")).alias("rank", "key"), "v", "n").select("key", "v", "n", F.col("rank").cast("long").alias("rank"))
    return heavy.union(nodes.where(F.col("n") <= light).select("v", "n", "front").mapInArrow(subsets, "key long, v long, n long, rank long"))


def _may(n_a, n_b, rank_a, rank_b, percent: int):
    """Whether sets of sizes n_a <= n_b whose common element has these ranks can link by it: linked sets share a list of their first n - overlap + 1 elements."""
    overlap = _need(n_a + n_b, percent, 100 + percent)
    return (n_a * 100 >= n_b * percent) & (rank_a <= n_a - overlap) & (rank_b <= n_b - overlap)


_LISTED = ["key", "a", "b", "n", "rank"]


def _listed(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], _LISTED)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return _listed(none, a, b, none, none)


def _of_few(key: np.ndarray, n: np.ndarray, rank: np.ndarray, v: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs of whole lists of up to FEW sets."""
    for apart in range(1, FEW):
        x = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(x):
            return
        x = x[_may(n[x], n[x + apart], rank[x], rank[x + apart], percent)]
        if len(x):
            yield _pairs(v[x], v[x + apart])


def _has_partner(n: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a whole list, ordered by size, have one near enough in size to link by an element of this rank."""
    low, high = _need(n, percent), n * 100 // percent
    most = (n - rank) * (100 + percent) // percent - n  # a partner's size, so that the overlap is n - rank at most
    others = np.searchsorted(n, np.minimum(high, most), "right") - np.searchsorted(n, low)
    return others - (most >= n) > 0


def _of_many(n: np.ndarray, rank: np.ndarray, v: np.ndarray, pivot: list | None, percent: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Pairs with pivots and next neighbours of (a part of) one list, and the pivot at its end."""
    at, a, b = 0, [], []
    while at < len(n):
        if pivot is None or pivot[0] * 100 < n[at] * percent:
            pivot = [int(n[at]), int(v[at])]
            at += 1
        to = int(np.searchsorted(n, pivot[0] * 100 // percent, "right"))
        if to > at:
            a.append(np.full(to - at, pivot[1]))
            b.append(v[at:to])
            at = to
    for apart in range(1, NEIGHBOURS + 1):
        x = np.flatnonzero(_may(n[:-apart], n[apart:], rank[:-apart], rank[apart:], percent))
        a.append(v[x])
        b.append(v[x + apart])
    return np.concatenate(a), np.concatenate(b), pivot


def _lists(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows ordered by key, size, v: pairs a, b to be compared (key null), and the sets b of lists of more than FEW, with key, n and rank. Held are a list's rows of one batch at most."""
    held = [np.empty(0, np.int64)] * 4
    open_key, pivot = None, None  # of a long list that goes on

    def done(columns: list[np.ndarray], goes_on: bool) -> Iterator[pa.RecordBatch]:
        nonlocal open_key, pivot
        key, n, rank, v = columns
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        many = size > FEW
        many[0] |= key[0] == open_key
        few = np.repeat(~many & (size > 1), size)
        yield from _of_few(key[few], n[few], rank[few], v[few], percent)
        for i in np.flatnonzero(many).tolist():
            at = slice(first[i], first[i] + size[i])
            whole = key[first[i]] != open_key and not (goes_on and i == len(size) - 1)
            kept = np.flatnonzero(_has_partner(n[at], rank[at], percent) if whole else np.ones(size[i], bool)) + first[i]
            if len(kept):
                yield _listed(key[kept], pa.nulls(len(kept), pa.int64()), v[kept], n[kept], rank[kept])
            if key[first[i]] != open_key:
                pivot = None
            a, b, pivot = _of_many(n[at], rank[at], v[at], pivot, percent)
            open_key = key[first[i]]
            if len(a):
                yield _pairs(a, b)
        if not goes_on:
            open_key = None

    for batch in rows:
        now = [np.concatenate([x, np.asarray(batch.column(c))]) for x, c in zip(held, ("key", "n", "rank", "v"))]
        twice = np.concatenate(([False], (now[0][1:] == now[0][:-1]) & (now[3][1:] == now[3][:-1])))
        now = [x[~twice] for x in now]
        key = now[0]
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if len(key) - last > FEW or len(key) and key[-1] == open_key:  # the long list at the end goes on
            last = len(key)
        yield from done([x[:last] for x in now], last == len(key))
        held = [x[last:] for x in now]
    yield from done(held, False)


def _near_pairs(n, rank, root, block, sketches: list[np.ndarray], percent: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x, y of a cell in different components that sketches let link, and the bits in which these differ; without `within` only of different blocks. Rows are ordered by size."""
    names, count = np.unique(root, return_counts=True)
    main = names[np.argmax(count)]
    width = np.array([len(x) for x in sketches])
    place = np.arange(len(n))
    out = [(np.empty(0, np.int64),) * 3]
    for w in np.unique(width).tolist():
        own = np.flatnonzero((width == w) & (root != main))  # pairs inside the largest component are of no use
        if not len(own):
            continue
        mine = np.stack([sketches[i] for i in own])
        for other in (w // 2, w, 2 * w):
            to = np.flatnonzero(width == other)
            if not other or not len(to):
                continue
            theirs = np.stack([sketches[i] for i in to])
            left, right = (folded(mine) if other < w else mine), (folded(theirs) if other > w else theirs)
            step = max(1, AT_ONCE // right.size)
            for at in range(0, len(own), step):
                x, y = own[at : at + step, None], to[None, :]
                low, high = np.minimum(x, y), np.maximum(x, y)
                may = (root[x] != root[y]) & ((root[y] == main) | (place[x] < place[y])) & _may(n[low], n[high], rank[low], rank[high], percent)
                if not within:
                    may &= block[x] != block[y]
                i, j = np.nonzero(may)
                for part in range(0, len(i), max(1, AT_ONCE // left.shape[1])):
                    p, q = i[part : part + max(1, AT_ONCE // left.shape[1])], j[part : part + max(1, AT_ONCE // left.shape[1])]
                    differ = np.bitwise_count(left[at + p] ^ right[q]).sum(1, dtype=np.int64)
                    a, b = low[p, q], high[p, q]
                    total = n[a] + n[b]
                    near = differ <= total - 2 * _need(total, percent, 100 + percent)
                    out.append((a[near], b[near], differ[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _forest(x: np.ndarray, y: np.ndarray, differ: np.ndarray, root: np.ndarray) -> list[int]:
    """Which of the pairs join components, nearest first, as if all of them link."""
    names, place = np.unique(root, return_inverse=True)
    up, chosen, left = list(range(len(names))), [], len(names) - 1

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = np.lexsort((y, x, differ))
    for i, a, b in zip(order.tolist(), place[x[order]].tolist(), place[y[order]].tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            chosen.append(i)
            left -= 1
            if not left:
                break
    return chosen


def _cells(rows: Iterator[pa.RecordBatch], percent: int, want: str) -> Iterator[pa.RecordBatch]:
    """a, b that may link, from rows ordered by key, i and j: the cells of blocks i and j. One cell is held."""

    def cell(table: pa.Table) -> Iterator[pa.RecordBatch]:
        v, n = np.asarray(table.column("v")), np.asarray(table.column("n"))
        order = np.lexsort((v, n))
        table = table.take(pa.array(order)).combine_chunks()
        v, n, rank, root, block = (np.asarray(table.column(c)) for c in ("v", "n", "rank", "root", "block"))
        lists = table.column("sketch").chunk(0)
        off, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(U)
        sketches = [flat[off[i] : off[i + 1]] for i in range(len(v))]
        x, y, differ = _near_pairs(n, rank, root, block, sketches, percent, table.column("i")[0].as_py() == table.column("j")[0].as_py())
        if want == "sets":
            x = y = np.unique(np.concatenate([x, y]))
        elif want == "forest" and len(x):
            chosen = _forest(x, y, differ, root)
            x, y = x[chosen], y[chosen]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(v[x]), pa.array(v[y])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    of = None
    for batch in rows:
        if not batch.num_rows:
            continue
        key, i, j = (np.asarray(batch.column(c)) for c in ("key", "i", "j"))
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))).tolist()
        for s, e in zip(at, [*at[1:], len(key)]):
            if held and of != (key[s], i[s], j[s]):
                yield from cell(pa.Table.from_batches(held))
                held = []
            of = (key[s], i[s], j[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield from cell(pa.Table.from_batches(held))


def between(dense: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int, want: str) -> DataFrame:
    """a, b: sets of different components that share a long list and that sketches let link. want: "pairs", all; "forest", as many as join what may link; "sets", each set of a pair, as a and b. dense: key, v, n, rank; roots: v, root; sketches: v, sketch.

    A list of several blocks is compared in cells, pairs of blocks; lists of one component are left out.
    """
    member = dense.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    mixed = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("low != high").select("key", "blocks")
    member = member.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("v"), "blocks")).join(sketches, "v")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cells = member.select("key", "block", "v", "n", "rank", "root", "sketch", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v", "n", "rank", "root", "sketch")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda rows: _cells(rows, percent, want), "a long, b long").distinct()


def _compared(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sizes of intersections of each a's set with those of its rows, from rows ordered by a, salt and b, a's own row (b null) first."""
    unpack = zstandard.ZstdDecompressor().decompress
    own, of = np.empty(0, U), None
    for batch in rows:
        for part in slices(batch, "z", 1 << 19):
            texts = pa.array([unpack(x).decode() for x in part.column("z").to_pylist()], pa.string())
            out = []
            for a, b, found in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(texts, k)):
                if b is None:
                    own, of = found, a
                elif of == a:
                    at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    both = int((own[at] == found).sum())
                    out.append((a, b, both, len(own) + len(found) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "both", "any"])


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b, both, any: sizes of intersection and union. texts: v and z. A frequent a is compared in several tasks."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    members = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")).join(texts.withColumnRenamed("v", "b"), "b").select("a", "salt", "b", "z")
    heads = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("v", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "z")
    return members.union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(lambda rows: _compared(rows, k), "a long, b long, both long, any long")


def _tried(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """a, b, both, any of pairs (a, b), by the texts of their sets' least rows. What is wanted is written first, so that a small part of the corpus is joined without dealing out the rest."""
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    wanted = written(nodes.select("v", "least.doc_id", "least.mark").join(ends, "v", "left_semi"), "wanted")
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    join = lambda left, right: left.alias("t").join(right.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.mark") == F.col("w.mark")))
    if wanted.count() <= BROADCAST:
        both = join(own, F.broadcast(wanted)).select("v", "text").mapInArrow(_squeezed, "v long, text binary")
    else:
        both = join(own.mapInArrow(_squeezed, "doc_id long, mark long, text binary"), wanted)
    texts = written(both.groupBy("v").agg(F.min("text").alias("z")), "texts")
    out = written(verified(pairs, texts, k), "verified")
    discard(wanted, texts)
    return out


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, stays of every row of docs (doc_id, text, ...); mark is xxhash64(text).

    A row's set: distinct k-word shingles, A-Z lowered; with fewer words, the whole
    sequence as one. Rows with 100 * |intersection| >= percent * |union| link; component_id
    is the least doc_id that a row reaches by links, itself included. Null and empty texts
    and texts without a word have the empty set and link with nothing: their component_id
    is their doc_id. Repeated rows have equal sets and link. Rows that share a doc_id but
    have other sets do not link by that. Where all rows of a component have a null doc_id,
    component_id is null. stays: whether the row has the least (doc_id, mark) of its
    component, null doc_ids last; rows of the empty set all stay. Other columns are left
    out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    sets = written(shingle_rows(own, k, percent, common_elements(own, k)), "sets")
    nodes = sets.where("n > 0").groupBy("h", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least"), F.min("doc_id").alias("doc"), F.first("front").alias("front"), F.first("thin").alias("thin"))
    nodes = written(nodes.select("h", "n", F.col("h").alias("v"), "least", "doc", "front", "thin"), "nodes")
    rows = signatures(nodes, boundary(nodes, percent), percent).repartition("key").sortWithinPartitions("key", "n", "v")
    lists = written(rows.mapInArrow(lambda x: _lists(x, percent), "key long, a long, b long, n long, rank long"), "lists")
    dense = lists.where("key is not null").select("key", F.col("b").alias("v"), "n", "rank")

    thin_of = lambda c, name: nodes.select(F.col("v").alias(c), F.struct("n", F.col("thin").alias("sketch")).alias(name))
    pairs = lists.where("key is null").select("a", "b").distinct().join(thin_of("a", "x"), "a").join(thin_of("b", "y"), "b")
    pairs = written(pairs.where(may_link("x", "y", percent)).select("a", "b"), "pairs")
    linked = lambda p: p.where(F.col("both") * 100 >= F.col("any") * percent).select(F.col("a").alias("v"), F.col("b").alias("u"))
    tried = [_tried(own, nodes, pairs, k)]
    roots = components(linked(tried[0]))
    if not dense.isEmpty():
        # thin sketches say which sets are left at all, wide ones which pairs
        some = written(between(dense, roots, nodes.select("v", F.col("thin").alias("sketch")), percent, "sets").select(F.col("a").alias("v")), "some")
        dense = dense.join(some, "v", "left_semi")
        sketches = written(sets.select(F.col("h").alias("v"), "sketch").join(some, "v", "left_semi").dropDuplicates(["v"]), "sketches")
        for want in ("forest", "pairs"):
            rest = between(dense, roots, sketches, percent, want)
            for before in tried:
                rest = rest.join(before, ["a", "b"], "left_anti")
            rest = written(rest, "rest")
            if rest.isEmpty():
                break
            tried.append(_tried(own, nodes, rest, k))
            roots = components(reduce(DataFrame.union, map(linked, tried)))
        discard(some, sketches)
    discard(lists, pairs, *tried)
    return _named(sets, nodes, roots)


def _named(sets: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with their component's least doc_id, and whether they stay."""
    named = nodes.join(roots, "v", "left").select("h", "n", "doc", "least", F.coalesce("root", "v").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component"), F.min("least").alias("first"))
    named = named.join(least, "root").select("h", "n", "component", "first")
    done = sets.select("doc_id", "mark", "n", "h").join(named, ["h", "n"], "left")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    return done.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), ((F.col("n") == 0) | first).alias("stays"))
