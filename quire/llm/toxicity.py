"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is a logistic function of its distinct hashed words and word stems, a document's the
noisy-or of its sentences' scores: it is toxic unless none of them is. The weights are
fitted to document labels by gradient descent through the noisy-or, so that they come to
point at the sentences that make a document toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim
from .kernels import ALNUM, LOWER, U, arrow_bytes, letters, slices, span_hashes, words

#: Buckets that words and their stems are hashed into, a power of two; stems are first bytes of longer words, so many.
FEATURES, STEMS = 1 << 20, (4, 5, 6, 7, 8)
#: Labelled rows that the weights are fitted to, at most: those of least hash of doc_id.
TRAIN_ROWS = 10_000
#: Training documents that a bucket must occur in to have a weight.
LEAST_DOCS = 8
EPOCHS, RATE, BIAS_RATE, BIAS = 100, 10.0, 0.5, -6.0
#: Buckets of sentences, and bytes of text, that are handled at once, about.
PAIRS, FEATURE_BYTES = 1 << 18, 1 << 18
#: Weight of the penalty on the sum of weights, over the root of the number of documents.
L1 = 0.011
#: Sentences end at these bytes, and at the end of the text.
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True


def sentences(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column: each distinct word's sentence and bucket, each sentence's document, byte range in the document's UTF-8, and number in it. Only sentences with a word count."""
    data, off = arrow_bytes(column)
    s, e, _ = words(LOWER[data], off, ALNUM)
    if not len(s):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none
    values = letters(LOWER[data])
    sizes = e - s
    stems = [np.arange(len(s)), *(np.flatnonzero(sizes > n) for n in STEMS)]
    of_word = np.concatenate(stems)
    end = np.concatenate([e, *(s[x] + n for x, n in zip(stems[1:], STEMS))])
    bucket = (span_hashes(values, s[of_word], end) & U(FEATURES - 1)).astype(np.int64)
    ends = ENDS[data].astype(np.int64)
    ends[off[1:][off[1:] > 0] - 1] = 1
    before = np.concatenate(([0], np.cumsum(ends)))  # sentence ends before each byte
    raw = before[s]
    own, sentence = np.unique(raw, return_inverse=True)
    close = np.flatnonzero(ends) + 1
    begin = np.concatenate(([0], close))[own]
    doc = np.searchsorted(off, s[np.searchsorted(raw, own)], "right") - 1
    begin = np.maximum(begin, off[doc])
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    pairs = np.unique(sentence[of_word] * FEATURES + bucket)
    return pairs // FEATURES, pairs % FEATURES, doc, begin - off[doc], close[own] - off[doc], np.arange(len(own)) - first[doc]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def noisy_or(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(scores, 1 - 1e-12)), n))


def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the number of distinct buckets of each sentence, and the buckets, sentence by sentence."""
    for batch in rows:
        for part in slices(batch, "text", FEATURE_BYTES):
            sentence, bucket, doc, *_ = sentences(part.column("text"))
            place = np.arange(part.num_rows + 1)
            sizes = np.bincount(sentence, minlength=len(doc))
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of, place).astype(np.int32)), pa.array(x.astype(np.int32))) for of, x in ((doc, sizes), (doc[sentence], bucket))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "sizes", "bucket"])


class Part:
    """Some rows of features: each sentence's number of buckets, the buckets, each sentence's row, each row's label."""

    def __init__(self, rows: pa.RecordBatch):
        self.sizes, self.bucket = (rows.column(c).flatten().to_numpy().copy() for c in ("sizes", "bucket"))
        self.doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(rows.column("sizes")).to_numpy())
        self.toxic = rows.column("toxic").to_numpy().copy()

    def sentence(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def rows_with(self) -> np.ndarray:
        """In how many rows each bucket is."""
        own = np.unique(self.doc[self.sentence()].astype(np.int64) * FEATURES + self.bucket)
        return np.bincount(own % FEATURES, minlength=FEATURES).astype(np.int32)

    def keep(self, place: np.ndarray) -> None:
        """Buckets become places; those without one go."""
        bucket = place[self.bucket]
        self.sizes = np.bincount(self.sentence()[bucket >= 0], minlength=len(self.sizes)).astype(np.int32)
        self.bucket = bucket[bucket >= 0]

    def slope(self, weights: np.ndarray, bias: float, n: int) -> tuple[np.ndarray, float]:
        """How the mean loss of n rows grows with each weight and with the bias, as far as these rows go."""
        sentence = self.sentence()
        score = _sigmoid(np.bincount(sentence, weights[self.bucket], len(self.sizes)) + bias)
        p = np.clip(noisy_or(score, self.doc, len(self.toxic)), 1e-6, 1 - 1e-6)
        # the loss falls by score for label 0, by -score * (1 - p) / p for label 1, for each sentence's logit
        each = np.where(self.toxic[self.doc] == 1, -score * (1 - p[self.doc]) / p[self.doc], score) / n
        return np.bincount(self.bucket, each[sentence], len(weights)), float(each.sum())


def fit(rows: Iterator[pa.RecordBatch], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the buckets, none negative, and the bias from rows of `features`: accelerated proximal descent on the documents' mean log loss with an L1 penalty; deterministic for rows in a fixed order. Memory: 4 bytes for each distinct bucket of a sentence."""
    parts, seen = [], np.zeros(FEATURES, np.int32)
    for batch in rows:
        pairs = np.cumsum(pc.list_value_length(batch.column("bucket")).to_numpy().astype(np.int64)) // PAIRS
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        for at, to in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
            parts.append(Part(batch.slice(at, to - at)))
            seen += parts[-1].rows_with()
    n = sum(len(x.toxic) for x in parts)
    weights, used = np.zeros(FEATURES), np.flatnonzero(seen >= LEAST_DOCS)
    if not len(used):
        return weights, BIAS
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))
    for part in parts:
        part.keep(place)
    own, bias, near, near_bias, pace = np.zeros(len(used)), BIAS, np.zeros(len(used)), BIAS, 1.0
    penalty = L1 / n**0.5
    for _ in range(epochs):
        slope, slope_bias = np.zeros(len(used)), 0.0
        for part in parts:
            of_weights, of_bias = part.slope(near, near_bias, n)
            slope += of_weights
            slope_bias += of_bias
        new = np.maximum(near - RATE * (slope + penalty), 0)
        new_bias = near_bias - BIAS_RATE * slope_bias
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        near, near_bias = new + (pace - 1) / faster * (new - own), new_bias + (pace - 1) / faster * (new_bias - bias)
        own, bias, pace = new, new_bias, faster
    weights[used] = own
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights from docs (doc_id, text) with labels (doc_id, toxic); `rows` texts at most.

    Features are made by all tasks; one task on an executor fits, and the driver gets the
    weights that are not zero. Labels without a doc_id or other than 0 and 1 do not count; of
    several labels of a doc_id the largest does, of several texts the least. Null texts have
    no sentence. Without any label the weights are zero.
    """
    small_batches(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("of_doc"), "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of_doc")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    made = found.select("doc_id", "toxic", "text").mapInArrow(features, "doc_id long, toxic int, sizes array<int>, bucket array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = fit(batches, epochs)
        trim()
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(weights[at], bias))], ["bucket", "weight"])

    table = made.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "bucket long, weight double").toArrow()
    at, weight = (table.column(c).to_numpy() for c in ("bucket", "weight"))
    weights = np.zeros(FEATURES)
    weights[at[at >= 0]] = weight[at >= 0]
    return weights, float(weight[at < 0][0]) if len(at) else BIAS


def _scored(part: pa.RecordBatch, table: np.ndarray, bias: float) -> tuple[np.ndarray, list, list, list]:
    """Scores of the texts, and number, score and text of each one's worst sentence, or None."""
    n = part.num_rows
    sentence, bucket, doc, begin, end, number = sentences(part.column("text"))
    if not len(doc):
        return np.zeros(n), [None] * n, [None] * n, [None] * n
    score = _sigmoid(np.bincount(sentence, table[bucket], len(doc)) + bias)
    total = np.clip(noisy_or(score, doc, n), 0.0, 1.0)
    order = np.lexsort((number, -score, doc))
    best = np.full(n, -1)
    present = np.unique(doc)
    best[present] = order[np.searchsorted(doc[order], present)]
    texts = [None if b < 0 else x.encode()[begin[b] : end[b]].decode(errors="replace").strip() for b, x in zip(best.tolist(), part.column("text").to_pylist())]
    return total, [None if b < 0 else int(number[b]) for b in best.tolist()], [None if b < 0 else float(score[b]) for b in best.tolist()], texts


def _model(docs: DataFrame, weights: np.ndarray, bias: float):
    small_batches(docs.sparkSession)
    used = np.flatnonzero(weights)
    return docs.sparkSession.sparkContext.broadcast((used, weights[used], bias))


def _table(sent) -> tuple[np.ndarray, float]:
    at, own, bias = sent.value
    table = np.zeros(FEATURES)
    table[at] = own
    return table, bias


def score_toxicity(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, mark, score, predicted, sentence, sentence_score, sentence_text of every row of docs (doc_id, text, ...).

    score: the noisy-or; predicted: 1 from 0.5 on; sentence: the number, from 0, of the
    text's sentence of highest score, the first of these, with its score and text; only
    sentences with a word count. Null and empty texts, and texts without a word, have
    score 0 and no sentence. Repeated rows and rows with a null doc_id each give a row.
    mark: xxhash64 of the text. Other columns are left out. No shuffle; what is broadcast
    has a fixed size at most, that of the weights.
    """
    sent = _model(docs, weights, bias)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = _table(sent)
        for batch in rows:
            for part in slices(batch, "text", FEATURE_BYTES):
                total, number, top, texts = _scored(part, table, base)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array(number, pa.int32()), pa.array(top, pa.float64()), pa.array(texts, pa.string())], ["doc_id", "mark", "score", "predicted", "sentence", "sentence_score", "sentence_text"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, score double, predicted int, sentence int, sentence_score double, sentence_text string")


def drop_toxic(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold.

    Null and empty texts, and texts without a word, have score 0 and stay. Repeated rows are
    judged alike. Columns may have any names beside doc_id and text; an empty table gives an empty one.
    """
    sent = _model(docs, weights, bias)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = _table(sent)
        for batch in rows:
            for part in slices(batch, "text", FEATURE_BYTES):
                total, *_ = _scored(part, table, base)
                yield part.filter(pa.array(total < threshold))

    return docs.mapInArrow(run, docs.schema)
