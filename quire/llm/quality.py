"""Quality rules, in DataFrame operations only: counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs of a text fall into buckets by hash. Two multinomials over buckets,
one of trusted texts and one of the whole corpus, give each bucket a log ratio; a text's
verdict is the mean of its buckets' ratios, held against a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets, a power of two; trusted rows at most, those of least hash of doc_id; the least mean ratio of a kept text.
BUCKETS, TRUSTED_ROWS, THRESHOLD = 1 << 14, 10_000, -0.06

WORDS = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def _buckets(words: str) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    n = F.size(words)
    place = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    single = F.transform(words, lambda w: place(F.xxhash64(w)))
    double = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: place(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.lit(2))))).otherwise(F.array().cast("array<int>"))
    return F.concat(single, double)


def log_ratios(docs: DataFrame, trusted: DataFrame, rows: int = TRUSTED_ROWS) -> list[float]:
    """Log of trusted share over corpus share of each bucket, with one added to every count.

    Corpus counts are over all rows of docs; the trusted ones over at most `rows` doc_ids
    of trusted (doc_id), a bounded list that is broadcast. Buckets, not words, go to the driver.
    """
    chosen = trusted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("of_doc"), F.lit(True).alias("is_trusted"))
    own = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of_doc"), "left")
    found = own.select("is_trusted", "words").select("is_trusted", F.explode(_buckets("words")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("is_trusted").alias("n_trusted")).collect()
    whole, part = [1] * BUCKETS, [1] * BUCKETS
    for r in found:
        whole[r.bucket] += r.n
        part[r.bucket] += r.n_trusted
    if sum(part) == BUCKETS:  # nothing is trusted: no verdict
        return [0.0] * BUCKETS
    a, b = math.log(sum(part)), math.log(sum(whole))
    return [math.log(x) - a - math.log(y) + b for x, y in zip(part, whole)]


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Columns of these names are replaced. llr is the mean log ratio of the text's buckets, 0
    without words; kept is false if base_failed, else llr >= threshold. Null and empty texts
    have counts of 0 and fail. Each row is judged by itself, repeated ones alike. No shuffle.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    rest = F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in new])
    weights = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    own = docs.select(rest.alias("rest"), text.alias("whole"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("whole", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    own = own.select(
        "rest", "words", n.cast("long").alias("n_words"), (F.length(F.regexp_replace("whole", r"[\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        F.regexp_count("whole", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), windows.alias("windows"), _buckets("words").alias("buckets"),
    )
    empty = F.array().cast("array<struct<h:bigint,at:int>>")
    ordered = F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).otherwise(empty)
    own = own.select("rest", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), ordered.alias("ordered"), F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(weights, b)).alias("total"), F.size("buckets").alias("n_buckets"))
    hash_at = lambda i: F.get("ordered", i)["h"]
    again = F.filter("ordered", lambda x, i: F.coalesce(hash_at(i - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)))
    own = own.withColumn("places", F.sort_array(F.transform(again, lambda x: x["at"]))).drop("ordered")
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    own = own.withColumn("n_repeat_words", covered).withColumn("llr", F.when(F.col("n_buckets") > 0, F.col("total") / F.col("n_buckets")).otherwise(0.0))
    own = own.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return own.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new), *new)
