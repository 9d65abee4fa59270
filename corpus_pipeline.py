"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

documents -> without toxic ones -> one of each group of near duplicates -> without
passages that repeat -> sources mixed to their targets -> packed sequences. Every stage
works on all rows that the one before kept; what it decides, the next one sees. No row is
dropped but by a stage's decision: documents that lose all their words stay, empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, mixing, packing, substrings, toxicity
from quire.llm.common import written
from quire.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels that are not held out, does not find toxic.

    Null and empty texts stay, repeated rows are judged alike, and an empty table gives an
    empty one. All columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    weights, bias = toxicity.train(docs, labels)
    return toxicity.drop_toxic(docs, weights, bias)


def _packed(docs: DataFrame) -> DataFrame:
    """row, all columns in one; key, of doc_id and text; whole, of all columns but maps. Nothing that an input column could clash with."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("mark")).alias("key"), F.xxhash64(*hashed).alias("whole"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a word 5-shingle similarity of 0.8 or more, directly or not, the one of the least doc_id (null last) and mark of its text.

    Rows of one doc_id and text are copies too, of which that of the least hash of all
    columns stays. Null and empty texts have no shingles and link with nothing. An empty
    table gives an empty one. All columns stay as they are, whatever their names.
    """
    found = jaccard.similar_components(docs, 5, 80)
    stay = found.where("stays").select(F.struct("doc_id", "mark").alias("key")).distinct()
    return _packed(docs).join(stay, "key", "left_semi").groupBy("key").agg(F.min_by("row", "whole").alias("row")).select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of 35 words cover which start anywhere else too; other texts, null and empty ones too, as they are.

    Repeated rows repeat each other and lose their windows. A column n_chars, if there is one,
    is set to the new text's length; all others stay as they are, whatever their names. An
    empty table gives an empty one.
    """
    found = substrings.remove_repeats(docs.select("doc_id", "text", F.struct("*").dropFields("text").alias("row")), 35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that each source gives nearly its target's words.

    Rows that are equal in all columns are one unit, taken as often as all of them together;
    null doc_ids, texts and sources are values like others. An empty table gives an empty
    one. All columns stay as they are, whatever their names.
    """
    packed = _packed(docs)
    slim = packed.select("row.doc_id", "row.text", "row.source", "whole")
    copies = mixing.mix_sources(slim, mark=F.col("whole")).groupBy(F.struct("doc_id", "mark").alias("unit")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    once = packed.select("row", F.struct("key.doc_id", F.col("whole").alias("mark")).alias("unit")).join(copies, "unit").groupBy("unit").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens.

    Null and empty texts are one token, the end mark; longer ones than a sequence are cut.
    Repeated rows are packed each for itself; other columns are left out; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("repeated passages", drop_repeats), ("mixing", mix_to_targets), ("packing", pack)]

#: No SQL for learning, the cube method and tokenizing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
