"""License scans by diagonal voting, in DataFrame operations only.

Every place of a text gives the hash of the word pair that begins there; these are joined
with the places of the same pairs in the templates. A hit votes for its diagonal, the
place in the text less the place in the template. The votes of a diagonal say how much of
the template runs along it; neighbouring diagonals, between which words were put in or
left out, are merged; the spans found are verified by how much of the template they cover
and how long they are. Hits of notices count only where all GRAM words are equal, hits of phrases
where the pair is, so equal hashes alone never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a notice's n-grams; phrases go by pairs.
GRAM = 4
#: Diagonals of one notice that are merged are apart by this at most.
DRIFT = 6
#: A notice counts from this share of its n-grams on, in a span of this many times its words at most.
COVER, STRETCH = 0.6, 1.5
#: Word pairs of all templates, at most: the size that is broadcast.
MOST_PAIRS = 20_000

# Phrases, and public notices as lower-case words.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

KELVIN = "K"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are lowered. lower() also lowers letters beyond ASCII, which changes no word boundary and, but for the Kelvin sign, gives no a-z."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ķ"))), F.lit(WORDS), F.lit(0))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """pair_hash, pair, gram, template, label, is_phrase, place, total: a row for each place of each template. Refuses more places than MOST_PAIRS."""
    rows = []
    for t, (label, text) in enumerate([*phrases, *notices]):
        own, phrase = text.split(), t < len(phrases)
        size = 2 if phrase else GRAM
        if len(own) < size:
            raise ValueError(f"a template has fewer than {size} words: {text}")
        rows += [(" ".join(own[i : i + 2]), " ".join(own[i : i + size]), t, label, phrase, i, len(own) - size + 1) for i in range(len(own) - size + 1)]
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"templates have {len(rows)} places; at most {MOST_PAIRS} are broadcast")
    rows.append(("\x00", "\x00", -1, "", False, 0, 0))  # a row for each text, which carries its number of words
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows if r[2] >= 0)
    table = spark.sql(f"SELECT * FROM VALUES {quoted}, (chr(0), chr(0), -1, '', false, 0, 0) AS t(pair, gram, template, label, is_phrase, place, total)")
    return table.withColumn("pair_hash", F.xxhash64("pair"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans of every row of docs (doc_id, text, ...).

    n_base: places of all phrases; first_word, last_word: the least and greatest, null if
    there is none; base_labels: of phrases, labels: of verified notices too, distinct,
    sorted and joined by commas, or empty. score: 1 with a phrase, else the greatest share of a
    notice that a span covers. Null texts are empty and have no words. Repeated rows and rows with a null doc_id each
    give a row. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    n = F.size("words")
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((i - 1).alias("at"), F.array_join(F.slice("words", i, F.lit(GRAM)), " ").alias("gram")))).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))
    last = F.array(F.struct(n.alias("at"), F.lit("\x00").alias("gram")))
    places = own.select("row", "doc_id", F.inline(F.concat(grams, last))).withColumn("own_pair", F.substring_index("gram", " ", 2))
    t = templates(spark, phrases, notices).alias("t")
    equal = (F.xxhash64("own_pair") == F.col("t.pair_hash")) & F.when(F.col("t.is_phrase"), F.col("own_pair") == F.col("t.pair")).otherwise(F.col("p.gram") == F.col("t.gram"))
    hits = places.alias("p").join(F.broadcast(t), equal).select("row", "doc_id", "at", F.col("t.template").alias("template"), F.col("t.label").alias("label"), F.col("t.is_phrase").alias("is_phrase"), F.col("t.total").alias("total"), (F.col("at") - F.col("t.place")).alias("diagonal"))
    hits = hits.repartition("row")  # all groups below lie inside a row: one exchange, of hits only
    lines = hits.groupBy("row", "doc_id", "template", "label", "is_phrase", "total", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    parted = F.col("is_phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True))
    lines = lines.withColumn("parted", parted.cast("int")).withColumn("span", F.sum("parted").over(along))
    spans = lines.groupBy("row", "doc_id", "template", "label", "is_phrase", "total", "span").agg(F.least(F.sum("votes"), F.first("total")).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    cover = F.when(F.col("total") > 0, F.col("votes") / F.greatest("total", F.lit(1)))
    base = F.col("is_phrase") & (F.col("votes") == F.col("total"))
    long = F.col("last") - F.col("first") + GRAM
    verified = ~F.col("is_phrase") & (F.col("template") >= 0) & (cover >= COVER) & (long <= STRETCH * (F.col("total") + GRAM - 1))

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("first"))).cast("long").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(base | verified).alias("labels"), F.coalesce(F.max(F.when(base, 1.0).when(~F.col("is_phrase") & (F.col("template") >= 0), cover)), F.lit(0.0)).alias("score"), F.count_if(base | verified).alias("n_spans"),
    ).drop("row")
