"""Groups of suffixes stay small however common a phrase is, and repeats are the same."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import repeats_removed
from pyspark.sql import functions as F

from quire.llm import substrings


def banners():
    """A phrase of 12 words in every text with others around it, and a passage of 50 words in every fifth."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    phrase, passage = prose(12), prose(50)
    return [(i, " ".join([prose(30), phrase, prose(rng.randrange(60)), *([passage] if i % 5 == 0 else []), prose(9)])) for i in range(300)]


def test_groups_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(banners(), "doc_id long, text string").withColumn("mark", F.xxhash64("text"))

    def largest(heavy):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        sizes = Counter()
        for r in substrings.suffix_rows(docs, 35).collect():
            if r.kind == substrings.PARTED:
                sizes[r.key] += r.n
        return max(sizes.values())

    assert largest(1 << 17) > 200 >= largest(200)


@pytest.mark.parametrize("heavy", [0, 5, 200])
@pytest.mark.parametrize("span", [3, 9, 35])
def test_lengthened_prefixes_give_the_same(spark, monkeypatch, heavy, span):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "BLOCK", 4_000)
    rows = banners()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), span).collect()}
    assert got == {i: want for (i, _), want in zip(rows, repeats_removed(rows, span))}


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 13])
def test_names_order_suffixes_as_their_words_do(length):
    values = np.random.default_rng(length).integers(0, 3, 400).astype(np.uint64)
    names = substrings.names_at(values, length)
    words = [tuple(values[i : i + length].tolist()) for i in range(len(values) - length + 1)]
    ranks = {w: i for i, w in enumerate(sorted(set(words)))}
    assert names.tolist() == [ranks[w] for w in words]


def test_periodic_and_repeated_rows(spark):
    rows = [(1, "a " * 90), (2, "a b " * 50), (3, "x " + "a b " * 20), (4, " ".join(map(str, range(70)))), (4, " ".join(map(str, range(70)))), (None, " ".join(map(str, range(200, 260)))), (None, " ".join(map(str, range(200, 260)))), (5, None), (6, "")]
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect())))
    assert got == sorted(map(str, ((i, *want) for (i, _), want in zip(rows, repeats_removed(rows, 35)))))
