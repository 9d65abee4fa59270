"""One row of a group of near copies stays, whatever its ids are."""

import random

import corpus_pipeline


def test_one_of_a_group_stays(spark):
    rng = random.Random(3)
    prose = lambda: [f"w{rng.randrange(900)}" for _ in range(120)]

    def copies(n):
        base = prose()
        return [" ".join([*base, f"end{i}"]) for i in range(n)]

    no_ids, one_id, other, mixed = copies(4), copies(3), copies(2), copies(3)
    rows = [(None, t) for t in no_ids] + [(5, t) for t in one_id] + [(5, other[0]), (6, other[1])] + [(None, mixed[0]), (8, mixed[1]), (7, mixed[2])] + [(None, None), (None, ""), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    of = lambda group: [r for r in got if r[1] in group]
    assert len(of(no_ids)) == 1 and len(of(one_id)) == 1
    assert of(other) == [(5, other[0])] and of(mixed) == [(7, mixed[2])]
    assert (None, "") in got and (9, "alone") in got and (None, None) in got and len(got) == 7
