import functools
import hashlib
import random

import pytest
from brute import base_places, jaccard_components, quality_counts, repeats_removed

from quire.llm import components, fingerprints, jaccard, licenses, quality, substrings

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)] + ["é", "über", "The", "THE"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(text, changes, rng=RNG):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@functools.cache
def corpus():
    passage, line = prose(60), prose(9)
    rows = [None, "", " \t\n", "one", "One two", "one two three", "a b c d", "A b c d", "x " * 3000, "x " * 34, "x " * 35, "x " * 36]
    base = prose(220)
    rows += [base, base, base.upper(), base + "\n"] + [near(base, c) for c in (1, 1, 2, 3, 5, 9, 12, 20, 40) for _ in range(3)]
    rows += [prose(30) + "\n" + passage + "\n" + prose(25) for _ in range(12)] + [line + "\n" + prose(40) + "\n" + line for _ in range(10)]
    rows += [near(prose(n), 0) for n in range(3, 30)]
    for n in (8, 10, 11, 13, 16, 20, 27):
        t = prose(n)
        rows += [t, near(t, 1), t + " more", "more " + t, " ".join(t.split()[1:])]
    rows += [passage, passage + " tail", "e f g " * 40, prose(5000)]
    chain = prose(120).split()
    rows += [" ".join(chain[i : i + 100]) for i in range(0, 20, 3)]
    return [(i * 7 % 1009, x) for i, x in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(i, x, "n", "row") for i, x in rows], "doc_id long, text string, n string, mark string").repartition(5)


def test_repeats_equal_brute_force(docs):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.text, r.mark) for r in substrings.remove_repeats(docs, 35).collect()}
    for (doc, text), want in zip(rows, repeats_removed(rows, 35)):
        assert got[doc] == (*want, text, "row"), (doc, (text or "")[:50])


def test_repeats_of_short_windows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 2_000)
    rows = [(i, " ".join(RNG.choice("ab") for _ in range(RNG.randrange(0, 60)))) for i in range(60)]
    for span in (1, 3, 9, 12):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span).collect()}
        for (doc, _), want in zip(rows, repeats_removed(rows, span)):
            assert got[doc] == want


def test_repeated_rows_and_null_ids_repeat_each_other(spark):
    t = prose(50)
    frame = spark.createDataFrame([(1, t), (1, t), (None, prose(50)), (None, None)], "doc_id long, text string")
    rows = substrings.remove_repeats(frame, 35).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, 50), (1, 50)]
    assert substrings.remove_repeats(frame.limit(0), 35).count() == 0


def test_components_equal_brute_force(docs):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()}
    for (doc, text), want in zip(rows, jaccard_components(rows)):
        assert got[doc] == want, (doc, (text or "")[:50])


@pytest.mark.parametrize("light", [0, 12, 24])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    rng = random.Random(light)
    rows = []
    for i in range(160):
        n = rng.randrange(4, 29)
        rows.append((i, " ".join(rng.choice("abcde") for _ in range(n)) if i % 3 or not rows else near(rng.choice(rows)[1], 1, rng)))
    monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {doc: want for (doc, _), want in zip(rows, jaccard_components(rows, 2, 80))}


def test_jaccard_edge_rows(spark):
    t = prose(40)
    frame = spark.createDataFrame([(5, t), (5, t), (9, t), (None, t), (None, None), (3, ""), (None, "only words here now")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard.similar_components(frame).collect() if r.component_id is not None)
    assert got == [(-1, 37, 5), (3, 0, 3), (5, 37, 5), (5, 37, 5), (9, 37, 5)]
    assert jaccard.similar_components(frame.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (100, 101)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "v long, u long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "v long, u long")).count() == 0


def test_licenses(spark):
    notice = dict(licenses.NOTICES)["bsd"]
    texts = [None, "", "The MIT License, and: mit LICENSE!", "GNU General-Public license", "mit  licenses", "the apache\nlicense " * 3, "x " * 300 + notice.upper() + " y" * 50, "foo " + notice.replace("binary", "object").replace("that the", "that all the") + " bar", "mit licenKe mit", "General public", "zé mit license é"]
    texts[8] = "mit licen" + licenses.KELVIN + "e mit"
    frame = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(None, "mit license", 1), (2, texts[2], 1)], "doc_id long, text string, row int")
    rows = licenses.scan_licenses(frame).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, found = base_places(texts[r.doc_id] if r.doc_id is not None else "mit license")
        places = sorted(i for i, _ in found)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), places[0] if places else None, places[-1] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if found:
            assert r.score == 1
    by = {r.doc_id: r for r in rows}
    assert by[6].labels == "bsd" and by[6].score == 1 and by[7].labels == "bsd" and by[7].score < 1
    assert by[0].labels == "" and by[0].score == 0


def test_quality(spark):
    texts = [x for _, x in corpus()] + ["a\n\nb\na\n a\n\t\nb", "# $%& <x> | *", "p q r p q r s p q", "a a a a a", "é ü\x0bx"]
    docs = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(i,) for i in range(12, 40)] + [(None,)], "doc_id long")
    ratios = quality.log_ratios(docs, trusted)
    assert len(ratios) == quality.BUCKETS
    for r in quality.judge(docs, ratios).collect():
        n, chars, symbols, dup, repeat, failed = quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed), texts[r.doc_id]
        assert r.kept == (not failed and r.llr >= quality.THRESHOLD)
    assert quality.judge(docs.limit(0), ratios).count() == 0
    assert set(quality.log_ratios(docs.limit(0), trusted)) == {0.0}


def plain_digest(data):
    import numpy as np

    n = [0] * 256
    for salt, (p, q) in enumerate(fingerprints.TRIPLETS, 1):
        for i in range(len(data) - q):
            n[int(fingerprints._bucket_of(*(np.array([data[j]], np.uint8) for j in (i, i + p, i + q)), salt)[0])] += 1
    s = sorted(n)
    codes = [sum(x > s[256 * k // 4 - 1] for k in (1, 2, 3)) for x in n]
    return f"{fingerprints.length_code(len(data)):02x}" + bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4)).hex()


def test_digests_equal_plain_counts(monkeypatch):
    texts = [b"", b"a", b"abcd", "über alles".encode() * 5, prose(100).encode()]
    want = [plain_digest(x) for x in texts]
    assert fingerprints.digests(texts) == want
    monkeypatch.setattr(fingerprints, "COUNT_BYTES", 64)
    assert fingerprints.digests(texts) == want


@pytest.mark.parametrize("parts", ["2", "5", "40"])
def test_fingerprints(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = sorted((i, x or "") for i, x in corpus())
        frame = spark.createDataFrame([(i, x, 1) for i, x in corpus()], "doc_id long, text string, part int").repartition(4)
        got = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
        assert len(got) == len(rows)
        for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            r, new = got[doc], fingerprints.edited(text, after)
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert [r.fingerprint, r.edited_fingerprint] == fingerprints.digests([text.encode(), new.encode()])
            assert r.near_edited == fingerprints.likeness([r.fingerprint], [r.edited_fingerprint])[0]
            assert r.near_next == fingerprints.likeness([r.fingerprint], fingerprints.digests([after.encode()]))[0]
        odd = spark.createDataFrame([(None, "nn"), (4, "abcdefgh"), (4, "abcdefgh"), (2, "xyxyxyxy")], "doc_id long, text string")
        want = sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("nn", "abcdefnn", "abcdefnn", "xyxyxyab"))
        assert sorted(r.edited_sha256 for r in fingerprints.fingerprints(odd).collect()) == want
        assert fingerprints.fingerprints(odd.limit(0)).count() == 0
        assert fingerprints.fingerprints(odd.where("doc_id = 4").limit(1)).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
