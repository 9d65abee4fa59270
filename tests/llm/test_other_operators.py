import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import mixing, toxicity, warc

RNG = random.Random(3)


def pages_rows():
    rows = [(i, f"http://x.example/{i % 9}", "page %d " % (i % 13) * RNG.randrange(1, 60)) for i in range(150)]
    rows += [(200 + i, "http://same", "<p>same\r\n\r\nWARC/1.1 \x1f</p>") for i in range(60)]
    rows += [(400, None, None), (401, "u\r\nv", ""), (None, "n", "only here"), (None, None, "<p>same\r\n\r\nWARC/1.1 \x1f</p>"), (402, "big", "é" * 300_000)]
    return rows


def test_warc_round_trip(spark):
    rows = pages_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = last[html or ""]
        again = top != (-1 if page is None else page)
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    small = warc.round_trip(pages, least=100).where("record_type = 'revisit'").agg({"payload_bytes": "min"}).first()[0]
    assert small is None or small >= 100
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 97, 1000, 1 << 20])
def test_every_record_has_one_owner(tmp_path, split):
    parts = [warc.page_record(i, "http://u", bytes(RNG.randrange(256) for _ in range(RNG.randrange(0, 300))) + b"\x1f\x8b\x08" * (i % 3), None) for i in range(30)]
    parts.insert(7, b"\x1f\x8b\x08 no gzip here")
    parts.insert(12, gzip.compress(b"a member, but no record"))
    parts.insert(15, parts[16][:-20])
    raw = b"".join(parts)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    if split == 1:
        raw = raw[:3000]
        (tmp_path / "a.warc.gz").write_bytes(raw)
    with (tmp_path / "a.warc.gz").open("rb") as f:
        whole = [(at, h["warc-record-id"]) for at, h, _ in warc.records(f, len(raw), 0, len(raw))]
        found = [(at, h["warc-record-id"]) for low in range(0, len(raw), split) for at, h, _ in warc.records(f, len(raw), low, low + split)]
    assert found == whole and len(whole) == len(set(whole))
    if split > 1:
        assert len(whole) == 30


def test_splits_over_spark(spark, tmp_path):
    raw = b"".join(warc.page_record(i, None, b"x" * (i * 37 % 500), None) for i in range(200))
    (tmp_path / "b.warc.gz").write_bytes(raw)
    files = warc.archives(spark, str(tmp_path / "*.gz"))
    rows = warc.read_warc(spark, files, split=700).collect()
    assert sorted(int(r.record_id.rpartition(":")[2]) for r in rows) == list(range(200))
    assert all(warc.digest(r.payload) == r.payload_digest and r.payload_bytes == len(r.payload) for r in rows)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == pytest.approx([0, 15])
    assert mixing.targets([5, 1000], [3, 1], 3, 2) == pytest.approx([10, 2000])
    assert mixing.targets([], [], 1.5, 2) == []


def test_walk_keeps_sums():
    for _ in range(300):
        units = [[RNG.random(), RNG.randrange(0, 50), 0, 0] for _ in range(RNG.choice([2, 3]))]
        before = (sum(u[0] for u in units), sum(u[0] * u[1] for u in units))
        mixing._walk(units, RNG.randrange(1 << 32))
        assert any(u[0] in (0.0, 1.0) for u in units) and all(0 <= u[0] <= 1 for u in units)
        assert sum(u[0] for u in units) == pytest.approx(before[0], abs=1e-6)
        if len(units) == 3:
            assert sum(u[0] * u[1] for u in units) == pytest.approx(before[1], abs=1e-4)


def test_landing_is_the_best_choice():
    assert mixing.land([(0.5, 10), (0.5, 20), (0.5, 30)]) in ([0, 0, 1], [1, 1, 0])
    assert mixing.land([]) == []


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(i, " ".join("w" * RNG.randrange(1, 4) for _ in range(RNG.randrange(0, 80))), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(1500)]
    rows += [(None, "a b c", None, 1), (5000, None, None, 1), (7, "x y", "s0", 1), (7, "x y", "s0", 1), (7, "x y", "s0", 1), (6000, "", "empty", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        own = sums.setdefault(r.source, [0, 0, r.target, r.source_size])
        own[0], own[1] = own[0] + r.size, own[1] + r.taken
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sums[s][0] for s in order], [float((3, 1, 2)[i % 3]) for i in range(len(order))], 1.5, 2.0)
    for s, t in zip(order, want):
        assert sums[s][2] == pytest.approx(t) and sums[s][0] == sums[s][3] and abs(sums[s][1] - t) <= 80
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def toxic_corpus(n, seed):
    rng, bad = random.Random(seed), ["grob", "fiese", "übel"]
    rows = []
    for i in range(n):
        s = [" ".join(rng.choice([f"w{k}" for k in range(60)]) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 9))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            k = rng.randrange(len(s))
            s[k] += " " + rng.choice(bad) + rng.choice(["", "ian", "er", "xyz"])
        rows.append((i, ". ".join(s) + ".", toxic))
    return rows


def test_toxicity_learns_from_document_labels(spark):
    rows = toxic_corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5], "doc_id long, toxic int")
    weights, bias = toxicity.train(docs, labels)
    assert (weights >= 0).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, weights, bias).collect()}
    held = [(i, t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == x for i, _, x in held]) > 0.95
    for i, _, x in held:
        if x and got[i].predicted:
            assert any(b in got[i].sentence_text for b in ("grob", "fiese", "übel"))
    assert toxicity.train(docs, labels)[1] == bias
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, weights, bias).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(None, "one two. three"), (1, None), (1, ""), (2, " .\n!"), (3, "a" * 5000)], "doc_id long, text string")
    weights, bias = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(docs, weights, bias).collect()
    assert len(rows) == 5 and [r.sentence for r in rows if r.doc_id in (1, 2)] == [None] * 3
    assert toxicity.score_toxicity(docs.limit(0), weights, bias).count() == 0


def test_noisy_or_of_plain_sentences():
    column = pa.array(["Bad one. good\nGood two! bad", None, "!!", "bad"])
    sentence, bucket, doc, begin, end, number = toxicity.sentences(column)
    texts = [(column[d].as_py() or "").encode()[a:b].decode() for d, a, b in zip(doc, begin, end)]
    assert texts == ["Bad one.", " good\n", "Good two!", " bad", "bad"] and number.tolist() == [0, 1, 2, 3, 0] and doc.tolist() == [0, 0, 0, 0, 3]
    scores = np.array([0.5, 0.1, 0.2, 0.3, 0.25])
    assert toxicity.noisy_or(scores, doc, 4) == pytest.approx([1 - 0.5 * 0.9 * 0.8 * 0.7, 0, 0, 0.25])
