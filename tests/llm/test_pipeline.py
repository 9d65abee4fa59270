"""The stages of the pipeline against plain versions, each on what the one before kept."""

import random
import zlib

import public_tokenizers
from brute import SPACED, jaccard_components, repeats_removed
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import mixing, packing

RNG = random.Random(8)


def rows():
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(RNG.choice(words) for _ in range(n))
    passage, base, out = prose(60), prose(150), []
    for i in range(260):
        kind, text = i % 10, prose(RNG.randrange(5, 160)) + "."
        if kind == 0:
            text = text + " you " + RNG.choice(["grob", "fies"]) + ". " + prose(5)
        elif kind == 1:
            text = prose(20) + "\n" + passage + "\n" + prose(30)
        elif kind == 2:
            own = base.split()
            own[RNG.randrange(150)] = "changed"
            text = " ".join(own)
        out.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    return [*out, (900, None, None, None, None), (901, "", "en", "s0", 0), (902, "only two", "en", "s1", 8), (902, "only two", "en", "s1", 8), (None, "no id here at all", "en", "s1", 17)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_stages(spark, tmp_path):
    source = rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(source, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 260 and i % 10 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    results, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        results[name] = sorted(map(tuple, now.collect()), key=key)

    clean = results["toxicity"]
    held = {r[0] for r in source if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    gone = {r[0] for r in source} - {r[0] for r in clean}
    assert all(i % 10 == 0 and i < 260 for i in gone) and len(gone) > 20 and gone & held
    assert set(clean) <= set(source)

    unique = results["near duplicates"]
    once = sorted(set(clean), key=key)
    named = [(r[0], r[1]) for r in once if r[0] is not None]
    classes = dict(zip(named, jaccard_components(named, 5, 80)))
    want = [r for r in once if r[0] is None or classes[r[0], r[1]][1] == r[0]]
    assert unique == want

    cut = results["repeated passages"]
    plain = repeats_removed([(r[0], r[1]) for r in unique], 35)
    expected = [(*r[:1], text if removed else r[1], *r[2:4], len(text if removed else r[1] or "")) for r, (_, removed, text) in zip(unique, plain)]
    assert cut == sorted(expected, key=key) and any(x[1] for x in plain)

    mixed, own = results["mixing"], {}
    for r in cut:
        own.setdefault(r[3], [0, 0])[0] += len(SPACED.findall(r[1] or ""))
    for r in mixed:
        own[r[3]][1] += len(SPACED.findall(r[1] or ""))
    order = sorted(own, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([own[s][0] for s in order], [float((3, 1, 2)[i % 3]) for i in range(len(order))], 1.5, 2.0)):
        assert abs(own[s][1] - t) <= 60
    assert set(mixed) <= set(cut) and max(mixed.count(r) for r in set(mixed)) <= 2

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    wanted = []
    for r in mixed:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        wanted += [(r[0] is None, r[0] or 0, k, s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + n]))) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((p.doc_id is None, p.doc_id or 0, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(wanted)


def test_run_applies_all_stages(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "repeated passages", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
