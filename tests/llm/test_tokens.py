import zlib

import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import packing, tokens

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\n\n\nend\n", "<|endoftext|> x<|endoftext|>y", "é ß İstanbul ΑΣ ας", "a\x1cb \x1f c", "日本語 text", "x" * 5000, "don't we'll  I'm", "á b ́c", "non breaking　space", "word " * 9000, "z" * 40000 + " tail", "é" * 40000, "one two\n" * 12000 + "x"]


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(ODD)] + [(3, "a", "n"), (None, "b c", None)], "doc_id long, text string, n_tokens string")
    rows = tokens.token_counts(docs, path).collect()
    assert len(rows) == len(ODD) + 2
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, x in enumerate(ODD):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(whole(path, x)), len((x or "").encode())), (i, (x or "")[:40])


def test_splice_equals_whole_encoding():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = tokens._encoder(path)
    for x in [*[x for x in ODD if x], "ab cd  ef\n" * 300, "q" * 700 + " b" * 700]:
        assert tokens.spliced(x[:9000], encode, 500, 20) == encode(x[:9000])[0], x[:40]


def test_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for x, b in zip(ODD, tokens.encode_bytes([x or "" for x in ODD], path)):
        assert b == b"".join(i.to_bytes(4, "little") for i in whole(path, x)), (x or "")[:40]


def test_best_fit_fills_and_is_gapless():
    import random

    rng = random.Random(5)
    for limit in (8, 64):
        for _ in range(60):
            histogram = {n: rng.choice([1, 2, 7, 40]) for n in rng.sample(range(1, limit + 1), rng.randint(1, 8))}
            bins: dict[int, list] = {}
            for length, low, high, first, each, base in packing.best_fit(histogram, limit):
                for r in range(high - low):
                    bins.setdefault(first + r // each, []).append((base + r % each * length, length))
            placed: dict[int, int] = {}
            for own in bins.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                    placed[length] = placed.get(length, 0) + 1
                assert at <= limit
            assert placed == histogram
            plain: list[int] = []
            for length in sorted(histogram, reverse=True):
                for _ in range(histogram[length]):
                    fits = [i for i, room in enumerate(plain) if room >= length]
                    if fits:
                        plain[min(fits, key=lambda i: plain[i])] -= length
                    else:
                        plain.append(limit - length)
            assert len(bins) == len(plain)


def test_pack(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a b c", "word " * 9000, "x y z w " * 700, "a b c"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(2, "a b c", 1)], "doc_id long, text string, rank int").repartition(3)
    rows = packing.pack(docs, path).collect()
    for i, x in enumerate(texts):
        ids = whole(path, x) + [0]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert own == [(k, s, n, zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[s : s + n]))) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0
