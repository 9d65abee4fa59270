"""Token counts and ids of whole texts under a public tokenizer file.

Huge texts are encoded in overlapping chunks and spliced where both encodings provably
agree; others word by word, each distinct word once, as no token crosses white space.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import worker_cache
from .kernels import slices

#: Texts of more characters than this are encoded in chunks of so many, with this overlap at first.
CHUNK, OVERLAP = 32_768, 1_024
#: Distinct words that a worker remembers at once.
MEMO = 200_000
#: White space to Python's `str` and `re`, but not to Unicode's White_Space, which the tokenizers use.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def load(path: str):
    """The tokenizer of a .json file, once in each worker."""
    held = worker_cache()
    if ("tokenizer", path) not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        held["tokenizer", path] = own
    return held["tokenizer", path]


def spliced(text: str, encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text from overlapping chunks.

    Each chunk begins `overlap` characters before the end of the one before. The two
    are joined at a place in the overlap that is proven stable: it lies at the start of
    a run of white space, where every token of this kind of vocabulary ends, and up to
    the end of the overlap's common part both encodings have the same tokens at the same
    offsets. If there is none, the overlap is doubled and the chunk encoded anew; at worst
    it grows to the whole text. Empty text: no ids.
    """
    if len(text) <= chunk:
        return encode(text)[0]
    out: list[int] = []
    ids, at = encode(text[:chunk])
    base, end = 0, chunk
    while end < len(text):
        wide = overlap
        while True:
            begin = max(base, end - wide)
            stop = min(len(text), begin + chunk + wide)
            more, places = encode(text[begin:stop])
            if begin == base:
                ids, at = more, places
                break
            cut = _common(text, ids, at, base, more, places, begin, end)
            if cut:
                out += ids[: cut[0]]
                ids, at = more[cut[1] :], [(s, e) for s, e in places[cut[1] :]]
                break
            wide *= 2
        base, end = begin, stop
    return out + ids


def _common(text: str, left, left_at, left_base: int, right, right_at, right_base: int, end: int) -> tuple[int, int] | None:
    """Indexes of the tokens in both lists from which on both may be exchanged, or None."""
    # tokens near an edge of a chunk may differ from those of the whole text
    starts = {s + right_base: j for j, (s, e) in reversed(list(enumerate(right_at))) if e > s and s + right_base < end}
    for i, (s, e) in enumerate(left_at):
        place = s + left_base
        if e <= s or place <= right_base or place not in starts:
            continue
        j, space = starts[place], place if text[place].isspace() else place - 1
        if not text[space].isspace() or text[space - 1].isspace() or space <= right_base or ODD_SPACE.match(text[space]):
            continue
        same = 0
        while i + same < len(left) and j + same < len(right) and left[i + same] == right[j + same] and left_at[i + same][0] + left_base == right_at[j + same][0] + right_base:
            same += 1
            if same == 8:
                return i, j
    return None


def _encoder(path: str):
    own = load(path)

    def encode(text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = own.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    return encode


def _remembered(path: str, kind: str, keys: set[str], value: Callable) -> dict:
    """What is remembered of words, with all of `keys`."""
    memo = worker_cache().setdefault((kind, path), {})
    new = keys.difference(memo)
    if new:
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = keys
        new = list(new)
        memo.update(zip(new, map(value, load(path).encode_batch_fast(new, add_special_tokens=False))))
    return memo


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    parts = [None if len(x) > CHUNK or ODD_SPACE.search(x) else x.split() for x in texts]
    memo = _remembered(path, "count", set().union(*(p for p in parts if p)), len)
    return [len(spliced(x, _encoder(path))) if p is None else sum(map(memo.__getitem__, p)) for x, p in zip(texts, parts)]


#: What the byte-level pre-tokenizer splits by: GPT-2's public pattern, a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no Unicode version disputes: up to the end of Latin Extended-B.
PLAIN = re.compile("[\0-\u024f]*")


def _ranked(path: str):
    """The file's merges as ranks of byte strings, for a faster encoder with the same ids; None if the file is of another kind."""
    held = worker_cache()
    if ("ranked", path) in held:
        return held["ranked", path]
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, found = spec["model"], spec["pre_tokenizer"] or {}, None
    plain = not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = plain and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
    merges = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if plain and made and min(made) > 255 and all(a < b for a, b in zip(made, made[1:])):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        ranks = {bytes(char[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        found = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    held["ranked", path] = found
    return found


def encode_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text under a vocabulary, as little-endian unsigned 32-bit numbers; the same as the tokenizers library's.

    Texts of plain characters go to an encoder made of the file's merges, others to the library.
    """
    fast, encode = _ranked(path), _encoder(path)
    return [fast.encode_to_numpy(x, allowed_special="all").astype("<u4").tobytes() if fast and PLAIN.fullmatch(x) else array("I", encode(x)[0]).tobytes() for x in texts]


def batches(rows: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts; null is empty."""
    for batch in rows:
        for part in slices(batch, "text", limit):
            yield part, [x or "" for x in part.column("text").to_pylist()]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text, ...).

    Null and empty texts have 0 bytes and tokens. Repeated rows, and rows with a null
    doc_id, each give a row. Other columns are left out. No shuffle; memory is bounded by
    the longest text.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(rows):
            n = count_tokens(texts, path)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
