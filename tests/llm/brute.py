"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_places(text):
    words = ALNUM.findall((text or "").translate(LOW))
    found = []
    for label, phrase in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
        found += [(i, label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return len(words), found


def quality_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if many[w] > 1 for d in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def repeats_removed(rows, span):
    """(n_words, n_removed, kept words joined) of each (doc_id, text)."""
    words = [SPACED.findall(t or "") for _, t in rows]
    at = defaultdict(list)
    for r, w in enumerate(words):
        for i in range(len(w) - span + 1):
            at[tuple(w[i : i + span])].append((r, i))
    gone = {(r, i + d) for places in at.values() if len(places) > 1 for r, i in places for d in range(span)}
    out = []
    for r, w in enumerate(words):
        kept = [x for i, x in enumerate(w) if (r, i) not in gone]
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


def shingles(text, k=4):
    w = SPACED.findall((text or "").translate(LOW))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def jaccard_components(rows, k=4, percent=85):
    """(n_shingles, component_id) of each (doc_id, text), doc_ids distinct."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]
