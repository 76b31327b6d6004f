"""Small tables and brute-force versions that the tests of the operators share."""

from __future__ import annotations

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(rows, k, percent):
    """doc_id -> smallest doc_id that links lead to."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {}
    for members in by.values():
        for n, a in enumerate(members):
            for b in members[n + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}
