"""Plain definitions that the operators are held against, and awkward rows."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width, short=True):
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w and short else set()


def components(texts, width, num, den):
    """Smallest reachable index of each text, by comparing all pairs."""
    sets, low = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def passages(rows, length):
    """{id: (repeated spans, surplus spans)} from all windows of all (id, text) rows, in the order of ids."""
    places = defaultdict(list)
    for key, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - length + 1):
            places[tuple(w[i:i + length])].append((key, i))
    hit = defaultdict(lambda: (set(), set()))
    for at in places.values():
        if len(at) > 1:
            for n, (key, i) in enumerate(at):
                hit[key][0].add(i)
                if n:
                    hit[key][1].add(i)

    def spans(starts):
        out = []
        for s in sorted(starts):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], s + length)
            else:
                out.append((s, s + length))
        return out
    return {key: (spans(a), spans(b)) for key, (a, b) in hit.items()}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


def awkward(spark, rows=()):
    """Documents with nulls in any column, empty, long, tied and repeated rows, and columns of clashing names."""
    base = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", None, 5), (None, "some words here", "en", "a", 1),
            (4, "One", "fr", "b", 3), (4, "One", "fr", "b", 3), (5, "é" * 3000 + " x", "fr", "b", 3002)]
    names = ["rid", "doc", "c", "n", "g", "key", "root", "wardatlas", "a", "b", "host", "line", "h", "v", "i", "score"]
    df = spark.createDataFrame([*base, *rows], SCHEMA)
    for i, name in enumerate(names):
        df = df.selectExpr("*", f"cast({i} as int) as `{name}`")
    return df
