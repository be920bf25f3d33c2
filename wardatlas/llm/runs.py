"""Periodic run detection by maximal pairs of the LCP-interval tree of a text's words.

A run is a stretch of consecutive words of smallest period q that is at least max(`min_length`, `min_exponent` * q) words long
and that neither neighbouring word extends. Two places i < j whose following l words are equal, with different words before
and after (or none), are a maximal pair; [i, j + l) then has the period p = j - i and cannot be extended. With
l >= (min_exponent - 1) * p and p + l >= min_length the pair is a run; nothing is extended. A stretch that shows with
several multiples of its period counts with the smallest, which by the theorem of Fine and Wilf is q.

1. Words are numbered; suffixes are sorted by prefix doubling, all texts of a slice at once. Only places whose first four words occur
   again go on, and of those the ones near enough: a run of period p has consecutive such places for 4 * p - 3 words and more.
2. LCP values of neighbours come from Kasai's scan, in text order.
3. The LCP-interval tree is built bottom-up with a stack. An interval holds its places in order, each with its class, the word
   to its left. When a child joins, each place of the smaller side asks the larger one for places within l / (min_exponent - 1)
   words. Such places are one arithmetic progression (the l words overlap), so they have one class but for the first of
   them, and a place meets either that first one or, being the first itself, the list of all later ones: what is read is reported.

Python handles one text at a time; Spark deals out the texts. Memory follows the slice of `SLICE_WORDS` words, or the longest text.

Defined results: a null or empty text, or one without words, has no runs and an empty collapsed text; every row gives one row,
so repeated rows give equal rows; a null id stays null; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_arrow

SLICE_WORDS = 1 << 16
_SEEN = 4                       # words that two places must share to be looked at


def _sorted_places(ids: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rank of every place): the places whose first `_SEEN` words occur again in their text, near enough for a
    run. Places of one text that share a beginning stand together in the order of ranks."""
    n = len(ids)
    active = np.lexsort((ids, text_of))
    first, second = text_of[active], ids[active]
    rank, h, seen, rank_of = np.zeros(n, dtype=np.int64), 1, None, first
    while True:
        # `active` is sorted by (first, second); equal pairs are one group, named by the place of its first member
        new = np.ones(len(active), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        old = np.ones(len(active), dtype=bool)
        old[1:] = first[1:] != first[:-1]
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank_of = begin if h == 1 else first + begin - np.maximum.accumulate(np.where(old, at, 0))
        rank[active] = rank_of
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, rank_of = active[~alone], rank_of[~alone]
        if h == _SEEN:
            seen = _near(active, rank_of)           # the others are still ranked: what follows a place may be one of them
        if not len(active):
            break
        ahead = active + h
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((second, rank_of))
        active, first, second = active[order], rank_of[order], second[order]
        h *= 2
    return (np.zeros(0, dtype=np.int64) if seen is None else seen), rank


def _near(places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of places grouped by equal words those that may begin or repeat a run: the next equal place within reach of the
    consecutive places around."""
    if not len(places):
        return places
    order = np.lexsort((places, ranks))
    place, rank = places[order], ranks[order]
    gap = np.where(rank[1:] == rank[:-1], place[1:] - place[:-1], np.iinfo(np.int64).max // 8)
    near = np.minimum(np.append(gap, gap.max(initial=1)), np.append(gap.max(initial=1), gap))
    by_place = np.argsort(place)
    there = place[by_place]
    cut = np.ones(len(there), dtype=bool)
    cut[1:] = there[1:] != there[:-1] + 1
    number = np.cumsum(cut) - 1
    stretch = np.empty(len(there), dtype=np.int64)
    stretch[by_place] = np.bincount(number)[number]
    keep = near <= stretch + _SEEN                # period <= stretch: the loose side of the bound, for any exponent
    return place[keep]


def _lcp(order: list[int], ids: list[int], ends: list[int]) -> list[int]:
    """Common words of each sorted place with the one before it, by Kasai's scan over the places in text order."""
    nth = {place: k for k, place in enumerate(order)}
    out, common, last, beside = [0] * len(order), 0, -2, -2
    for i in sorted(order):
        k = nth[i]
        common = max(common - 1, 0) if i == last + 1 and beside + 1 in nth else 0
        j = order[k - 1] if k else -1
        if j < 0 or ends[j] != ends[i]:
            common, beside = 0, -2
        else:
            stop = ends[i] - max(i, j)
            while common < stop and ids[i + common] == ids[j + common]:
                common += 1
            beside = j
        out[k], last = common, i
    return out


def _joined(common: int, here: list[int], child: list[int], left: list[int], reach: int, found: dict) -> list[int]:
    """The places of two children of an interval; `found` gets (start, length) with the smallest period of their pairs."""
    if len(here) < len(child):
        here, child = child, here
    for j in child:
        k = bisect_left(here, j - reach)
        if k < len(here) and here[k] < j and left[here[k]] != left[j]:
            i = here[k]
            key = (i, j + common - i)
            found[key] = min(found.get(key, j - i), j - i)
        k = bisect_right(here, j)
        while k < len(here) and here[k] <= j + reach and left[here[k]] != left[j]:
            i = here[k]
            key = (j, i + common - j)
            found[key] = min(found.get(key, i - j), i - j)
            k += 1
    if len(child) > 8:
        return sorted(here + child)
    for j in child:
        insort(here, j)
    return here


def _runs(ids: np.ndarray, text_of: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> dict:
    """{(start, length): period} over all texts of a slice; starts count from the begin of the slice."""
    places, rank = _sorted_places(ids, text_of, ends)
    found: dict[tuple[int, int], int] = {}
    if len(places) < 2:
        return found
    order = places[np.argsort(rank[places])].tolist()
    before = np.where(np.arange(len(ids)) == begins, -1, np.roll(ids, 1)).tolist()
    words = ids.tolist()
    common = _lcp(order, words, ends.tolist())
    least = min_length - max(1, min_length // min_exponent)         # p + l >= min_length with p <= l / (min_exponent - 1)
    stack: list[tuple[int, list[int]]] = []
    for k in range(1, len(order) + 1):
        level = common[k] if k < len(order) else 0
        child = [order[k - 1]]
        while stack and stack[-1][0] > level:
            deep, here = stack.pop()
            child = _joined(deep, here, child, before, deep // (min_exponent - 1), found)
        if level >= least:
            if stack and stack[-1][0] == level:
                stack[-1] = (level, _joined(level, stack[-1][1], child, before, level // (min_exponent - 1), found))
            else:
                stack.append((level, child))
    return {key: p for key, p in found.items() if key[1] >= min_length}


def _slices(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        held.append(text.split())                               # the white space of bytes.split is 0x20 and 0x09-0x0D
        n += len(held[-1])
        if n >= SLICE_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def slice_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Of each text, given as words, its runs (start, length, period) by start, then period."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(offsets[-1]))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    found = _runs(ids, text_of, offsets[text_of], offsets[text_of + 1], min_length, min_exponent) if len(ids) else {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, length), period in found.items():
        t = int(text_of[start])
        out[t].append((start - int(offsets[t]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if end > at:
            kept += words[at:max(at, start)]
            at = end
    return b" ".join(kept + words[at:]) if runs else b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc, runs array<struct<start, length, period>>, collapsed text) of every row. Words are numbered from 0."""
    if min_exponent < 3 or min_length < _SEEN + 2:
        raise ValueError("a run has at least three periods and six words")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def search(batch: pa.RecordBatch) -> Iterator[dict]:
        done, column = 0, batch.column("text")
        for texts in _slices(v.as_py() for v in column):
            runs = slice_runs(texts, min_length, min_exponent)
            short = [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(texts, runs)]
            listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs],
                              type=pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield {"doc": batch.column("doc").slice(done, len(texts)), "runs": listed, "collapsed": pa.array(short, type=pa.string())}
            done += len(texts)

    return map_arrow(rows, search, f"doc {rows.schema['doc'].dataType.simpleString()}, "
                                   "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents; where the CRC-32 h of the decimal id is divisible by 10, the words from a on repeat the p words there
    (g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8)) and are joined by one space. No id, no change."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.expr("h div 10")
    words: Column = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kept = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), h.alias("h"),
                       F.when(h % 10 == 0, words).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1)).cast("bigint")
    placed = rows.withColumn("g", g).withColumn("a", (F.col("g") % n).cast("int")).withColumn("m", (n - F.col("a")).cast("int"))
    period = F.expr("cast(1 + m div (3 + g % 8) as int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast((m + p - 1) div p as int)"))), F.lit(1), F.col("m"))
    text = F.when((F.col("h") % 10 == 0) & (F.size("w") > 0), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col(f"d.`{text_col}`"))
    return placed.withColumn("p", period).select(*[text.alias(c) if c == text_col else k for c, k in zip(docs.columns, kept)])
