"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document when at least num/den of its distinct word shingles occur there. Items are parted by
size into classes [2^j, 2^(j+1)). An item of a class with sizes up to u is sketched by its r smallest shingle hashes,
r = floor(u * (den - num) / den) + 1. An item of m <= u shingles that is contained misses at most floor(m * (den - num) / den)
of its shingles, fewer than r, so the document holds at least one of the r: the search loses nothing, whatever the
document's length. Each document is one pass over its shingles; those that meet a sketch name the items to verify on
whole sets. Nothing is shuffled: the items go to the tasks in blocks of at most about `BLOCK_SHINGLES`, one pass a block.

Defined results: null or empty texts, and those of fewer words than the width, contain and match nothing; rows that
repeat an item's id and text are one item; documents' rows each give their own matches; empty tables give none; other columns
are ignored by the search and passed by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .frames import keep_where, map_arrow, signed, texts

BLOCK_SHINGLES = 1 << 21        # 8 bytes each: 16 MB broadcast a block
_FILTER_BITS = 22


class Sketches:
    """One block of items: sketch hashes with the items they belong to, and every item's whole shingle set."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        hashes, owners = [], []
        for i, found in enumerate(sets):
            upper = (1 << len(found).bit_length()) - 1
            r = min(len(found), upper * (den - num) // den + 1)
            hashes.append(found[:r])            # sets are sorted by hash: the first are the minima
            owners.append(np.full(r, i))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], (np.concatenate(owners)[order] if owners else np.zeros(0, dtype=np.int64))

    def matcher(self, width: int):
        """A function from (word hashes, bounds) to matches (text, item, shared shingles)."""
        filled = np.zeros(1 << _FILTER_BITS, dtype=bool)
        low = np.uint64((1 << _FILTER_BITS) - 1)
        filled[self.hashes & low] = True

        def matches(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
            runs = words.ngram_hashes(hashes, width)
            at = np.flatnonzero(filled[runs & low])
            if not len(at):
                return
            first, end = np.searchsorted(self.hashes, runs[at], "left"), np.searchsorted(self.hashes, runs[at], "right")
            of = np.searchsorted(bounds, at, "right") - 1
            good = (end > first) & (at + width <= bounds[of + 1])
            wanted: dict[int, set[int]] = {}
            for text, lo, hi in zip(of[good].tolist(), first[good].tolist(), end[good].tolist()):
                wanted.setdefault(text, set()).update(self.owners[lo:hi].tolist())
            for text, items in wanted.items():
                found = np.unique(runs[bounds[text]:bounds[text + 1] - width + 1])
                for item in sorted(items):
                    own = self.sets[item]
                    place = np.minimum(np.searchsorted(found, own), len(found) - 1)
                    shared = int((found[place] == own).sum())
                    if shared * self.den >= self.num * len(own):
                        yield text, item, shared
        return matches


def _item_sets(width: int):
    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, hashes, bounds in words.word_slices(batch.column("text")):
            found = [signed(x) for x in words.shingles(hashes, bounds, width, whole_if_short=False)]
            yield {"doc": batch.column("doc").slice(lo, hi - lo), "rid": batch.column("rid").slice(lo, hi - lo),
                   "shingles": pa.array(found, type=pa.list_(pa.int64())), "n": pa.array([len(x) for x in found], type=pa.int64())}
    return sets


def sketch_blocks(items: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> Iterator[tuple[list, Sketches]]:
    """(item ids, sketches) of each block. The number of blocks follows the items, so a block stays bounded."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = map_arrow(texts(items, id_col, text_col).dropDuplicates(["rid"]), _item_sets(width),
                     f"doc {kind}, rid bigint, shingles array<bigint>, n bigint").where("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for block in range(blocks):
        mine = rows.where(F.pmod("rid", F.lit(blocks)) == block).orderBy("rid").toArrow().combine_chunks()
        sets = [np.array(x, dtype=np.int64).view(np.uint64) for x in mine.column("shingles").to_pylist()]
        yield mine.column("doc").to_pylist(), Sketches(sets, num, den)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", *, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document and item found in it: (doc, item, n_shared, n_item)."""
    rows, sc = texts(docs, id_col, text_col).select("doc", "text"), docs.sparkSession.sparkContext
    item_kind = items.schema[item_col].dataType
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, item {item_kind.simpleString()}, n_shared bigint, n_item bigint"
    result = docs.sparkSession.createDataFrame([], schema)
    for ids, sketches in sketch_blocks(items, item_col, item_text_col, width, num, den):
        held = sc.broadcast((ids, sketches))

        def search(batch: pa.RecordBatch, held=held) -> Iterator[dict]:
            names, block = held.value
            matches = block.matcher(width)
            for lo, _, hashes, bounds in words.word_slices(batch.column("text")):
                if hits := list(matches(hashes, bounds)):
                    yield {"doc": batch.column("doc").take(pa.array([lo + t for t, _, _ in hits])),
                           "item": pa.array([names[i] for _, i, _ in hits], type=_arrow_type(item_kind)),
                           "n_shared": pa.array([s for _, _, s in hits], type=pa.int64()),
                           "n_item": pa.array([len(block.sets[i]) for _, i, _ in hits], type=pa.int64())}

        result = result.union(map_arrow(rows, search, schema))
    return result


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", *, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents, with all their columns, in which no item is found. Nothing is shuffled."""
    for _, sketches in sketch_blocks(items, item_col, item_text_col, width, num, den):
        held = docs.sparkSession.sparkContext.broadcast(sketches)

        def clean(column: pa.Array, held=held) -> np.ndarray:
            matches, keep = held.value.matcher(width), np.ones(len(column), dtype=bool)
            for lo, _, hashes, bounds in words.word_slices(column):
                keep[[lo + t for t, _, _ in matches(hashes, bounds)]] = False
            return keep

        docs = keep_where(docs, text_col, clean)
    return docs
