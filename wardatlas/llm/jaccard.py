"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence, with size-derived bounds.

Documents are rows and word shingles are columns of the incidence matrix. Two sets of sizes m <= n can only reach the
bound `num/den` if m * den >= n * num, if they overlap in at least ceil(num * (m + n) / (num + den)) shingles, and if
they share one of the first size - ceil(size * num / den) + 1 shingles of each (in any order that all sets use). So:

1. Equal sets are one class; all further work is on classes.
2. Only those first shingles enter the product. The order is by hash with the most frequent ones last, so common phrases
   hardly ever make columns. It steers cost alone: any order gives the same links.
3. Columns of up to `BLOCK` classes are multiplied in full and the products of a pair are summed. A pair whose sum, plus
   what the rest of the sets could add, is below the overlap bound is discarded. Then the shingles of all classes in
   question are counted: one that no other of them has is in no overlap, so the overlap of two classes is at most the
   smaller number of shared shingles, and pairs below the bound by that leave too. The others are compared on whole sets,
   in two turns: first each class with its hub (the smallest partner) and with the partner of the largest sum, then the
   pairs that these links have not brought into one component.
4. A larger column is not multiplied in full. Its pivot, the class in most large columns, is compared with all others.
   Then only pairs from different components are left, and of those one class is outside the column's largest component.
   Such outside classes are pivots in turn, a few of each column first, then many, against the classes of other
   components. Jaccard distance is a metric and both distances to the first pivot are known: where they differ by more
   than the bound, a pair cannot link. Which of the first pivot's shingles a class has is known too, as bits: what two
   classes share is what they both have of these, and at most the smaller number of their other shared shingles. So of
   many variants of one text hardly more pairs are compared on whole sets than link.
5. Components of the links give each document the smallest id it reaches. Every link that joins two components is found;
   links inside a component that is already known may stay uncompared.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own
component; fewer words than the width make one shingle of the whole sequence; rows with null ids take part and count
as no smaller id; repeated rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .frames import components, map_arrow, signed, small_side, stored, texts

BLOCK = 64                      # classes in a column that are multiplied in full
FREQUENT = 1 << 18              # entries in the broadcast list of frequent shingles (2 MB); only order, never results
_KEY, _COUNT = "wardatlas row key", "wardatlas rows of group"
_CHUNK = 1 << 20                # shingles counted together when frequent ones are looked for


def _set_key(found: np.ndarray) -> int:
    return int(words.mix(np.array([found.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(words.mix(found))]))[0]) if len(found) else 0


def _classes(width: int):
    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, hashes, bounds in words.word_slices(batch.column("text")):
            keys, sizes = np.zeros(hi - lo, dtype=np.uint64), np.zeros(hi - lo, dtype=np.int64)
            for i, found in enumerate(words.shingles(hashes, bounds, width)):
                keys[i], sizes[i] = _set_key(found), len(found)
            yield {"doc": batch.column("doc").slice(lo, hi - lo), "rid": batch.column("rid").slice(lo, hi - lo),
                   "c": pa.array(signed(keys)), "n": pa.array(sizes)}
    return sets


def _repeated_locally(width: int):
    """Shingles met at least three times in a chunk, with how often: partial sums of a global count."""
    def counts(parts: list[np.ndarray]) -> dict:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        often = n >= 3
        return {"g": pa.array(signed(values[often])), "n": pa.array(n[often].astype(np.int64))}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, hashes, bounds in words.word_slices(batch.column("text")):
                for found in words.shingles(hashes, bounds, width):
                    parts.append(found)
                    held += len(found)
                if held >= _CHUNK:
                    yield pa.RecordBatch.from_pydict(counts(parts))
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict(counts(parts))
    return task


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles, at most `FREQUENT`, sorted. From all documents; a hint for the order of shingles."""
    rows = (docs.select("text").mapInArrow(_repeated_locally(width), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
            .where("n >= 8").orderBy(F.desc("n"), "g").limit(FREQUENT).select("g").toArrow())
    return np.sort(np.asarray(rows.column("g").to_numpy()).view(np.uint64)) if rows.num_rows else np.zeros(0, dtype=np.uint64)


def _prefixes(width: int, num: int, den: int, frequent):
    def incidence(batch: pa.RecordBatch) -> Iterator[dict]:
        last = frequent.value
        for _, _, hashes, bounds in words.word_slices(batch.column("text")):
            seen, gs, keys, sizes, lengths = set(), [], [], [], []
            for found in words.shingles(hashes, bounds, width):
                n = len(found)
                if n * (den - num) < num:               # no other set can reach the bound
                    continue
                key = _set_key(found)
                if key in seen:
                    continue
                seen.add(key)
                if len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    late = last[at] == found
                    found = np.concatenate((found[~late], found[late]))
                found = found[:n - -(-n * num // den) + 1]
                gs.append(found)
                keys.append(key)
                sizes.append(n)
                lengths.append(len(found))
            if gs:
                yield {"g": pa.array(signed(np.concatenate(gs))),
                       "c": pa.array(signed(np.repeat(np.array(keys, dtype=np.uint64), lengths))),
                       "n": pa.array(np.repeat(np.array(sizes, dtype=np.int64), lengths))}
    return incidence


def _overlaps(width: int, places: bool):
    def compare(batch: pa.RecordBatch) -> Iterator[dict]:
        sides = [_sets(batch.column(name), width) for name in ("left", "right")]
        held = [np.isin(y, x, assume_unique=True) for x, y in zip(*sides)]
        found = {name: batch.column(name) for name in ("a", "b", "na", "nb")} | {"both": pa.array([int(h.sum()) for h in held], type=pa.int64())}
        yield found | ({"bits": pa.array([_packed(h) for h in held], type=pa.list_(pa.int64()))} if places else {})
    return compare


def _packed(held: np.ndarray) -> np.ndarray:
    """Booleans as bits of 64-bit numbers."""
    return np.packbits(np.pad(held, (0, -len(held) % 64))).view(np.int64)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, hashes, bounds in words.word_slices(column):
        yield from words.shingles(hashes, bounds, width)


def _all_shingles(width: int):
    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        classes = np.asarray(batch.column("c"))
        for lo, hi, hashes, bounds in words.word_slices(batch.column("text")):
            found = list(words.shingles(hashes, bounds, width))
            yield {"s": pa.array(signed(np.concatenate(found))), "c": pa.array(np.repeat(classes[lo:hi], [len(x) for x in found]))}
    return rows


class _Join:
    """The steps of one join, over (doc, rid, text) rows."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.members = stored(map_arrow(docs, _classes(width), f"doc {docs.schema['doc'].dataType.simpleString()}, rid bigint, c bigint, n bigint"), "members")

    def need(self, a: str, b: str):
        return F.expr(f"({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den}")

    def sized(self, a: str, b: str):
        return (F.least(a, b) * self.den >= F.greatest(a, b) * self.num)

    def incidence(self) -> DataFrame:
        """(g, c, n, width of column g) where the first shingles of at least two classes meet."""
        frequent = self.docs.sparkSession.sparkContext.broadcast(frequent_shingles(self.docs, self.width))
        rows = map_arrow(self.docs.select("text"), _prefixes(self.width, self.num, self.den, frequent), "g bigint, c bigint, n bigint")
        met = rows.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
        cells = stored(rows.join(met, "g").distinct(), "cells")
        return cells.join(cells.groupBy("g").agg(F.count("*").alias("wide")), "g")

    def candidates(self, cells: DataFrame) -> DataFrame:
        """Pairs from columns of up to BLOCK classes whose summed products leave the overlap bound within reach."""
        a = cells.where(F.col("wide") <= BLOCK).select("g", F.col("c").alias("a"), F.col("n").alias("na"))
        b = a.select("g", F.col("a").alias("b"), F.col("na").alias("nb"))
        wide = cells.where(F.col("wide") > BLOCK).groupBy("c").agg(F.count("*").alias("more"))     # products not summed below
        summed = (a.join(b, "g").where((F.col("a") < F.col("b")) & self.sized("na", "nb"))
                  .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("sum")))
        rest = F.expr(f"(greatest(na, nb) * {self.num} + {self.den - 1}) div {self.den} - 1")
        with_more = (summed.join(wide.select(F.col("c").alias("a"), F.col("more").alias("ma")), "a", "left")
                     .join(wide.select(F.col("c").alias("b"), F.col("more").alias("mb")), "b", "left"))
        more = F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
        return with_more.where(F.col("sum") + more + rest >= self.need("na", "nb")).select("a", "b", "na", "nb", "sum")

    def compare(self, pairs: DataFrame, sets: DataFrame, name: str, places: bool = False) -> DataFrame:
        """Exact overlap of each pair, from the two whole texts; with `places` also which shingles of b, in their order, a has, as bits."""
        pairs = stored(pairs, "pairs")
        keys = stored(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), "keys")
        asked = sets.join(small_side(keys, 16), "c", "left_semi")
        left = asked.select(F.col("c").alias("a"), F.col("text").alias("left"))
        right = asked.select(F.col("c").alias("b"), F.col("text").alias("right"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "left", "right")
        schema = "a bigint, b bigint, na bigint, nb bigint, both bigint" + (", bits array<bigint>" if places else "")
        return stored(map_arrow(full, _overlaps(self.width, places), schema), name)

    def linked(self, pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("both") >= self.need("na", "nb")).select("a", "b")

    @staticmethod
    def first_turn(pairs: DataFrame) -> DataFrame:
        """Of each class the pair with its smallest partner, and the one with the largest sum; b is the partner."""
        ends = pairs.union(pairs.select("b", "a", "nb", "na", "sum"))
        best = ends.groupBy("a", "na").agg(F.min(F.struct("b", "nb")).alias("hub"), F.max(F.struct("sum", "b", "nb")).alias("near"))
        return best.select("a", "na", F.explode(F.array(F.col("hub"), F.struct("near.b", "near.nb"))).alias("p")).select(
            "a", F.col("p.b").alias("b"), "na", F.col("p.nb").alias("nb"))

    def apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose classes are not known to be in one component."""
        side = lambda key: roots.select(F.col("v").alias(key), F.col("root").alias(f"r{key}"))
        return (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
                .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb"))

    def wide_links(self, wide: DataFrame, measured: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
        """(v, root) after all links that columns of more than BLOCK classes add (step 4 of the module text); `wide` has each
        column's pivot, `measured` the compared pairs (a, pivot)."""
        limit = 1 - self.num / self.den + 1e-9
        distance = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
        known = measured.select(F.col("a").alias("c"), F.col("b").alias("pivot"), distance.alias("d"), F.col("both").alias("of"), "bits")
        mine = F.col("c") == F.col("pivot")
        cells = stored(wide.join(known, ["c", "pivot"], "left")
                       .select("g", "c", "n", "e", F.when(mine, 0.0).otherwise(F.col("d")).alias("d"), F.when(mine, F.col("n")).otherwise(F.col("of")).alias("of"),
                               F.when(mine, 0).otherwise(F.col("e") - F.col("of")).alias("more"), "bits"), "wide")
        columns = stored(cells.groupBy("c").agg(F.sort_array(F.collect_list("g")).alias("gs")), "columns of classes")
        asked, per_column = columns.select("c").where("false"), 8
        while True:
            roots = components(links)
            placed = stored(cells.join(columns, "c").join(roots.withColumnRenamed("v", "c"), "c", "left")
                            .select("g", "c", "n", "e", "d", "of", "more", "bits", "gs", F.coalesce("root", "c").alias("root")), "placed")
            main = placed.groupBy("g", "root").agg(F.count("*").alias("size")).groupBy("g").agg(F.max(F.struct("size", "root")).alias("m"))
            outside = placed.select("g", "c", "root").join(main, "g").where("root <> m.root").join(asked, "c", "left_anti")
            slot = F.pmod(F.xxhash64("c"), F.lit(per_column))
            pivots = stored(outside.groupBy("g", slot).agg(F.min("c").alias("c")).select("c").distinct(), "pivots")
            if pivots.isEmpty():
                return roots
            b = placed.join(pivots, "c").withColumnsRenamed({"c": "b", "n": "nb", "e": "eb", "d": "db", "of": "ofb", "more": "moreb", "bits": "bitsb", "gs": "hs",
                                                             "root": "rb"})
            near = F.abs(F.coalesce("d", "db") - F.coalesce("db", "d")) <= limit       # an unknown distance rules nothing out
            once = F.col("g") == F.array_min(F.array_intersect("gs", "hs"))             # in the first column that both are in
            both_have = F.aggregate(F.zip_with("bits", "bitsb", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, v: s + v)
            share = F.coalesce(both_have, F.least("of", "ofb")) + F.least("more", "moreb")      # least skips what is unknown of one side
            pairs = (placed.withColumnsRenamed({"c": "a", "n": "na"}).join(b, "g")
                     .where((F.col("root") != F.col("rb")) & self.sized("na", "nb") & (F.least("e", "eb") >= self.need("na", "nb"))
                            & F.coalesce(near, F.lit(True)) & once & F.coalesce(share >= self.need("na", "nb"), F.lit(True))).select("a", "b", "na", "nb"))
            found = self.linked(self.compare(pairs, sets, "compared"))
            links = stored(links.union(found), "links")
            asked = stored(asked.union(pivots), "asked")
            per_column *= 64

    def with_shared(self, sets: DataFrame) -> DataFrame:
        """(c, e): of each class the number of shingles that another class in question has too."""
        own = (map_arrow(sets, _all_shingles(self.width), "s bigint, c bigint")
               .groupBy("s").agg(F.count("*").alias("k"), F.min("c").alias("c")).where("k = 1").groupBy("c").agg(F.count("*").alias("own")))
        return sets.select("c", "n").join(own, "c", "left").select("c", (F.col("n") - F.coalesce("own", F.lit(0))).alias("e"))

    def roots(self) -> DataFrame:
        """(v, root) of the classes that have links."""
        cells = stored(self.incidence(), "columns")
        pairs = stored(self.candidates(cells), "pairs")
        wide = cells.where(F.col("wide") > BLOCK).select("g", "c", "n")
        keys = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).union(wide.select("c")).distinct()
        member = self.members.join(keys, "c").groupBy("c").agg(F.min("rid").alias("rid"), F.min("n").alias("n"))
        sets = stored(self.docs.join(member, "rid").select("rid", "c", "n", "text").dropDuplicates(["rid", "c"]).select("c", "n", "text"), "sets")
        shared = stored(self.with_shared(sets), "shared")
        bound = lambda key: shared.select(F.col("c").alias(key), F.col("e").alias(f"e{key}"))
        pairs = stored(pairs.join(bound("a"), "a").join(bound("b"), "b").where(F.least("ea", "eb") >= self.need("na", "nb")).drop("ea", "eb"), "pairs")
        wide = wide.join(shared, "c").where(F.col("e") * self.den >= F.col("n") * self.num)
        often = wide.groupBy("c").agg(F.count("*").alias("often"))
        pivot = wide.join(often, "c").groupBy("g").agg(F.max(F.struct("often", "c", "n", "e")).alias("p"))
        wide = stored(wide.join(pivot, "g").select("g", "c", "n", "e", F.col("p.c").alias("pivot"), F.col("p.n").alias("np"), F.col("p.e").alias("ep")), "pivoted")
        hubs = wide.where((F.col("c") != F.col("pivot")) & self.sized("n", "np") & (F.least("e", "ep") >= self.need("n", "np"))).select(
            F.col("c").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na"), F.col("np").alias("nb"))
        turn = self.first_turn(pairs)
        swap = F.col("a") > F.col("b")
        turn = turn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
                           F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        first = stored(turn.union(hubs).distinct(), "first")
        measured = self.compare(first, sets, "measured", places=True)
        links = stored(self.linked(measured), "links")
        seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = self.apart(pairs.drop("sum").join(seen, ["a", "b"], "left_anti"), components(links))
        links = stored(links.union(self.linked(self.compare(rest, sets, "rest"))), "links")
        return self.wide_links(wide, measured, links, sets)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5,
                       num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: (doc, rid, n_shingles, root, component_id), linked where den * overlap >= num * union.
    `root` names the component also where its ids are null; it is null for a document without shingles."""
    if not 0 < num < den or width < 1:
        raise ValueError("the bound must lie between 0 and 1, and a shingle has at least one word")
    join = _Join(texts(docs, id_col, text_col), width, num, den)
    group = (join.members.where("n > 0").select("doc", "c").join(join.roots().withColumnRenamed("v", "c"), "c", "left")
             .select("doc", "c", F.coalesce("root", "c").alias("root")))
    lowest = group.groupBy("root").agg(F.min("doc").alias("low"))
    named = stored(group.select("c", "root").distinct().join(lowest, "root").select("c", "root", "low"), "named")
    return (join.members.join(named, "c", "left")
            .select("doc", "rid", F.col("n").alias("n_shingles"), F.expr("if(n = 0, null, root)").alias("root"),
                    F.expr("if(n = 0, doc, low)").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, whole and with all its
    columns; documents without shingles all stay. Rows that repeat id and text are one document."""
    found = jaccard_components(docs, id_col, text_col, width=width, num=num, den=den)
    of = F.struct(F.col("root").isNull().alias("alone"), F.coalesce("root", "rid").alias("key"))
    keep = stored(found.groupBy(of.alias("of"))
                  .agg(F.min(F.struct(F.col("doc").isNull().alias("no_id"), F.col("doc"), F.col("rid"))).alias("first"), F.count("*").alias("n"))
                  .select(F.col("first.rid").alias(_KEY), F.col("n").alias(_COUNT)), "kept")
    rows = docs.withColumn(_KEY, F.xxhash64(F.col(id_col), F.col(text_col)))
    # a row can only be there twice in a group of two and more: single ones, and where the list of keys is small all others, stay where they are
    once, more = keep.where(F.col(_COUNT) == 1).select(_KEY), keep.where(F.col(_COUNT) > 1).select(_KEY)
    single = rows.join(small_side(once, 24), _KEY, "left_semi")
    first = rows.join(small_side(more, 24), _KEY, "left_semi").dropDuplicates([_KEY])
    return single.unionByName(first).drop(_KEY)
