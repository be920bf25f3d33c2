"""Suffix-array dedup with sparse suffixes: passages of at least `min_words` words that occur more than once.

A suffix of a text is retained where its first `gram` words have the smallest hash among the grams of some window of
`min_words` words (the leftmost of equal ones). The choice depends on content alone, so two equal windows retain the same
suffix: a passage of `min_words` words always holds a retained one. About one position in (min_words - gram + 2) / 2 is kept.

1. The retained suffixes are sorted by their first words; a suffix equal to no neighbour there is dropped.
2. The others are extended. Every window of `min_words` words belongs to the one retained suffix it was chosen for, so all
   windows that a match could cover around that suffix, left and right, lie in one group. The windows of a group are
   sorted and compared with their neighbours; equal ones are a match, and runs of them are its extent, word by word.
3. Suffixes whose group exceeds `GROUP` rows, as common passages give, are not gathered. Those with equal windows are
   summed to one context first; the windows of the contexts, not of the rows, are grouped and compared, and what repeats
   goes back to the rows through their context.
4. Extents of a document are united into maximal spans.

The result is exact: a word is in a span if and only if it lies in a window of `min_words` words that occurs at two places (in
one document or two). `surplus` spans are the windows whose place is not the first by (id, row key, position): what a
dedup removes so that one copy stays. Ids are ordered as they are, numbers by value and texts by their bytes.

Defined results: null, empty and short texts have no window and no row; null ids come last in the order and keep their
row; rows that repeat id and text are one document; an empty table gives none; other columns are ignored. A text is held
by one task with about 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardatlas.operators.joins import salted_join

from . import words
from .frames import map_arrow, signed, small_side, stored, texts

GRAM = 16
GROUP = 512                     # places of a suffix that are compared inside one task
HOT_ROWS = 1 << 13              # places of a suffix, or of a context, that one task joins
_ROWS = 1 << 14                 # suffixes whose windows are sorted together
_LAST = (1 << 63) - 1


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of `length` words, from running sums."""
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = words._power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return words.mix((sums[length:] - sums[:-length]) * down[:len(hashes) - length + 1])


def retained(hashes: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(suffix position, its gram's hash, first window, end window) of each retained suffix, in order, over the words of
    several texts. Windows first..end-1, by their first word, are those that chose the suffix; none leaves its text."""
    grams, span = words.ngram_hashes(hashes, gram), length - gram + 1
    if len(grams) < span:
        return (np.zeros(0, dtype=np.int64),) * 4
    at, least, width = np.arange(len(grams)), grams, 1
    while 2 * width <= span:                                # least gram of twice as many positions
        left, right = least[:-width], least[width:]
        at = np.where(left <= right, at[:-width], at[width:])
        least, width = np.minimum(left, right), 2 * width
    over = span - width
    left, right = least[:len(least) - over], least[over:]
    at = np.where(left <= right, at[:len(at) - over], at[over:])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(at)]
    inside = np.arange(len(at)) + length <= bounds[text + 1]
    windows = np.flatnonzero(inside)
    chosen = at[windows]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[windows][1:] != text[windows][:-1])))) if len(windows) else windows
    first = windows[new]
    end = np.append(windows[new[1:] - 1], windows[-1:]) + 1 if len(new) else first
    return chosen[new], grams[chosen[new]], first, end


def _suffixes(length: int, gram: int):
    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        rid = np.asarray(batch.column("rid"))
        for lo, _, hashes, bounds in words.word_slices(batch.column("text")):
            at, key, _, _ = retained(hashes, bounds, length, gram)
            text = np.searchsorted(bounds, at, "right") - 1
            yield {"key": pa.array(signed(key)), "rid": pa.array(rid[lo + text]), "pos": pa.array(at - bounds[text])}
    return rows


def _windows(length: int, gram: int):
    """Windows of the suffixes asked for, and of each window its text's place in the order."""
    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        asked, rid, order = batch.column("asked"), np.asarray(batch.column("rid")), np.asarray(batch.column("ord"))
        for lo, hi, hashes, bounds in words.word_slices(batch.column("text")):
            at, key, first, end = retained(hashes, bounds, length, gram)
            text = np.searchsorted(bounds, at, "right") - 1
            mine = asked.slice(lo, hi - lo)
            counts = np.diff(np.asarray(mine.offsets))
            flat = mine.flatten()
            want = np.asarray(flat.field("pos")) + bounds[np.repeat(np.arange(hi - lo), counts)]
            sort = np.argsort(want)
            want, hot = want[sort], np.asarray(flat.field("hot").cast(pa.int8()))[sort]
            place = np.searchsorted(want, at)
            taken = np.flatnonzero((place < len(want)) & (want[np.minimum(place, len(want) - 1)] == at)) if len(want) else np.zeros(0, dtype=np.int64)
            if not len(taken):
                continue
            hashed = signed(window_hashes(hashes, length))
            sizes = (end - first)[taken]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            picked = np.repeat(first[taken] - offsets[:-1], sizes) + np.arange(offsets[-1])
            owner = text[taken]
            yield {"key": pa.array(signed(key[taken])), "rid": pa.array(rid[lo + owner]),
                   "doc": batch.column("doc").take(pa.array(lo + owner)), "ord": pa.array(order[lo + owner]),
                   "first": pa.array(first[taken] - bounds[owner]), "hot": pa.array(hot[place[taken]].astype(bool)),
                   "windows": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashed[picked]))}
    return rows


def _runs(table: pa.Table, row: np.ndarray, pos: np.ndarray, repeated: np.ndarray, surplus: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of consecutive flagged windows of each row as spans of words."""
    out = {"row": [], "start": [], "end": [], "surplus": []}
    for kind, flag in ((False, repeated), (True, surplus)):
        on = np.flatnonzero(flag)
        if len(on):
            cut = np.concatenate(([True], (pos[on][1:] != pos[on][:-1] + 1) | (row[on][1:] != row[on][:-1])))
            stop = np.append(np.flatnonzero(cut)[1:] - 1, len(on) - 1)
            out["row"].append(row[on[cut]])
            out["start"].append(pos[on[cut]])
            out["end"].append(pos[on[stop]] + length)
            out["surplus"].append(np.full(len(stop), kind))
    flat = {k: np.concatenate(v) if v else np.zeros(0, dtype=bool if k == "surplus" else np.int64) for k, v in out.items()}
    take = pa.array(flat["row"])
    column = lambda name: table.column(name).combine_chunks().take(take)
    return pa.RecordBatch.from_pydict({"rid": column("rid"), "doc": column("doc"), "start": pa.array(flat["start"]),
                                       "end": pa.array(flat["end"]), "surplus": pa.array(flat["surplus"])})


def _neighbours(length: int):
    """Sort the windows of whole groups (rows come sorted by key), compare neighbours, emit runs of equal ones."""
    def runs(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        col = lambda name: np.asarray(table.column(name).combine_chunks())
        lists = table.column("windows").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window, key, rid, order = np.asarray(lists.flatten()), col("key")[row], col("rid")[row], col("ord")[row]
        pos = col("first")[row] + within
        by = np.lexsort((pos, rid, order, window, key))
        same = (key[by][1:] == key[by][:-1]) & (window[by][1:] == window[by][:-1])
        copy = same & (rid[by][1:] == rid[by][:-1]) & (pos[by][1:] == pos[by][:-1])     # a repeated row is no second place
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        group = np.cumsum(np.concatenate(([1], ~same))) - 1
        places = np.add.reduceat(np.concatenate(([1], (~copy).astype(np.int64))), start)     # distinct places of a window
        repeated, surplus = np.zeros(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
        repeated[by] = places[group] > 1
        head = np.concatenate(([True], ~same))
        head_of = by[start][group]
        surplus[by] = repeated[by] & ~head & ~((rid[by] == rid[head_of]) & (pos[by] == pos[head_of]))
        return _runs(table, row, pos, repeated, surplus, length)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _ROWS:
                continue
            table = pa.Table.from_batches(held)
            keys = np.concatenate([np.asarray(b.column("key")) for b in held])
            cut = int(np.searchsorted(keys, keys[-1], "left"))          # the last group may go on in the next batch
            if cut:
                yield runs(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield runs(pa.Table.from_batches(held))
    return task


def _unite():
    def merge(batch: pa.RecordBatch) -> Iterator[dict]:
        found: dict[str, list] = {"repeats": [], "surplus": []}
        for spans in batch.column("spans"):
            flat = spans.values
            start, end = np.asarray(flat.field("start")), np.asarray(flat.field("end"))
            kind = np.asarray(flat.field("surplus").cast(pa.int8())).astype(bool)
            for name, on in (("repeats", ~kind), ("surplus", kind)):
                s, e = start[on], end[on]
                by = np.argsort(s, kind="stable")
                s, far = s[by], np.maximum.accumulate(e[by]) if len(s) else e
                cut = np.flatnonzero(s[1:] > far[:-1]) + 1
                found[name].append([{"start": int(x), "end": int(y)} for x, y in
                                    zip(s[np.concatenate(([0], cut))] if len(s) else [], far[np.append(cut - 1, len(far) - 1)] if len(s) else [])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield {"doc": batch.column("doc"), "rid": batch.column("rid"),
               **{name: pa.array(x, type=kind) for name, x in found.items()}}
    return merge


def _through_contexts(rows: DataFrame, length: int, schema: str) -> DataFrame:
    """Spans of suffixes that occur very often (step 3 of the module text)."""
    place = lambda pos: F.struct("ord", "rid", pos.alias("pos"))
    rows = rows.withColumn("context", F.xxhash64("key", "windows"))
    contexts = rows.groupBy("context").agg(F.first("windows").alias("windows"), F.min(place(F.col("first"))).alias("lo"), F.max(place(F.col("first"))).alias("hi"))
    each = stored(contexts.select("context", "lo", "hi", F.posexplode("windows").alias("i", "window")), "contexts")
    moved = lambda p: F.struct(F.col(p)["ord"].alias("ord"), F.col(p)["rid"].alias("rid"), (F.col(p)["pos"] + F.col("i")).alias("pos"))
    repeated = (each.groupBy("window").agg(F.min(moved("lo")).alias("keep"), F.max(moved("hi")).alias("last"))
                .where("keep <> last").select("window", "keep"))
    flags = each.join(repeated, "window").groupBy("context").agg(F.sort_array(F.collect_list(F.struct("i", "keep"))).alias("flags"))

    def spans(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = batch.column("flags")
        sizes = np.diff(np.asarray(lists.offsets))
        row, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
        keep = flat.field("keep")
        col = lambda name: np.asarray(batch.column(name))[row]
        pos = col("first") + np.asarray(flat.field("i"))
        kept = (np.asarray(keep.field("ord")) == col("ord")) & (np.asarray(keep.field("rid")) == col("rid")) & (np.asarray(keep.field("pos")) == pos)
        found = _runs(pa.Table.from_batches([batch]), row, pos, np.ones(len(row), dtype=bool), ~kept, length)
        yield {name: found.column(name) for name in found.schema.names}

    return map_arrow(salted_join(rows.select("context", "rid", "doc", "ord", "first"), flags, ["context"], HOT_ROWS), spans, schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order of ids, `ord`: a number is its own place, other ids are numbered by range."""
    kind = rows.schema["doc"].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return rows.withColumn("ord", F.coalesce(F.col("doc").cast("bigint"), F.lit(_LAST)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("rid", "doc").dropDuplicates(["rid"])
    by = [F.col("doc").asc_nulls_last(), F.col("rid")]
    places = stored(ids.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("rid", F.monotonically_increasing_id().alias("ord")), "order of ids")
    return rows.join(places, "rid")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, gram: int = GRAM) -> DataFrame:
    """One row per document with a repeated passage: (doc, rid, repeats, surplus), arrays of (start, end) in words."""
    if not 0 < gram <= min_words:
        raise ValueError("a gram has at least one word and fits into the shortest passage")
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc"].dataType.simpleString()
    suffixes = map_arrow(rows.select("rid", "text"), _suffixes(min_words, gram), "key bigint, rid bigint, pos bigint")
    shared = (suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("r0"), F.max("rid").alias("r1"),
                                          F.min("pos").alias("p0"), F.max("pos").alias("p1"))
              .where("n > 1 and (r0 <> r1 or p0 <> p1)").select("key", "n"))
    shared = stored(shared, "shared")
    # a key with very many places is split: its places take one of several salts, the key is there once a salt
    salts = F.expr(f"cast(1 + n div {HOT_ROWS} as int)")
    hot = small_side(shared.where(F.col("n") > HOT_ROWS).select("key", salts.alias("salts")), 32)
    salted = suffixes.join(hot, "key", "left").select("key", "rid", "pos", F.pmod(F.xxhash64("rid", "pos"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    each = shared.select("key", (F.col("n") > GROUP).alias("hot"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    asked = salted.join(each, ["key", "salt"]).groupBy("rid").agg(F.collect_set(F.struct("pos", "hot")).alias("asked"))
    members = _ordered(rows.join(stored(asked, "asked"), "rid")).select("rid", "doc", "ord", "text", "asked")
    windows = stored(map_arrow(members, _windows(min_words, gram),
                               f"key bigint, rid bigint, doc {kind}, ord bigint, first bigint, hot boolean, windows array<bigint>"), "windows")
    schema = f"rid bigint, doc {kind}, start bigint, end bigint, surplus boolean"
    few = (windows.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_neighbours(min_words), schema))
    spans_of_hot = _through_contexts(windows.where("hot"), min_words, schema)
    spans = few.union(spans_of_hot)
    grouped = spans.groupBy("rid", "doc").agg(F.collect_set(F.struct("start", "end", "surplus")).alias("spans"))
    span = "array<struct<start:bigint,end:bigint>>"
    return map_arrow(grouped, _unite(), f"doc {kind}, rid bigint, repeats {span}, surplus {span}")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, gram: int = GRAM) -> DataFrame:
    """The documents with all columns, their surplus passages cut out; the words that stay are joined by single spaces
    where a text lost something, and a text that lost nothing is unchanged."""
    found = (repeated_passages(docs, id_col, text_col, min_words=min_words, gram=gram).where("size(surplus) > 0")
             .select(F.col("rid").alias(_KEY), F.col("surplus").alias(_CUTS)))
    pieces = F.split(F.trim(F.regexp_replace(text_col, "[\\x20\\x09-\\x0D]+", " ")), " ")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(_CUTS, lambda c: c["end"]))        # spans are in order and apart
    starts = F.concat(F.transform(_CUTS, lambda c: c["start"]), F.array(F.size(pieces).cast("bigint")))
    kept = F.array_join(F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(pieces, (e + 1).cast("int"), (s - e).cast("int")))), " ")
    keyed = docs.withColumn(_KEY, F.xxhash64(F.col(id_col), F.col(text_col))).join(found, _KEY, "left")
    return keyed.withColumn(text_col, F.when(F.col(_CUTS).isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)


_KEY, _CUTS = "wardatlas row key", "wardatlas cuts"
