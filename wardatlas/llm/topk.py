"""Exact top-k inner products by norm-bucketed retrieval with local cosine thresholds.

Each task sorts its vectors by length and cuts them into buckets of `BUCKET`. For a query q with k-th best score t so far,
a vector p of a bucket whose longest vector has length l can only matter if cos(q, p) >= t / (|q| l), the local threshold:

* above 1, no vector of the bucket can reach t (nor any of the later, shorter buckets): length pruning of the bucket;
* below `COORDINATE_FROM`, length pruning inside the bucket: only p with |p| >= t / |q| are verified;
* otherwise coordinate pruning: with c the cosine bound and f the largest coordinate of q / |q|, the same coordinate of p / |p|
  must lie within q_f c -/+ sqrt((1 - c^2)(1 - q_f^2)).

What remains is verified by the integer product. The first t of every query comes from the longest vectors of the whole
table, so pruning starts at once; it is a true score, hence safe. Each task gives its own k best of each query, and
those that can still matter meet in one ranking by query. Queries go to the tasks in blocks of at most `QUERIES`.

Products are exact whatever the components: whole numbers are held as doubles, which all of them are after scaling. Where lengths
allow products beyond 2^62, a bucket's products in floating point and their error bound choose the pairs that Python's whole numbers
then settle.

Defined results: vectors that are null or hold a null or non-finite component (before or after scaling) take no part, nor do rows with a
null id; vectors of unequal length are compared as if the shorter, or an empty one, went on with zeros; rows that repeat id and vector are
one row; other rows of one id are rows of their own, and never candidates for each other; ties go to the smaller id; an empty table, or
one without queries, gives none; other columns are ignored. Scores beyond 64 bits are ranked exactly and returned as the nearest bigint.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

QUERIES = 2048                  # queries in a block; with the dimension this bounds the broadcast
BUCKET = 256
HELD = 1 << 15                  # vectors that a task holds and ranks together, and
HELD_BYTES = 1 << 25            # bytes of these
COORDINATE_FROM = 0.5
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~bad


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    lengths = np.diff(offsets)
    if len(lengths) and dim and (lengths == dim).all():
        return flat[offsets[0]:offsets[-1]].reshape(len(lengths), dim)
    out = np.zeros((len(lengths), max(dim, 1)))
    for i, (start, n) in enumerate(zip(offsets[:-1].tolist(), lengths.tolist())):
        out[i, :min(n, dim)] = flat[start:start + min(n, dim)]      # beyond every query's length a product is zero
    return out


class _Queries:
    def __init__(self, ids: np.ndarray, vecs: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vecs, self.floor, self.k = ids, vecs, floor, k
        self.norms = _norms(vecs)
        unit = vecs / np.maximum(self.norms, 1e-300)[:, None]
        self.focus = np.abs(unit).argmax(axis=1)
        self.at_focus = unit[np.arange(len(ids)), self.focus] if len(ids) else np.zeros(0)

    def best(self, ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, candidate number, score) of each query's k best among these vectors, where above its floor."""
        norms = _norms(vecs)
        order = np.argsort(-norms, kind="stable")
        ids, vecs, norms = ids[order], vecs[order], norms[order]
        top = self.norms.max(initial=0) * norms.max(initial=0)
        if not top <= 2.0 ** 62:
            return self._best_of_large(ids, vecs, norms)
        kind = np.float64 if top < _EXACT else np.int64
        left, right = self.vecs.astype(kind), vecs.astype(kind)
        unit = vecs / np.maximum(norms, 1e-300)[:, None]
        bar = self.floor.copy()                                         # a score below it cannot be among the k best
        have = [np.zeros(0, dtype=np.int64)] * 3
        for start in range(0, len(ids), BUCKET):
            end = min(len(ids), start + BUCKET)
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(bar > 0, bar / (self.norms * norms[start]), -1.0)
            open_ = np.flatnonzero(~(local > 1 + 1e-9))                 # a zero vector has products 0: never above a bar > 0
            if not len(open_):
                break
            reach = bar[open_, None] <= self.norms[open_, None] * norms[None, start:end] * (1 + 1e-9)
            tight = np.flatnonzero(local[open_] >= COORDINATE_FROM)
            if len(tight):
                q = open_[tight]
                c, f = np.minimum(local[q], 1.0)[:, None], self.at_focus[q][:, None]
                slack = np.sqrt(np.maximum(0, (1 - c * c) * (1 - f * f))) + 1e-9
                reach[tight] &= np.abs(unit[start:end].T[self.focus[q]] - f * c) <= slack + np.maximum(0, np.abs(f) * (1 - c))
            reach &= self.ids[open_, None] != ids[None, start:end]
            rows = reach.any(axis=1)
            if not rows.any():
                continue
            open_, reach = open_[rows], reach[rows]
            scores = (left[open_] @ right[start:end].T).astype(np.int64)
            qi, pi = np.nonzero(reach & (scores >= bar[open_, None]))
            have = [np.concatenate((x, y)) for x, y in zip(have, (open_[qi], pi + start, scores[qi, pi]))]
            place = np.lexsort((ids[have[1]], -have[2], have[0]))
            have = [x[place] for x in have]
            begins = np.searchsorted(have[0], np.arange(len(self.ids)))
            rank = np.arange(len(place)) - begins[have[0]]
            kth = rank == self.k - 1
            bar[have[0][kth]] = np.maximum(bar[have[0][kth]], have[2][kth])
            have = [x[rank < self.k] for x in have]
        return have[0], ids[have[1]], have[2]

    def _best_of_large(self, ids: np.ndarray, vecs: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same where products may not fit 64 bits; vectors come longest first. Scores are Python's whole numbers."""
        whole: dict[int, list[int]] = {}
        asked = [[int(x) for x in q] for q in self.vecs]
        best: list[list[tuple[int, int]]] = [[] for _ in asked]             # (-score, id), best first
        gap = 4 * (vecs.shape[1] + 1) * 2.0 ** -53
        with np.errstate(all="ignore"):
            bar = self.floor.copy()
            for start in range(0, len(ids), BUCKET):
                end = min(len(ids), start + BUCKET)
                reach = self.norms[:, None] * norms[None, start:end]
                near = self.vecs @ vecs[start:end].T
                slack = gap * reach + np.abs(near) * 2.0 ** -52
                far = (near + slack < bar[:, None]) | (reach * (1 + 1e-9) < bar[:, None])
                take = ~far & (self.ids[:, None] != ids[None, start:end])
                for q, p in zip(*(x.tolist() for x in np.nonzero(take))):
                    p += start
                    if p not in whole:
                        whole[p] = [int(x) for x in vecs[p]]
                    row, mine = (-sum(x * y for x, y in zip(asked[q], whole[p])), int(ids[p])), best[q]
                    if len(mine) < self.k or row < mine[-1]:
                        insort(mine, row)
                        del mine[self.k:]
                        if len(mine) == self.k:
                            bar[q] = max(bar[q], _below(-mine[-1][0]))
                whole.clear()
        flat = [(q, key, -score) for q, mine in enumerate(best) for score, key in mine]
        scores = np.empty(len(flat), dtype=object)
        scores[:] = [r[2] for r in flat]
        return np.array([r[0] for r in flat], dtype=np.int64), np.array([r[1] for r in flat], dtype=np.int64), scores


def _norms(vecs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vecs ** 2).sum(axis=1))


def _below(score: int) -> float:
    """A double not above a whole number."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return float(np.finfo(np.float64).max) if score > 0 else -np.inf


def _sortable(score: int) -> str | None:
    """A text that orders scores beyond 64 bits, all of one sign, as the scores; none for others."""
    if abs(score) <= _MOST:
        return None
    digits = str(abs(score))
    text = f"{len(digits):09d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def scaled(table: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v) with v = floor(scale * component), whole numbers as doubles; unusable vectors are left out, repeated rows count once."""
    times = F.transform(F.col("v"), lambda x: F.lit(float(scale)) * x.cast("double"))
    whole = F.transform(F.col("v"), lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x))    # larger doubles are whole
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("id is not null").where(usable(F.col("v")))
    return rows.select("id", times.alias("v")).where(usable(F.col("v"))).select("id", whole.alias("v")).distinct()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best products among `vectors`, both given as (id, v array<double>), whole numbers."""
    spark = vectors.sparkSession
    total, dim = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    result = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = vectors.orderBy(square.desc(), "id").limit(4 * BUCKET).toArrow() if total else None
    blocks = -(-total // QUERIES)
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).orderBy("id", "v").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        column = lambda t, name: t.column(name).combine_chunks()
        ids, vecs = np.asarray(column(mine, "id")), _matrix(column(mine, "v"), dim)
        first = _Queries(ids, vecs, np.full(len(ids), -np.inf), k)
        of, _, score = first.best(np.asarray(column(longest, "id")), _matrix(column(longest, "v"), dim))
        floor = np.full(len(ids), -np.inf)
        full = np.bincount(of, minlength=len(ids)) >= k
        low: dict[int, int] = {}
        for q, s in zip(of.tolist(), score.tolist()):
            low[q] = min(low.get(q, s), s)
        floor[full] = [_below(low[q]) for q in np.flatnonzero(full).tolist()]
        held = spark.sparkContext.broadcast(_Queries(ids, vecs, floor, k))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            for piece in _pieces(batches):
                of, cand, score = q.best(np.asarray(piece.column("id")), _matrix(piece.column("v"), dim))
                wide = [_sortable(s) for s in score] if score.dtype == object else [None] * len(score)
                small = [max(-_MOST, min(_MOST, s)) for s in score] if score.dtype == object else score
                yield pa.RecordBatch.from_pydict({"q": of, "query_id": q.ids[of], "vec_id": cand, "score": pa.array(small, type=pa.int64()),
                                                  "wide": pa.array(wide, type=pa.string())})

        near = vectors.mapInArrow(search, "q bigint, query_id bigint, vec_id bigint, score bigint, wide string")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
        result = result.union(near.withColumn("rank", place).where(F.col("rank") <= k)
                              .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    return result


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about HELD rows or HELD_BYTES, so that a task ranks few times."""
    kept, n, size = [], 0, 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n >= HELD or size >= HELD_BYTES:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def top_k_of_table(table: DataFrame, id_col: str, vec_col: str, is_query: Column, *, scale: float = 256.0, k: int = 5) -> DataFrame:
    """Exact top k inside one table; `is_query` is a condition on the column `id`."""
    vectors = stored(scaled(table, id_col, vec_col, scale), "vectors")
    return top_k(vectors, vectors.where(is_query), k)
