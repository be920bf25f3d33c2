"""Quality classifier: naive Bayes support vectors on character n-gram indicators.

Features are the distinct runs of 1 to 4 bytes of a text, A-Z as a-z and digits as 0, hashed to `BUCKETS`, and the word runs "a word
twice" and "a word three times" in a row, whatever the word. From all labelled rows come
smoothed counts p and q of texts of class 1 and 0 with each feature; r = log((p / |p|) / (q / |q|)) is its log-count ratio.
Each text's indicators, scaled by r and to unit length, enter a linear model with squared hinge loss that is fitted by dual coordinate
descent; both classes weigh the same. The dual variables of a text are updated one at a time in a fixed order that is shuffled by hash.

The ratios are counted over all labelled rows. The fit itself uses a bounded sample of them: at most `max_rows` rows
(a parameter), those with the smallest content hashes, in one task. The score is 1 / (1 + exp(-2 * margin)).

Defined results: null and empty texts have no features and are scored by the bias alone; rows without a label of 0 or 1 take
no part in learning; with one class only, every score is that class (0 or 1), and 0.5 without any labelled row, as for an empty table; every row
gives one row, so repeated rows give equal rows, and count as often as they stand when learnt; other columns are ignored by scores and passed by the filter. A text is read in pieces, so memory does not follow its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .frames import keep_where, map_arrow

BUCKETS = 1 << 16
RUNS = (1, 2, 3, 4)
MAX_ROWS = 6000
_PIECE = 1 << 16
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def features(data: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct feature numbers of one text."""
    on = np.zeros(buckets, dtype=bool)                          # the last two are for the word runs
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for start in range(0, len(data), _PIECE):
        piece = _FOLD[data[start:start + _PIECE + RUNS[-1] - 1]]
        code = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, RUNS[-1] + 1):
            if len(piece) < n:
                break
            code = (code[:len(piece) - n + 1] << np.uint32(8)) | piece[n - 1:]
            if n in RUNS:
                on[((code + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> shift] = True
    spelled = words.hash_bytes(data)
    again = spelled[1:] == spelled[:-1]
    on[buckets - 2:] = again.any(), (again[1:] & again[:-1]).any()
    return np.flatnonzero(on)


def _feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, bounds = words.text_buffer(column)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield features(data[start:end])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for label, found in zip(batch.column("label").to_pylist(), _feature_sets(batch.column("text"))):
            total[label, found] += 1
            rows[label] += 1
    used = np.flatnonzero(total.any(axis=0))
    if rows.any():
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(used, -1)), "one": pa.array(np.append(total[1, used], rows[1])),
                                          "zero": pa.array(np.append(total[0, used], rows[0]))})


def dual_coordinate_descent(rows: list[tuple[np.ndarray, float]], labels: np.ndarray, scale: np.ndarray, cost: float = 4.0,
                            rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights w, the last one the bias, of min |w|^2 / 2 + sum of cost_i * max(0, 1 - y_i w x_i)^2; x_i = scale[rows_i] * length_i."""
    y = np.where(labels == 1, 1.0, -1.0)
    weight = cost * len(y) / (2.0 * np.maximum(np.where(y > 0, (y > 0).sum(), (y < 0).sum()), 1))
    soft = 0.5 / weight                                         # the squared loss adds it to the diagonal
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(y))
    for round_ in range(rounds):
        worst = 0.0
        for i in np.argsort(words.mix(np.arange(len(y), dtype=np.uint64) + np.uint64(round_ << 32))):
            at, length = rows[i]
            x = scale[at] * length
            slope = y[i] * (w[at] @ x + w[-1]) - 1 + soft[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            new = max(alpha[i] - slope / (float(x @ x) + 1 + soft[i]), 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def _length(scale: np.ndarray, found: np.ndarray) -> float:
    norm = float(np.sqrt((scale[found] ** 2).sum()))
    return 1 / norm if norm > 0 else 0.0


def _sample(rows: DataFrame, label: int, there: int, take: int) -> DataFrame:
    """At most `take` of a class's rows, by hash of the text; only about as many leave their tasks."""
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    near = rows.where((F.col("label") == label) & (place <= int((1 << 30) * min(1.0, take / there))))
    return near.withColumn("h", place).orderBy("h", "text").limit(take).select("label", "text")


class Model:
    """Ratios and weights; `fixed` is the score of every text where one class or none was seen."""

    def __init__(self, scale: np.ndarray, w: np.ndarray, fixed: float | None = None):
        self.scale, self.w, self.fixed = scale, w, fixed

    def score(self, found: np.ndarray) -> float:
        if self.fixed is not None:
            return self.fixed
        margin = float(self.w[found] @ self.scale[found]) * _length(self.scale, found) + float(self.w[-1])
        return float(1 / (1 + np.exp(-2 * np.clip(margin, -300, 300))))


def learn(labelled: DataFrame, label_col: str = "quality", text_col: str = "text", *, max_rows: int = MAX_ROWS) -> Model:
    """The model of all rows whose label is 0 or 1; the fit sees at most `max_rows` of them."""
    rows = labelled.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text")).where("label in (0, 1)")
    parts = rows.mapInArrow(_class_counts, "f bigint, one bigint, zero bigint")
    table = parts.groupBy("f").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).toArrow()
    f, one, zero = (np.asarray(table.column(c).to_numpy()) for c in ("f", "one", "zero"))
    seen = f >= 0
    n1, n0 = int(one[~seen].sum()), int(zero[~seen].sum())
    scale = np.zeros(BUCKETS)
    if not n1 or not n0:
        return Model(scale, np.zeros(BUCKETS + 1), 0.5 if n1 == n0 else float(n1 > 0))
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    p[f[seen]] += one[seen]
    q[f[seen]] += zero[seen]
    scale = np.log((p / p.sum()) / (q / q.sum()))
    scale[(p == 1) & (q == 1)] = 0
    # half of the sample for each class, so that a rare one is well covered; the unused part goes to the other
    take1 = min(n1, max(max_rows // 2, max_rows - n0))
    sample = _sample(rows, 1, n1, take1).union(_sample(rows, 0, n0, min(n0, max_rows - take1)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            for label, found in zip(batch.column("label").to_pylist(), _feature_sets(batch.column("text"))):
                xs.append((found.astype(np.int32), _length(scale, found)))
                ys.append(label)
        yield pa.RecordBatch.from_pydict({"w": pa.array([dual_coordinate_descent(xs, np.array(ys), scale).tolist()], type=pa.list_(pa.float64()))})

    w = sample.coalesce(1).mapInArrow(fit, "w array<double>").first()[0]
    return Model(scale, np.array(w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def scored(batch: pa.RecordBatch) -> Iterator[dict]:
        found = np.array([held.value.score(x) for x in _feature_sets(batch.column("text"))])
        yield {"doc": batch.column("doc"), "score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}

    return map_arrow(rows, scored, f"doc {rows.schema['doc'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, with all columns, whose score is at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, text_col, lambda column: [held.value.score(x) >= least for x in _feature_sets(column)])
