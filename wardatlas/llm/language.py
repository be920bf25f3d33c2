"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from the letter's code point alone. The vector of a run of n letters is
the product (binding) of its letters' vectors, each rotated by its place (permutation); a text is the sum (bundling) of the
vectors of all its runs, and a language's prototype the sum of its texts, each scaled to unit length in whole thousandths so that
task order cannot change it. A text gets the language whose prototype has the largest cosine, prototypes and texts taken
relative to the mean prototype direction removed. Words are padded by a space, so their beginnings and ends count.

Learning is one pass with one partial sum per task and language; prediction one pass. The prototypes are bounded: languages
x `DIMENSION` numbers. A task works on `_CHARS` characters at a time and at most `_RUNS` different runs, whatever the texts.

Defined results: a null text or one without a letter is "und" with score 0; texts without a label take no part in learning;
with no labelled text at all everything is "und"; more than `LANGUAGES` different labels are an error; equal cosines go to the name that sorts first; every row
gives one row, so repeated rows give equal rows and count as often as they stand when learnt; an empty table learns nothing and gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .frames import map_arrow

DIMENSION = 1024
RUN = 3
_CHARS = 1 << 18
_RUNS = 1 << 12
_UNIT = 1000
LANGUAGES = 1000                # labels at most; their prototypes are broadcast


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(points: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """+1/-1 rows, one per code point, from a hash of point and place."""
    cells = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(-(-dimension // 64), dtype=np.uint64)[None, :] + np.uint64(1)
    bits = np.unpackbits(words.mix(cells).view(np.uint8), axis=1)[:, :dimension]
    return bits.astype(np.int8) * 2 - 1


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, everything but letters as single spaces, a space before and after; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = points[keep]
    return np.concatenate(([32], kept, [32] if kept[-1] != 32 else [])).astype(np.uint32)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them; by counting where the values are small."""
    if int(values.max()) >= 1 << 21:
        return np.unique(values, return_inverse=True)
    met = np.bincount(values) > 0
    return np.flatnonzero(met), (np.cumsum(met) - 1)[values]


def bundles(codes: list[np.ndarray], dimension: int = DIMENSION) -> np.ndarray:
    """The bundled vector of each text: counts of runs times the bound vectors of the runs, some thousand runs at a time."""
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((len(codes), dimension), dtype=np.float64)
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, dtype=np.uint32)
    if len(flat) < RUN:
        return out
    alphabet, dense = _ranked(flat)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(codes)), sizes)
    starts = np.arange(len(flat) - RUN + 1)
    starts = starts[starts + RUN <= ends[text[:len(starts)]]]
    run = np.zeros(len(starts), dtype=np.int64)
    for j in range(RUN):
        run = run * len(alphabet) + dense[starts + j]
    runs, at = _ranked(run)
    vectors = letter_vectors(alphabet, dimension)
    for first in range(0, len(runs), _RUNS):
        mine, inside = runs[first:first + _RUNS], (at >= first) & (at < first + _RUNS)
        cell = text[starts[inside]] * len(mine) + at[inside] - first
        counts = np.bincount(cell, minlength=len(codes) * len(mine)).reshape(len(codes), len(mine)).astype(np.float32)
        bound, rest = None, mine
        for j in range(RUN):                                    # last letter first; a letter's vector is rotated by its distance from the end
            turned = np.roll(vectors[rest % len(alphabet)], j, axis=1)
            bound, rest = turned if bound is None else bound * turned, rest // len(alphabet)
        out += counts @ bound.astype(np.float32)
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, code points of the next texts), about _CHARS code points together; a longer text comes alone."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        codes = _codes(value.as_py() or "")
        if held and size + len(codes) > _CHARS:
            yield first, held
            first, held, size = i, [], 0
        held.append(codes)
        size += len(codes)
    if held:
        yield first, held


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=-1, keepdims=True)), 1e-300)


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Prototype of each language, from all rows with a text and a label."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    if labelled.select(lang_col).where(F.col(lang_col).isNotNull()).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different languages")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, codes in _chunks(batch.column("text")):
                scaled = np.rint(_unit(bundles(codes, dimension)) * _UNIT * np.sqrt(dimension)).astype(np.int64)
                for lang in sorted(set(names[first:first + len(codes)])):
                    mine = [i for i in range(len(codes)) if names[first + i] == lang]
                    total[lang] = total.get(lang, 0) + scaled[mine].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": pa.array([x.tolist() for x in total.values()], type=pa.list_(pa.int64()))})

    partial = rows.mapInArrow(sums, "lang string, v array<bigint>")
    cells = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    table = cells.toArrow()
    out: dict[str, np.ndarray] = {}
    for lang, i, x in zip(*(table.column(c).to_pylist() for c in ("lang", "i", "x"))):
        out.setdefault(lang, np.zeros(dimension))[i] = x
    return {lang: out[lang] for lang in sorted(out) if out[lang].any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score) of every row; score is the cosine, from 0 to 1."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    names = list(prototypes)
    units = _unit(np.array([prototypes[n] for n in names])) if names else np.zeros((0, DIMENSION))
    mean = _unit(units.mean(axis=0)) if len(names) > 1 else np.zeros(units.shape[1])
    away = _unit(units - (units @ mean)[:, None] * mean) if names else units
    held = docs.sparkSession.sparkContext.broadcast((names, mean, away))

    def nearest(batch: pa.RecordBatch) -> Iterator[dict]:
        langs, mean, away = held.value
        for first, codes in _chunks(batch.column("text")):
            vectors = _unit(bundles(codes, away.shape[1]))
            own = vectors - (vectors @ mean)[:, None] * mean
            cosines = np.round(_unit(own) @ away.T, 9)
            some = np.array([len(c) > 0 for c in codes]) & bool(langs)
            best = cosines.argmax(axis=1) if langs else np.zeros(len(codes), dtype=int)
            pred = [langs[b] if s else "und" for b, s in zip(best, some)]
            score = np.where(some, np.clip(cosines[np.arange(len(codes)), best], 0, 1), 0.0) if langs else np.zeros(len(codes))
            yield {"doc": batch.column("doc").slice(first, len(codes)), "lang_pred": pa.array(pred, type=pa.string()), "score": pa.array(score)}

    return map_arrow(rows, nearest, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves the remainder `fold`; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
