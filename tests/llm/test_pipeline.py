"""The stages one after another, each held against the rows it was given."""

import os
import sys

import pytest
from brute import shingle_set

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def kept(spark, data):
    import corpus_pipeline
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    found.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(found[-1], docs.schema) if len(found) > 1 else docs, data)
        found.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return found


def test_names():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_stages(spark, data, kept):
    raw, good, cut, single, clean, tokens = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good}
    lost = [d for d, q in labels.items() if q == 1 and d not in ids]
    assert len(good) < len(raw) and len(lost) <= 0.05 * sum(labels.values())
    assert len(cut) == len(good) and all(r["n_chars"] == len(r["text"]) for r in cut)
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in single}
    alike = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 5 * len(x & y) >= 4 * len(x | y)]
    assert not alike and {r["doc_id"] for r in single} <= {r["doc_id"] for r in cut}
    items = [shingle_set(r["text"], 5, short=False) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    held = {d for d, x in ((r["doc_id"], shingle_set(r["text"], 5, short=False)) for r in single) if any(i and 5 * len(i & x) >= 4 * len(i) for i in items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - held
    assert sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in clean) and len(tokens) > 50


def test_run_ends_with_the_same_rows(spark, data, kept):
    import corpus_pipeline
    assert sorted(corpus_pipeline.run(spark, data).collect()) == sorted(kept[-1])


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_rows(spark, data, empty):
    """Nulls in every column, empty, blank, long and repeated rows, and an empty table, through every stage."""
    import corpus_pipeline
    rows = [(None, "some words that nobody else has written in quite this way", "en", "a", 11), (1, None, None, None, None), (2, "", "en", None, 0),
            (3, " \n\t ", None, "a", 4), (4, "One", "fr", "b", 3), (4, "One", "fr", "b", 3), (5, "word " * 3000, None, "b", None), (6, None, "en", "a", 7)]
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    docs = spark.createDataFrame([r for r in rows if not empty], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.select(*[docs[f.name].cast(f.dataType) for f in schema.fields])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        got = out.collect()
        assert not empty or not got
        if name == "byte-level BPE":
            assert sorted((repr(r["doc_id"]), r["n_tokens"] > 0) for r in got) == sorted((repr(r[0]), bool(r[1])) for r in {r[:2] for r in rows} if not empty)
            break
        assert out.columns == schema.names
        if name == "n-gram Jaccard join" and not empty:
            assert len(got) == len(rows) - 1
        if name != "quality classifier":                        # what the classifier makes of such rows is its own matter
            docs = spark.createDataFrame(got, out.schema)
