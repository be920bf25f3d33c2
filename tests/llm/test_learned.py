"""Learned operators: held-out accuracy and defined results on awkward rows."""

import numpy as np
import pytest
from brute import SCHEMA, awkward
from pyspark.sql import functions as F

from wardatlas.llm import language, quality


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_letters_have_near_orthogonal_vectors():
    v = language.letter_vectors(np.arange(97, 123)).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    assert np.abs(np.triu(v @ v.T, 1)).max() < 0.2 * v.shape[1]


def test_bundle_is_the_sum_of_bound_runs():
    vec = {c: language.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in "ab "}
    run = lambda s: np.roll(vec[s[0]], 2) * np.roll(vec[s[1]], 1) * vec[s[2]]
    want = run(" ab") + run("ab ") + run("b a") + run(" a ")
    got = language.bundles([language._codes("AB, a!"), language._codes("..")])
    assert (got[0] == want).all() and not got[1].any()


def test_languages_held_out(spark, docs):
    out = language.held_out("doc_id", 5, 0)
    found = language.predict(docs, language.learn(docs.where(~out))).join(docs.withColumnRenamed("doc_id", "doc"), "doc")
    right, n = found.where(language.held_out("doc", 5, 0)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95


def test_languages_of_awkward_rows(spark):
    rows = [(20, "the and of the and of the", "en", None, None), (21, "der die das und der", "de", None, None), (22, "123 456", None, None, None)]
    df = awkward(spark, rows)
    known = language.learn(df.where("doc_id in (20, 21)"))
    got = {(r["doc"]): (r["lang_pred"], r["score"]) for r in language.predict(df, known).collect()}
    assert got[1] == got[2] == got[3] == got[22] == ("und", 0.0)
    assert got[20][0] == "en" and got[21][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(df, known).count() == df.count()
    assert language.learn(df.limit(0)) == {}
    assert {r["lang_pred"] for r in language.predict(df, {}).collect()} == {"und"}
    assert language.predict(df.limit(0), known).count() == 0


def test_quality_held_out(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    both = docs.join(labels, "doc_id")
    out = language.held_out("doc_id", 3, 1)
    model = quality.learn(both.where(~out))
    rows = quality.score(both, model).join(both.select(F.col("doc_id").alias("doc"), "quality"), "doc").where(language.held_out("doc", 3, 1)).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9 and all((r["score"] >= 0.5) == bool(r["predicted"]) for r in rows)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(200):
        k = int(rng.integers(2))
        f = np.unique(np.concatenate([rng.integers(10 * k, 10 * k + 10, 4), rng.integers(20, 40, 3)]))
        rows.append((f, 1 / np.sqrt(len(f))))
        y.append(k)
    w = quality.dual_coordinate_descent(rows, np.array(y), np.ones(40))
    assert all(((w[f].sum() * s + w[-1]) > 0) == bool(k) for (f, s), k in zip(rows, y))


def test_quality_of_awkward_rows(spark):
    df = awkward(spark)
    label = lambda c: df.withColumn("quality", F.expr(c))
    for text, want in (("cast(null as int)", 0.5), ("1", 1.0), ("0", 0.0)):
        model = quality.learn(label(text))
        assert {r["score"] for r in quality.score(df, model).collect()} == {want}
    rows = [(i, "good text here " * 3 if i % 2 else "### $$$ ###", None, None, None) for i in range(30, 50)]
    more = awkward(spark, rows)
    model = quality.learn(more.where("doc_id >= 30").withColumn("quality", (F.col("doc_id") % 2).cast("int")), max_rows=12)
    got = {r["doc"]: r["score"] for r in quality.score(more, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(30, 50)) and 0 <= got[2] <= 1 and got[1] == got[2]
    kept = quality.keep_good(more, model)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect()} >= {31, 33}
    assert quality.score(more.limit(0), model).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(("abc def " * 300 + "xyz xyz xyz").encode(), dtype=np.uint8)
    whole = quality.features(data)
    monkeypatch.setattr(quality, "_PIECE", 50)
    assert (quality.features(data) == whole).all()
    assert {quality.BUCKETS - 1, quality.BUCKETS - 2} <= set(whole) and not len(quality.features(data[:0]))
    assert SCHEMA.startswith("doc_id")
