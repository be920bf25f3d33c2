"""Near copies, repeated passages and benchmark search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from brute import SCHEMA, awkward, components, passages, prose, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st

from wardatlas.llm import decontaminate, jaccard, suffixes, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabABé日,", max_size=40)), max_size=8), st.integers(1, 5))
def test_word_hashes_follow_the_words(texts, width):
    seen = {}
    column = pa.array(texts, type=pa.string())
    got = [s for lo, hi, h, b in words.word_slices(column) for s in words.shingles(h, b, width)]
    assert len(got) == len(texts)
    for text, found in zip(texts, got):
        want = shingle_set(text, width)
        assert len(found) == len(want)
        assert seen.setdefault(frozenset(want), tuple(found.tolist())) == tuple(found.tolist())


def test_long_text_is_hashed_in_slices(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000)) + " " + "x" * 9000
    whole = words.hash_bytes(np.frombuffer(text.encode(), dtype=np.uint8))
    monkeypatch.setattr(words, "SLICE", 64)
    assert (words.hash_bytes(np.frombuffer(text.encode(), dtype=np.uint8)) == whole).all() and len(whole) == 5001


def near_copies(rng):
    """Groups of copies from two to many with a few changed words, and others that share a passage only."""
    texts, common = [], prose(rng, 30)
    for size in (2, 3, 9, 40):
        base = prose(rng, 120).split()
        for k in range(size):
            w = list(base)
            for i in rng.integers(0, len(w), k % 5):
                w[i] = f"new{rng.integers(50)}"
            texts.append(" ".join(w))
    texts += [f"{prose(rng, 60)} {common} {prose(rng, 20)}" for _ in range(30)]
    return texts + [texts[0].upper(), texts[1].replace(" ", "\n\n"), "a b c", "a b c d", "A b C"]


@pytest.mark.parametrize("block", [64, 4])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(np.random.default_rng(block))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc"]: (r["component_id"], r["n_shingles"]) for r in jaccard.jaccard_components(df, width=4, num=85, den=100).collect()}
    low, sizes = components(texts, 4, 85, 100)
    assert got == {i: (low[i], sizes[i]) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(df, width=4, num=85, den=100).collect())
    assert kept == sorted(set(low))


def test_variants_that_do_not_link_are_not_compared_on_whole_sets(spark, monkeypatch):
    """Variants of one text around the bound: of the pairs of a large column hardly more are compared than link."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng, compared, compare = np.random.default_rng(5), [], jaccard._Join.compare

    def counted(self, pairs, sets, name, *more, **named):
        found = compare(self, pairs, sets, name, *more, **named)
        compared.extend([found] if name == "compared" else [])
        return found

    monkeypatch.setattr(jaccard._Join, "compare", counted)
    base, texts = prose(rng, 150).split(), []
    for k in range(160):
        w = list(base)
        for i in rng.integers(0, len(w), 1 + k % 5):
            w[i] = f"new{rng.integers(400)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 5, 4, 5)[0]
    links = sum(x.where("9 * both >= 4 * (na + nb)").count() for x in compared)
    assert sum(x.count() for x in compared) <= 2 * links + 50


def test_join_of_awkward_rows(spark):
    df = awkward(spark, [(9, "some words here", None, None, None)])
    got = sorted(((r["doc"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, 9), (4, 1, 4), (4, 1, 4), (5, 1, 5), (9, 1, 9)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 9], key=str)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(df, num=5, den=5)


@pytest.mark.parametrize("group", [512, 2])
def test_repeated_passages_equal_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = np.random.default_rng(3)
    shared = [prose(rng, n, 5000) for n in (20, 21, 25, 60)]
    rows = []
    for i in range(60):
        parts = [prose(rng, int(rng.integers(0, 40)), 5000), shared[i % 4] if i % 3 else "", prose(rng, 12, 5000)]
        rows.append((i, " ".join(parts)))
    rows += [(60, "loop " * 100), (61, rows[5][1]), (62, " ".join(shared[3].split()[:19]))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc"]: ([tuple(x) for x in r["repeats"]], [tuple(x) for x in r["surplus"]])
           for r in suffixes.repeated_passages(df, min_words=20, gram=7).collect()}
    assert got == passages(rows, 20)
    left = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(df, min_words=20, gram=7).collect()}
    assert len(left) == len(rows) and left[0] == rows[0][1]
    assert not passages(sorted(left.items()), 20).keys() - {60}


def test_passages_of_awkward_rows(spark):
    long = prose(np.random.default_rng(0), 30, 9000)
    df = awkward(spark, [(None, long, None, None, None), (8, long, None, None, None), (8, long, None, None, None)])
    got = {r["doc"]: (len(r["repeats"]), len(r["surplus"])) for r in suffixes.repeated_passages(df, min_words=20, gram=5).collect()}
    assert got == {8: (1, 0), None: (1, 1)}
    assert suffixes.drop_repeats(df, min_words=20, gram=5).columns == df.columns
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def test_items_found_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([4, 5, 6, 9, 15, 40, 90])] + [(7, None), (8, "")]
    docs = []
    for i in range(80):
        item = items[i % 7][1].split()
        cut = item[: len(item) - int(rng.integers(0, 1 + len(item) // 3))]
        docs.append((i, f"{prose(rng, 30, 3000)} {' '.join(cut).upper()} {prose(rng, int(rng.integers(0, 300)), 3000)}"))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = set()
    for i, t in docs:
        for k, item in items:
            own = shingle_set(item, 5, short=False)
            both = len(own & shingle_set(t, 5, short=False))
            if own and both * 5 >= 4 * len(own):
                want.add((i, k, both, len(own)))
    for size in (decontaminate.BLOCK_SHINGLES, 16):                      # one block, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", size)
        assert {tuple(r) for r in decontaminate.find_items(df, bench).collect()} == want
        kept = decontaminate.drop_contaminated(df, bench)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert len(want) > 20


def test_search_in_awkward_rows(spark):
    df = awkward(spark, [(6, "x a b c d e y", None, None, None)])
    bench = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "A B C D E"), (2, None)], "item_id bigint, text string")
    got = sorted(decontaminate.find_items(df, bench).collect(), key=str)
    assert [tuple(r) for r in got] == [(6, 1, 1, 1), (6, None, 1, 1)]
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns
    assert decontaminate.drop_contaminated(df, bench).count() == df.count() - 1
    assert decontaminate.find_items(df, bench.limit(0)).count() == 0 and decontaminate.find_items(df.limit(0), bench).count() == 0


def test_hot_suffixes_and_text_ids(spark, monkeypatch):
    """Keys and contexts beyond a task's share are split; ids that are texts decide by their own order which copy stays."""
    monkeypatch.setattr(suffixes, "HOT_ROWS", 16)
    monkeypatch.setattr(suffixes, "GROUP", 32)
    rng = np.random.default_rng(12)
    shared = prose(rng, 40)
    texts = [(f"k{chr(97 + i % 26)}{i:03d}", f"{prose(rng, 5)} {shared if i % 3 else prose(rng, 40)} {prose(rng, 5)}") for i in rng.permutation(150).tolist()]
    texts += [("zz", shared), ("aa", shared), (None, shared)]
    df = spark.createDataFrame(texts, "doc_id string, text string").repartition(6)
    got = {r["doc"]: ([tuple(x) for x in r["repeats"]], [tuple(x) for x in r["surplus"]])
           for r in suffixes.repeated_passages(df, min_words=20, gram=7).collect()}
    ordered = sorted(((k is None, k or ""), t) for k, t in texts)
    want = passages([(n, t) for n, (_, t) in enumerate(ordered)], 20)
    assert got == {(None if ordered[n][0][0] else ordered[n][0][1]): v for n, v in want.items()}
    assert got["aa"][1] == [] and got["zz"][1]
