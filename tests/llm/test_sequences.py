"""Periodic runs, the Merkle manifest and cached token counts against plain definitions and on awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from brute import awkward, prose

from wardatlas.llm import counts, merkle, queries, runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(w, least, times):
    found = {}
    for p in range(1, len(w) // times + 1):
        start = None
        for i in range(len(w) - p + 1):
            if i + p < len(w) and w[i] == w[i + p]:
                start = i if start is None else start
            elif start is not None:
                if i - start + p >= max(least, times * p):
                    found.setdefault((start, i - start + p), p)
                start = None
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_tail(doc, w):
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def periodic(rng, letters):
    out = []
    for _ in range(int(rng.integers(0, 12))):
        piece = [b"%d" % rng.integers(letters) for _ in range(int(rng.integers(1, 6)))]
        out += piece * int(rng.integers(1, 9))
    return out


@pytest.mark.parametrize("least,times", [(6, 4), (6, 3), (9, 5)])
def test_runs_equal_every_period_tried(least, times):
    rng = np.random.default_rng(least * times)
    for _ in range(150):
        texts = [periodic(rng, int(rng.integers(1, 5))) for _ in range(4)]
        assert runs.slice_runs(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_runs_of_hard_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:                                            # a Fibonacci word has as many runs as words, nearly
        a, b = b, b + a
    for w in (b, [b"x"] * 3000, ([b"x"] * 40 + [b"y"]) * 70):
        assert runs.slice_runs([w], 6, 3) == [plain_runs(w, 6, 3)]
    long = ([b"p%d" % i for i in range(5000)] * 5)[:20_001]
    assert runs.slice_runs([long], 6, 4) == [[(0, 20_001, 5000)]]
    assert runs.slice_runs([[b"x"] * 200_000], 6, 4) == [[(0, 200_000, 1)]]


def test_run_query_on_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(w.decode() for w in periodic(rng, 3)), None, None, None) for i in range(20, 80)]
    rows += [(None, "a a\ta a\n a a a b", None, None, None), (90, "A a A a A a A a A a", None, None, None)]
    df = awkward(spark, rows)
    planted = runs.with_planted_tails(df)
    assert planted.columns == df.columns
    got = sorted((repr(r["doc"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(planted).collect())
    want = []
    for r in df.collect():
        w = WORD.findall((r["text"] or "").encode())
        w = w if r["doc_id"] is None else plain_tail(r["doc_id"], w)
        found = plain_runs(w, 6, 4)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        want.append((repr(r["doc_id"]), found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert got == sorted(want)
    assert any(len(f) > 1 for _, f, _ in want) and ("90", [(0, 10, 2)], "A a") in want
    assert runs.periodic_runs(runs.with_planted_tails(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, min_exponent=2)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_paths(leaves):
    """(root, proof of each leaf) of one tree; a proof is a list of (sibling stands left, sibling or None)."""
    paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(where):
            paths[k].append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        where = [at // 2 for at in where]
    return level[0], paths


def plain_manifest(rows, group, order):
    by = {}
    for r in rows:
        by.setdefault(r[group], []).append((r[order] is not None, r[order] or 0, plain_leaf(r)))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_paths([leaf for *_, leaf in sorted(by[g])]) for g in groups}
    root, upper = plain_paths([trees[g][0] for g in groups])
    out = []
    for g, up in zip(groups, upper):
        for (_, key, leaf), path in zip(sorted(by[g]), trees[g][1]):
            out.append((key, leaf, trees[g][0], root, "".join(s for _, s in path + up if s)))
    return sorted(out)


@pytest.mark.parametrize("leaves,group", [(1 << 14, 64), (4, 2), (1, 2)])
def test_manifest_equals_whole_trees(spark, monkeypatch, leaves, group):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "GROUP", group)
    rng = np.random.default_rng(leaves)
    rows = [(int(i), prose(rng, 3), ["en", "de", None, "zż", "a"][min(int(rng.integers(12)), 4)], None if i % 9 == 0 else "s", int(i)) for i in range(61)]
    rows += [(7, "same", "en", "a", 1)] * 5 + [(None, "x", "en", None, None), (None, None, None, None, None), (3, "alone", "xx", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.selectExpr("*", "1 as part", "2 as tree", "3 as at", "4 as digest")
    got = merkle.manifest(df, ["doc_id", "text", "lang", "source", "n_chars"], "lang", "doc_id").collect()
    assert sorted((r["doc"] or 0, r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in got) == plain_manifest(rows, 2, 0)
    assert all(r["folded_root"] == r["root"] for r in got) and len(got) == len(rows)


def test_manifest_of_few_and_changed_rows(spark):
    from pyspark.sql import functions as F
    df = awkward(spark, [(i, f"t{i}", "en", "a", i) for i in range(100, 140)])
    fields = ["doc_id", "text", "n_chars"]
    changed = merkle.digest([F.col("doc_id"), F.col("text"), F.col("n_chars") + 1])
    for r in merkle.manifest(df, fields, "lang", "doc_id", F.when(F.col("doc_id") % 3 == 0, changed)).collect():
        whole = r["doc"] is None or r["doc"] % 3 != 0
        assert (r["folded_root"] == r["root"]) == whole
    one = merkle.manifest(df.where("doc_id = 2"), fields, "lang", "doc_id").collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in one] == [(plain_leaf((2, "", 0)),) * 3 + ("",)]
    assert merkle.manifest(df.limit(0), fields, "lang", "doc_id").count() == 0


def test_fold_tells_left_from_right():
    assert merkle.fold("a", [(False, "b"), (True, "c"), (False, None)]) == h(h("c", h("a", "b")))


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def plain_counts(path):
    """Whole texts through the library, with nothing in between."""
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_and_the_cache_grows(spark, data, tokenizer, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    library = plain_counts(tokenizer)

    def encoder():
        encode = counts.library_encoder(tokenizer)

        def counted(text):
            asked.add(len(text))
            return encode(text)
        return counted

    odd = ["<|endoftext|>", "<|ENDOFTEXT|> a", "x<|startoftext|>y  Z", "H̱a ẖa", "é é É", "İI ıi", "a b c\x1cd", "don't DON'T 's", "ﬁ Ω 가각 가",
           " \t\r\n\x0b\x0c", "A" * 200_000, "ab" * 50_000 + " tail", "1234 ½ ²", "word " * 3000, "🙂🙃 🙂", "́ start"]
    df = awkward(spark, [(200 + i, t, None, None, None) for i, t in enumerate(odd)])
    cache, version = f"{tmp_path}/cache", counts.file_version(tokenizer)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), library([r["text"] or ""])[0]) for r in df.collect()), key=repr)
    got = lambda frame: sorted((tuple(r) for r in counts.token_counts(frame, cache, version, encoder).collect()), key=repr)
    assert got(df) == want
    first, stored = asked.value, spark.read.parquet(cache).count()
    assert first > 0 and stored == spark.read.parquet(cache).select("digest").distinct().count()
    assert got(df) == want and asked.value == first and spark.read.parquet(cache).count() == stored
    more = awkward(spark, [(300, "  Some  WORDS here ", None, None, None), (301, "quite new", None, None, None)])
    assert {r[0]: r[2] for r in got(more)}[301] == library(["quite new"])[0]
    assert spark.read.parquet(cache).count() == stored + 1 and got(df.limit(0)) == []
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r[0]: r[2] for r in got(docs)} == dict(zip(texts, library(list(texts.values()))))
    other = [r["n_tokens"] for r in counts.token_counts(df, cache, "another", lambda: lambda text: [0]).collect()]
    assert sum(other) > 0 and asked.value > first and spark.read.parquet(cache).select("version").distinct().count() == 2


def test_words_are_counted_as_in_whole_texts(monkeypatch, tokenizer):
    """Marks, special strings, contractions and odd spaces, with small pieces and a small memory that forgets all the time."""
    library = plain_counts(tokenizer)
    rng = np.random.default_rng(8)
    texts = ["", " ", "x" * 500, " lead and\t\ttrail \n", "<|endoftext|> a<|startoftext|>b", "\u0301 a \u0301b", "가 ᆨ각 İ I\u0307 H\u0331 ﬁ"]
    texts += ["".join(rng.choice(list("abé \u0301\u00a0\u3000’'s\n\t<|é1İ½"), 400)) for _ in range(60)]
    want = library(texts)
    for size, held in ((1, 2), (7, 20), (64, 1 << 17)):
        monkeypatch.setattr(counts, "PIECE", size)
        monkeypatch.setattr(counts, "WORDS", held)
        words = counts.WordCounts(counts.library_encoder(tokenizer))
        assert [n for t in texts for n in words.of([t])] == want and words.of(texts) == want


def test_new_queries_are_registered():
    assert {"op11_periodic_runs", "op12_merkle_manifest", "op13_token_counts"} <= set(queries.QUERIES)
    assert {"op11_periodic_runs", "op12_merkle_manifest"} <= set(queries.ORACLES)
