"""Tokens, web pages, lines, personal data and vector search."""

import hashlib
import random
import re

import numpy as np
import pytest
from brute import SCHEMA, awkward
from pyspark.sql import functions as F

from wardatlas.llm import bpe, html, lines, pii, queries, topk

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    tokens, pattern = queries.vocabulary()
    own = bpe.Codec(tokens, pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_tokens_equal_the_library(codec):
    own, library = codec
    random.seed(4)
    parts = ["a", "b", "é", "日", "😀", " ", "  ", "\n", "1", "ing", "===", "aaaa", "x" * 30, "́", "the", "'s", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text
        noise = [random.randrange(len(own.transducer.tokens)) for _ in range(8)]
        assert own.decode(noise) == b"".join(own.transducer.tokens[i] for i in noise).decode("utf-8", "replace")


def test_pairs_apart_equal_merging(codec):
    fst = codec[0].transducer
    random.seed(5)
    for _ in range(4000):
        a, b = (random.randrange(len(fst.tokens)) for _ in range(2))
        assert fst._follows(a, b) == (bpe.merge_by_rank(fst.ranks, fst.tokens[a] + fst.tokens[b]) == [a, b])


def test_tables_start_anew_without_a_trace(codec, monkeypatch):
    own, library = codec
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PIECES", 3)
    text = " ".join(f"wordish{i}tion" for i in range(200)) + " " * 5000 + "z" * 5000
    assert own.encode(text) == library.encode_ordinary(text)


def test_streaming_decode_waits_for_characters(codec):
    own = codec[0]
    ids = own.encode("😀日é")
    decoder = bpe.Decoder(own.transducer.tokens)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "😀日é"
    assert decoder.feed(own.encode("😀")[:1]) == "" and decoder.finish() == "�"


def test_round_trip_rows(spark, codec):
    tokens, pattern = queries.vocabulary()
    df = awkward(spark)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.round_trip(df, tokens, pattern).collect()
    assert len(got) == df.count()
    by = {r["doc"]: r for r in got}
    assert by[1]["n_tokens"] == 0 and by[1]["ids_sha256"] == by[2]["ids_sha256"] == sha("")
    assert by[5]["decoded_sha256"] == sha("é" * 3000 + " x")
    ids = bpe.encode(df, tokens, pattern)
    assert ids.columns == [*df.columns, "tokens"] and bpe.round_trip(df.limit(0), tokens, pattern).count() == 0
    back = bpe.decode(ids, tokens)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    with pytest.raises(ValueError):
        bpe.encode(ids, tokens, pattern)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   part<br>second.<p>Caf&eacute; &#233; <i>in</i>line<div class="ad">Buy</div><form><input>Send</form>
<p>Last</p></article><aside>Side</aside><section id="comments"><p>Nice</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more First part second. Café é inline Last"
    plain = "<div id=nav><a href=a>one</a> <a href=b>two</a></div>" + "<p>A long paragraph with many words, and no links at all in it.</p>" * 3 + "<div><a href=c>x</a></div>"
    assert html.main_text(plain) == " ".join(["A long paragraph with many words, and no links at all in it."] * 3)
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("just text") == "just text" and html.main_text("<p>a<b>b</b> c") == "ab c"
    assert html.main_text("<article><p>x" + "<div>" * 3000 + "deep") == "x deep"


LONG = "A long paragraph with many words, and no links at all in it, of the text of the page."


def test_marks_do_not_replace_the_ratio():
    text = "".join(f"<div>{i} {LONG}</div>" for i in range(8))
    want = " ".join(f"{i} {LONG}" for i in range(8))
    card = "<article><h3><a href=x>Other</a></h3><p>Short</p></article>"
    filler = "<div><a href=a>one</a> <a href=b>two</a></div>" * 3
    assert html.main_text(text + filler + card) == html.main_text(card + filler + text) == want
    assert html.main_text(f"<div>by</div><article><h1>T</h1>{text}<p>End</p></article><div>more</div>") == f"T {want} End"


@pytest.mark.parametrize("n", [1, 6, 9, 40])
def test_regions_are_filled(n):
    long, menu = [f"<p>{i} {LONG * 2}</p>" for i in range(8)], "<ul>" + "<li><a href=m>Menu</a></li>" * 6 + "</ul>"
    bare = lambda parts: " ".join(re.sub("<[^>]*>", " ", " ".join(parts)).split())
    for between in (["<h2>Steps</h2>", "<ul>", *[f"<li>item {i}</li>" for i in range(n)], "</ul>"], [f"<p>Short {i}.</p>" for i in range(n)],
                    ["<ul>", *[f"<li><a href=r{i}>source {i}</a></li>" for i in range(n)], "</ul>"]):
        article = ["<h1>Title</h1>", *long[:4], *between, "<h2>More</h2>", *long[4:]]
        assert html.main_text(menu + "".join(article) + menu) == bare(article)


@pytest.mark.parametrize("around", [*[f"<div class='{c}'>" for c in ("content-area no-sidebar", "has-sidebar", "with-sidebar wide", "sidebar", "side", "header", "share", "related",
                                                                     "search", "tags", "legal", "page-header", "comments-open", "newsletter")], "<form>", "<div role=form>", "<form><div id=sidebar><div class=search>"])
def test_names_and_forms_around_the_article(around):
    end = "</form>" if "<form" in around else "</div>"
    body = f"<h1>Title</h1><p>{LONG}</p><div class=ad>Buy</div><form>Send</form><p>{LONG}</p>"
    beside = "<div class=sidebar><p>Side</p></div><section class=comments><article><p>Nice</p></article><article><p>Good</p></article></section>"
    for kind in ("article", "main"):
        page = f"<body><div>Site</div>{around}<{kind}>{body}</{kind}>{beside}{end}{beside}</body>"
        assert html.main_text(page) == f"Title {LONG} {LONG}"
    if "newsletter" not in around:
        assert html.main_text(f"{around}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{end}{beside}") == f"Title {LONG} {LONG}"


def test_names_and_forms_beside_the_article():
    text = f"<p>{LONG}</p>" * 2
    for kind in ("<div class=related>", "<form>", "<div class='left sidebar'>", "<div id=comments>"):
        end = "</form>" if "form" in kind else "</div>"
        for card in ("Small text", "<article>Small card</article>"):
            assert html.main_text(f"<article>{text}</article>{kind}{card}{end}") == f"{LONG} {LONG}"
    talk = f"<div id=comments>{('<article><p>' + LONG * 3 + '</p></article>') * 2}</div>"
    assert html.main_text(f"<article>{text}</article>{talk}") == html.main_text(f"<div>{text}</div>{talk}") == f"{LONG} {LONG}"
    assert html.main_text("<div class=sidebar>" * 20000 + "x") == "x"


def test_ratio_agrees_with_the_marks(data):
    import pyarrow.parquet as pq
    pages = pq.read_table(f"{data}/pages.parquet").column("html").to_pylist()
    kept = whole = same = 0
    for page in pages:
        plain = re.sub(r"(?i)</?(article|main)\b[^>]*>", lambda m: "</div>" if m.group().startswith("</") else "<div>", page)
        a, b = html.main_text(page), html.main_text(plain)
        assert set(b.split()) <= set(a.split())
        kept, whole, same = kept + len(b), whole + len(a), same + (a == b)
    assert kept >= 0.97 * whole and same > len(pages) / 2


def test_smoothing_keeps_a_constant():
    assert np.allclose(html.smoothed(np.full(7, 3.0), 1.0), 3.0)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, None), (None, "v", "<p>a", 1), (2, None, None, None)], "page_id bigint, url string, html string, n int")
    got = html.extract(df)
    assert got.columns == [*df.columns, "text"]
    assert sorted((r["text"] for r in got.collect())) == ["", "", "Title & more First part second. Café é inline Last", "a"]
    assert html.extract(df.limit(0)).count() == 0


def test_boilerplate_by_host(spark):
    rows = [(i, f"Header\nbody {i}\n  Header \n\nshared{i % 3}", None, "a" if i % 2 else None, None) for i in range(40)]
    rows += [(100 + i, "Header\nsame", None, "c", None) for i in range(20)] + [(200, "Header", None, "d", None), (201, None, None, "a", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df, num=1, den=2, min_pages=5, counts=True).collect()}
    assert len(got) == len(rows)
    assert got[1]["text"] == "body 1\n\nshared1" and got[0]["text"] == "body 0\n\nshared0" and got[1]["n_dropped"] == 2
    assert got[100]["text"] == "Header\nsame" and got[200]["text"] == "Header"            # equal pages are one page; few pages say nothing
    assert got[201]["text"] is None and got[201]["n_lines"] == 0


def test_lines_of_awkward_rows(spark, monkeypatch):
    df = awkward(spark)
    assert lines.drop_boilerplate(df).columns == df.columns and lines.drop_boilerplate(df).count() == df.count()
    assert lines.drop_boilerplate(df.limit(0)).count() == 0
    rows = [(i, f"Header\n{i}", None, "a", None) for i in range(10)]
    many = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)                                     # the joined way gives the same
    assert sorted(r["text"] for r in lines.drop_boilerplate(many).collect()) == sorted(str(i) for i in range(10))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15}[kind]


def test_base_spans_equal_the_patterns(spark):
    random.seed(11)
    parts = ["a@b.co", "x_y@", ".", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "-", " ", "5500-0000-0000-0004", "+1 (974) 555-3436",
             "+12", "9", "00", "é", "😀", "@", "a", "B-c", "+", "(", "\n", "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0.0.0.0", "007.1.2.3"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 25))), None, None, None) for i in range(400)]
    rows += [(400, "1 " * 20000, None, None, None), (401, "a.b@c.d " * 700, None, None, None), (402, "a" * 100000, None, None, None)]
    got = {r["doc"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if holds(kind, m.group()))
        assert got[i] == [(kind, s, e) for s, _, kind, e in want], text


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"{'lorem ' * (i % 3)}my account 41111111111111{k:02d} ends", None, None, None) for i, k in enumerate(range(100)) if luhn(f"41111111111111{k:02d}")]
    n = len(rows)
    assert n >= 8
    rows += [(200, "see my account AB-12345x here", None, None, None), (201, "the year 1234567 of", None, None, None), (202, "my account 4111111111111111 AB-12345x", None, None, None)]
    got = {r["doc"]: [(s["kind"], s["value"]) for s in r["more"]] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[200] == [("ident", "AB-12345x")] and got[201] == [] and all(not got[i] for i, *_ in rows[:n])


def test_long_identifiers_are_whole(spark):
    rows = [(i, f"my account 41111111111111{k:02d} ends", None, None, None) for i, k in enumerate(range(100)) if luhn(f"41111111111111{k:02d}")]
    keys = ["AB-12345x", "k" * 63 + "1", "k" * 64 + "1", "k" * 300 + "7" + "m" * 300, "eyJhbGciOi." + "Ab9_Cd-" .replace("_", "/") * 40 + "Z.x", "a1" * 50000, "ab-" * 40 + "c5", "x/" * 30000 + "y9"]
    none = ["k" * 65, "ab-" * 40 + "c", "a1-b", "x/" * 30000 + "y", "a" + "-" * 80]
    rows += [(200 + i, f"see my account {k}. here", None, None, None) for i, k in enumerate(keys)]
    rows += [(300 + i, f"see my account {k} 2nd", None, None, None) for i, k in enumerate(none)]
    rows += [(400, "my account foo-12345-ab\u00e9 x", None, None, None), (401, "my account ab\u00e9-123456", None, None, None)]
    got = {r["doc"]: [(s["start"], s["value"]) for s in r["more"]] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, k in enumerate(keys):
        assert got[200 + i] == [(15, k)], k[:80]
    assert all(not got[300 + i] for i in range(len(none))) and got[400] == [(11, "foo-12345")] and got[401] == []


def test_pii_of_awkward_rows(spark):
    df = awkward(spark, [(None, "a@b.co", None, None, None), (7, "+1 (974) 555-3436", None, None, None), (7, "+1 (974) 555-3436", None, None, None)])
    got = sorted(((r["doc"], pii_text(r["base"])) for r in pii.find(df).collect()), key=str)
    assert (None, "email:0:6") in got and got.count((7, "phone:0:17")) == 2 and len(got) == df.count()
    assert pii.find(df.limit(0)).count() == 0


def pii_text(spans):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def best(rows, k):
    want = []
    for q, v in sorted(rows.items()):
        if q % 5 == 0:
            every = sorted(((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in rows.items() if i != q))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(every)]
    return want


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_top_k_equals_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 8)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(300, 12)) * np.exp(rng.normal(size=(300, 1)) * np.log(spread) / 3)
    vecs[50:60] = vecs[49]
    vecs[70] = 0
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(5)
    got = [tuple(r) for r in topk.top_k_of_table(df, "vec_id", "embedding", F.expr("id % 5 = 0"), k=5).orderBy("query_id", "rank").collect()]
    assert got == best({i: [int(np.floor(256 * x)) for x in v] for i, v in data}, 5)


LONG = "A sentence of the article that goes on for quite a while, as the sentences of an article do, and then ends. "


def test_names_inside_an_article():
    """Class names that speak of the subject keep their text; those of comments, adverts, sharing and forms do not."""
    for kept in ("<p class='side-note'>%s</p>", "<div class='legal-analysis'>%s</div>", "<section id='search-results'>%s</section>"):
        assert html.main_text(f"<body><article><p>{LONG}</p>{kept % 'This belongs to it.'}<p>{LONG}</p></article></body>") == " ".join([LONG.strip(), "This belongs to it.", LONG.strip()])
    for gone in ("<section class='user-discussion'>%s</section>", "<div class='reader-feedback'>%s</div>", "<div class='comments'>%s</div>", "<div class='ad-box'>%s</div>",
                 "<div class='share'>%s</div>", "<form>%s</form>", "<div class='search-box'>%s</div>", "<div class='side-bar'>%s</div>", "<aside>%s</aside>"):
        assert html.main_text(f"<body><article><p>{LONG}</p>{gone % 'Not of the article.'}<p>{LONG}</p></article></body>") == " ".join([LONG.strip()] * 2), gone


def test_unmarked_list_page_is_whole():
    items = [f"Item {i}." for i in range(6)]
    body = f"<h1>A title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>The last word.</p>"
    page = f"<html><body><div class='top'><a href='/'>Home</a> <a href='/x'>More</a></div><div id='c'>{body}</div><div class='base'>All rights reserved.</div></body></html>"
    assert html.main_text(page) == " ".join(["A title", *[LONG.strip()] * 3, *items, "The last word."])


def test_long_pieces_stay_within_the_state_bound(monkeypatch):
    """One unbroken piece of many different letters: the tables start anew inside it, and the tokens stay those of the library."""
    import tiktoken
    tokens, pattern = queries.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    monkeypatch.setattr(bpe, "STATES", 2000)
    machine = bpe.Transducer(tokens)
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 60_000))
    assert list(machine.encode(text.encode())) == library.encode_ordinary(text)
    assert len(machine.states) <= 2002 and len(machine.arcs) <= 8002
    assert list(machine.encode(b"hello")) == library.encode_ordinary("hello")


def test_top_k_of_awkward_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 2), (1, [1.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (None, [9.0, 9.0], 1), (6, [], 1),
            (7, [float("inf"), 0.0], 1), (8, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = [tuple(r) for r in topk.top_k_of_table(df, "vec_id", "embedding", F.expr("id % 50 = 0"), k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 5 * 65536), (0, 2, 1, 65536), (0, 3, 6, 0)]
    assert topk.top_k_of_table(df.limit(0), "vec_id", "embedding", F.expr("true")).count() == 0
    alone = topk.top_k_of_table(spark.createDataFrame([(0, [1e300], 1), (1, [1e306], 1)], df.schema), "vec_id", "embedding", F.expr("true"))
    assert alone.count() == 0                                           # 256 * 1e306 is no finite number


def test_top_k_of_large_components(spark, monkeypatch):
    """Components far beyond 32 bits: ranked by the exact products, ties to the smaller id, scores as the nearest bigint."""
    monkeypatch.setattr(topk, "BUCKET", 8)
    rng = np.random.default_rng(6)
    vecs = [[1e9, 1.0], [1e9, 1.0 + 1 / 256], [1e9, 1.0], [-1e9, 3.0], [1e300, -1e300], [1e-5, 0.5], [2.0 ** 40, 2.0 ** 40 + 1], [0.0, 0.0]]
    vecs += [[float(x) for x in v] for v in rng.normal(size=(60, 2)) * 10.0 ** rng.integers(-2, 18, size=(60, 1))]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<double>").repartition(4)
    got = [tuple(r) for r in topk.top_k_of_table(df, "vec_id", "embedding", F.expr("id % 3 = 0"), k=5).orderBy("query_id", "rank").collect()]
    whole = {i: [int(256 * x) if abs(x) > 2.0 ** 50 else int(np.floor(256 * x)) for x in v] for i, v in enumerate(vecs)}
    want = []
    for q in range(0, len(vecs), 3):
        every = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, max(-topk._MOST, min(topk._MOST, -s))) for r, (s, i) in enumerate(every)]
    assert got == want and any(abs(r[3]) == topk._MOST for r in got)
