"""One query for each operator over its whole table, with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardatlas.storage import scratch_path

from . import bpe, counts, decontaminate, html, jaccard, language, lines, merkle, pii, quality, runs, suffixes, topk
from .frames import prepare, small_side

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> tuple[tuple[bytes, ...], str]:
    """(tokens, pattern) of a public vocabulary file, read where it is installed."""
    import public_tokenizers
    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the quality classifier may learn from: crc32 of the id modulo 3 is not 1."""
    marks = labels.select(F.col("doc_id").alias("of"), F.col("quality").alias("mark")).where("of is not null and mark in (0, 1)").distinct()
    rows = docs.where(~language.held_out("doc_id", 3, 1)).select(F.col("doc_id").alias("of"), "text")
    return rows.join(small_side(marks, 64), "of").select("text", F.col("mark").alias("quality"))


# In the twins: words split by the white space of the contract, A-Z in lower case.
_WORDS = """SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\\x20\\x09-\\x0D]+') AS w FROM documents"""


@query("op1_suffix_array_dedup", f"""
WITH words AS ({_WORDS}),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
places AS (SELECT doc_id, i - 1 AS pos, count(*) OVER (PARTITION BY win) AS n, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows),
marked AS (SELECT doc_id, pos, 'r' AS kind FROM places WHERE n > 1 UNION ALL SELECT doc_id, pos, 's' FROM places WHERE n > 1 AND nth > 1),
cut AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, kind ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM marked),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS run FROM cut),
spans AS (SELECT doc_id, kind, min(pos) AS s, max(pos) + 50 AS e FROM runs GROUP BY doc_id, kind, run)
SELECT doc_id, string_agg(CASE WHEN kind = 'r' THEN s || '-' || e END, ',' ORDER BY s) AS repeated,
       coalesce(string_agg(CASE WHEN kind = 's' THEN s || '-' || e END, ',' ORDER BY s), '') AS surplus,
       CAST(sum(CASE WHEN kind = 'r' THEN e - s ELSE 0 END) AS BIGINT) AS n_repeated
FROM spans GROUP BY doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur twice, per document that has any."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select(F.col("doc").alias("doc_id"), text("repeats").alias("repeated"), text("surplus").alias("surplus"),
                        F.aggregate("repeats", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = language.held_out("doc_id", 5, 0)
    prototypes = language.learn(docs.where(~out))
    return (language.predict(docs, prototypes)
            .select(F.col("doc").alias("doc_id"), language.held_out("doc", 5, 0).alias("held_out"), "lang_pred", "score"))


@query("op3_ngram_jaccard_join", f"""
WITH RECURSIVE words AS ({_WORDS}),
shingles AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 4)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
joint AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM joint JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
lowest AS (SELECT x, min(y) AS low FROM reached GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles overlap by 85 hundredths of their union."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op5_line_dedup", """
WITH lines AS (SELECT DISTINCT source, text, line FROM (
    SELECT source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM documents) WHERE line <> ''),
pages AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source),
bad AS (SELECT l.source, l.line FROM lines l JOIN pages p ON p.source IS NOT DISTINCT FROM l.source GROUP BY l.source, l.line, p.n HAVING count(*) >= 5 AND count(*) * 20 > p.n),
sets AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS old,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(s.bad, CAST([] AS VARCHAR[])), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
    FROM documents d LEFT JOIN sets s ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text, coalesce(len(old), 0) AS n_lines,
       coalesce(len(old) - len(kept), 0) AS n_dropped FROM cut""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on more than a twentieth of its source's pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, num=1, den=20, min_pages=5, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


@query("op6_byte_level_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    tokens, pattern = vocabulary()
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokens, pattern).withColumnRenamed("doc", "doc_id")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(labelled(docs, table(spark, sf_dir, "labels")))
    return (quality.score(docs, model)
            .select(F.col("doc").alias("doc_id"), language.held_out("doc", 3, 1).alias("held_out"), "score", "predicted"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and spans of the base kinds, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("doc").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
                        pii.span_list(F.sort_array(F.concat("base", "more"))).alias("spans"))


@query("op9_benchmark_decontamination", f"""
WITH words AS ({_WORDS}),
items AS ({_WORDS.replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')}),
held AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
asked AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)),
sizes AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id)
SELECT h.doc_id, a.item_id, count(*) AS n_shared, s.n AS n_item
FROM held h JOIN asked a ON a.sh = h.sh JOIN sizes s ON s.item_id = a.item_id GROUP BY h.doc_id, a.item_id, s.n HAVING 5 * count(*) >= 4 * s.n""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least four fifths of a benchmark item's 5-word shingles."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, num=4, den=5)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item")


@query("op10_exact_top_k", """
WITH usable AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each query vector."""
    return topk.top_k_of_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.expr("id % 50 = 0"), scale=256.0, k=5)


# In the twins: CRC-32 of the decimal id, by the table of its polynomial.
_CRC = """crc AS (SELECT d.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda s, c: xor(t[xor(s, c) % 256 + 1], s >> 8)), 4294967295) AS h FROM documents d,
    (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t))"""


@query("op11_periodic_runs", f"""
WITH {_CRC},
given AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o FROM crc),
cut AS (SELECT doc_id, o, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM given),
tails AS (SELECT *, 1 + (len(o) - a) // (3 + g % 8) AS p FROM cut),
texts AS (SELECT doc_id, CASE WHEN a IS NULL THEN o ELSE list_transform(range(len(o)), lambda i: o[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM tails),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
fours AS (SELECT doc_id, i, len(w) AS n, array_to_string(w[i + 1:i + 4], ' ') AS four FROM (SELECT doc_id, w, unnest(range(len(w) - 3)) AS i FROM texts WHERE len(w) > 3)),
equal AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM fours x JOIN fours y ON x.doc_id = y.doc_id AND x.four = y.four AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS stretch FROM equal),
stretches AS (SELECT doc_id, p, min(i) AS s, count(*) + 3 + p AS len FROM marked GROUP BY doc_id, p, stretch HAVING count(*) + 3 + p >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, s, len, min(p) AS p FROM stretches GROUP BY doc_id, s, len),
best AS (SELECT doc_id, count(*) AS n, arg_min({{'s': s, 'len': len, 'p': p}}, {{'l': -len, 's': s, 'p': p}}) AS b, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_runs, b.s AS start, b.len AS length, b.p AS period, 1000 * b.len // b.p AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat with a period, per document with planted tails, and the text without repeats."""
    docs = runs.with_planted_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, min_length=6, min_exponent=4)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    row = found.select("doc", "runs", "collapsed", best.alias("b"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"))
    length, period = F.col("b.length"), -F.col("b.col3")
    return row.select(F.col("doc").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("b.col2")).alias("start"), length.alias("length"),
                      period.alias("period"), F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
                      F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE {_CRC},
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN h % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS shown FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (SELECT lang, 0 AS k, i, n, leaf AS d FROM placed
    UNION ALL SELECT lang, k + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, k, i // 2),
tops AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d FROM low WHERE n = 1),
high AS (SELECT 0 AS k, i, n, d FROM tops
    UNION ALL SELECT k + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY k, i // 2),
walk AS (SELECT doc_id, leaf, lang, 0 AS k, i, n, shown AS d, '' AS proof FROM placed
    UNION ALL SELECT doc_id, leaf, w.lang, w.k + 1, w.i // 2, (w.n + 1) // 2,
        sha256(CASE WHEN w.i % 2 = 1 THEN s.d || w.d ELSE w.d || coalesce(s.d, '') END), proof || coalesce(s.d, '')
    FROM walk w LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM w.lang AND s.k = w.k AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (SELECT doc_id, leaf, w.lang, t.d AS subroot, 0 AS k, t.i, t.n, w.d, proof FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL SELECT doc_id, leaf, w.lang, subroot, w.k + 1, w.i // 2, (w.n + 1) // 2,
        sha256(CASE WHEN w.i % 2 = 1 THEN s.d || w.d ELSE w.d || coalesce(s.d, '') END), proof || coalesce(s.d, '')
    FROM climb w LEFT JOIN high s ON s.k = w.k AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, c.d AS folded_root, c.d = r.d AS verified
FROM climb c, (SELECT d FROM high WHERE n = 1) r WHERE c.n = 1""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; the rows that the contract tampers with fail their check."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.digest([F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in fields])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, fields, "lang", "doc_id", F.when(tampered, changed))
    return found.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; a cache of its own, so that a run does not depend on earlier ones."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    found = counts.token_counts(table(spark, sf_dir, "documents"), scratch_path(spark, "token cache"), counts.file_version(path),
                                lambda: counts.library_encoder(path))
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
