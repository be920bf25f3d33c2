"""Personal data by base patterns and bootstrapped contextual extraction, with built-in functions only.

Base spans come from fixed patterns (e-mail, IP, card, phone) and their checks. They are the seeds of the bootstrap: the two
words left of an entity are a lexical pattern, and pattern and entity an edge of a bipartite graph. The graph also holds the
identifier-like tokens (letters and digits, at least six characters, however long, with a digit) with their patterns. Each round scores

    pattern  = sum of its instances' scores / number of its instances, if that sum is at least `support`
    instance = 1 for a seed, else 1 - product over its patterns of (1 - pattern)

over distinct instances. After `rounds` rounds the patterns of at least `confidence` mark every token they precede as a span
of the kind "ident", unless it overlaps a base span.

The text is read in one pass and never shuffled; the graph is of aggregated (pattern, instance) pairs. Positions are code
points, from the lengths of the pieces between matches. The patterns below are written so that a long run of one character
class is passed once: atomic repeats, and starts only at the beginning of a run or where the last match ended. They match
what the plain forms match.

Defined results: a null text is empty; every row gives one row, null ids too; repeated rows have equal results and count
once in the graph; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A candidate token: a short one is looked for as such, a run of over 64 characters is taken whole and checked afterwards.
IDENT = (r"(?<![\p{L}0-9])(?=(?=[A-Za-z._/-]{0,63}[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{4,62}[A-Za-z0-9](?![\p{L}0-9])|[A-Za-z0-9._/-]{65})"
         r"[A-Za-z0-9]++(?![\p{L}0-9])(?:[._/-]++[A-Za-z0-9]++(?![\p{L}0-9]))*+")
_BLOCK = 256                    # matches whose positions are summed in one array


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nine taken off above nine: the sum ends in 0."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(match, "\\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ident":
        return (F.length(match) >= 6) & (F.length(digits) > 0)
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """array<struct<start, end, kind, value, left>>: the matches of a pattern, `left` being the words before each."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("before"), m.alias("value")))

    def block(b: Column, steps: Column) -> Column:
        mine = F.slice(steps, b * _BLOCK + 1, _BLOCK)
        base = F.aggregate(F.slice(steps, F.lit(1), b * _BLOCK), F.lit(0), lambda s, x: s + F.length(x["before"]) + F.length(x["value"]))
        start = F.struct(base.alias("pos"), F.array().cast("array<int>").alias("out"))
        places = F.aggregate(mine, start, lambda s, x: F.struct(
            (s["pos"] + F.length(x["before"]) + F.length(x["value"])).alias("pos"),
            F.concat(s["out"], F.array(s["pos"] + F.length(x["before"]))).alias("out")))["out"]
        return F.zip_with(mine, places, lambda x, at: F.struct(
            at.alias("start"), (at + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"),
            _context(x["before"]).alias("left")))

    def placed(steps: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: block(b, steps)))

    # a one-element array binds the matches, so that they are computed once
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,left:string>>")
    bound = F.transform(F.array(both), lambda steps: F.when(F.size(steps) == 0, nothing).otherwise(placed(steps)))
    return F.when(hint, F.element_at(bound, 1)).otherwise(nothing)


def _context(before: Column) -> Column:
    """The last two words before a match, in lower case and with digits as 0; empty if they hold no letter."""
    near = F.regexp_extract(F.right(before, F.lit(80)), r"(?:\S+\s+)?\S+\s*$", 0)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(near), "[0-9]", "0"), r"\s+", " "))
    return F.when(words.rlike(r"\p{L}"), words).otherwise("")


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rid, base, tokens): checked base entities by start and kind, and identifier-like tokens, of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hints = {"email": F.instr("text", "@") > 0, "ip": F.instr("text", ".") > 0, "card": F.lit(True), "phone": F.instr("text", "+") > 0}
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), text.alias("text"))
    digit = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    def checked(kind: str) -> Column:
        hint = hints[kind] if kind == "email" else F.col("digit") & hints[kind]
        return F.filter(_found(F.col("text"), kind, PATTERNS[kind], hint), lambda s: _valid(kind, s["value"]))

    has = {k: checked(k) for k in KINDS}
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    keyed = F.transform(F.concat(*has.values()), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"),
                                                                     s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["left"].alias("left")))
    tokens = F.filter(_found(F.col("text"), "ident", IDENT, F.col("digit")), lambda s: _valid("ident", s["value"]))
    return digit.select("doc", "rid", F.sort_array(keyed).alias("base"), tokens.alias("tokens"))


def confident_patterns(found: DataFrame, support: float, confidence: float, rounds: int) -> DataFrame:
    """(pattern) of the contexts whose score ends at `confidence` or more."""
    seeds = found.select(F.explode("base").alias("m")).select(F.col("m.left").alias("pattern"), F.col("m.value").alias("instance"), F.lit(1).alias("seed"))
    tokens = found.select(F.explode("tokens").alias("m")).select(F.col("m.left").alias("pattern"), F.col("m.value").alias("instance"), F.lit(0).alias("seed"))
    edges = stored(seeds.union(tokens).where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for i in range(rounds):
        patterns = (edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("known"), F.count("*").alias("n"))
                    .where(F.col("known") >= support).select("pattern", (F.col("known") / F.col("n")).alias("score")))
        patterns = stored(patterns, "patterns")
        if i + 1 < rounds:
            missed = F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999999))))
            scores = (edges.join(patterns, "pattern", "left").groupBy("instance")
                      .agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(missed)).alias("score")))
    return patterns.where(F.col("score") >= confidence).select("pattern")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: float = 3.0, confidence: float = 0.8,
         rounds: int = 3) -> DataFrame:
    """One row per document: (doc, base, more), arrays of (start, rank, end, kind, value, left)."""
    found = stored(mentions(docs, id_col, text_col), "mentions")
    patterns = confident_patterns(found, support, confidence, rounds)
    tokens = found.select("rid", "base", F.explode("tokens").alias("m"))
    free = ~F.exists("base", lambda b: (b["start"] < F.col("m.end")) & (F.col("m.start") < b["end"]))
    new = F.struct(F.col("m.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("m.end").alias("end"), F.col("m.kind").alias("kind"),
                   F.col("m.value").alias("value"), F.col("m.left").alias("left"))
    more = (tokens.where(free).join(patterns, F.col("m.left") == F.col("pattern")).groupBy("rid").agg(F.collect_set(new).alias("more")))
    return (found.select("doc", "rid", "base").join(more, "rid", "left")
            .select("doc", "base", F.coalesce("more", F.expr("filter(base, x -> false)")).alias("more")))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
