"""Line dedup by site-relative frequency: lines that stand on too large a share of a host's pages are dropped.

Pages are grouped by host; a line's share is the number of the host's pages that hold it over the host's pages, and a line
above `num/den` on at least `min_pages` pages is boilerplate. Pages of one host with equal text are one page: copies say
nothing about the site's template. A line counts once per page, without white space at its ends; blank lines never count.

Built-in functions only. The text is not shuffled: counts work on line hashes, partial sums first, so a host with a third of
all pages is summed in many tasks. A host's boilerplate has at most (lines per page) * den / num entries; the table of
hosts is broadcast after its size is measured, and joined by shuffle, which can be split, beyond `BROADCAST_BYTES`.

Defined results: a null text has no lines and stays null; a page may lose all its lines and then has an empty text; pages
with a null host are one host of their own; every row gives one row, so repeated rows give equal rows; an empty table gives none; other columns
pass, but for n_lines and n_dropped where counts are asked for, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, stored

_BLANKS = " \t\r\x0b\x0c"
_HOST, _BOILERPLATE, _HITS = "wardatlas host", "wardatlas boilerplate", "wardatlas hits"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("host "), F.col(host_col).cast("string")), F.lit(""))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, num: int, den: int, min_pages: int) -> DataFrame:
    """(host key, array of line hashes) of the hosts that have boilerplate."""
    rows = pages.select(_host(host_col).alias("host"), F.xxhash64(text_col).alias("page"), F.split(text_col, "\n").alias("lines"))
    filled = F.array_distinct(F.transform(F.filter("lines", lambda x: F.btrim(x, F.lit(_BLANKS)) != ""), _key))
    lines = rows.select("host", "page", F.explode(filled).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    totals = rows.where("lines is not null").groupBy("host").agg(F.count_distinct("page").alias("pages"))
    return (counts.join(totals, "host").where(F.col("n") * den > F.col("pages") * num)
            .groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("boilerplate")))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", *, num: int = 1, den: int = 20,
                     min_pages: int = 5, counts: bool = False) -> DataFrame:
    """The pages, with all their columns and without boilerplate lines; with `counts` also n_lines and n_dropped."""
    found = stored(boilerplate(pages, host_col, text_col, num, den, min_pages)
                   .select(F.col("host").alias(_HOST), F.col("boilerplate").alias(_BOILERPLATE)), "boilerplate")
    size = found.agg(F.sum(F.size(_BOILERPLATE) * 8 + F.length(_HOST) + 64)).first()[0] or 0
    keyed = pages.withColumn(_HOST, _host(host_col)).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, _HOST, "left")
    lines = F.split(text_col, "\n")
    hits = F.when(F.col(_BOILERPLATE).isNotNull(), F.array_intersect(F.transform(lines, _key), F.col(_BOILERPLATE)))
    hit = keyed.withColumn(_HITS, hits)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(_HITS), _key(x)))
    touched = F.col(_HITS).isNotNull() & (F.size(_HITS) > 0)
    out = [F.when(touched, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in pages.columns]
    if counts:
        out = [c for c, name in zip(out, pages.columns) if name not in ("n_lines", "n_dropped")]
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
        out += [n.cast("bigint").alias("n_lines"), F.when(touched, n - F.size(kept)).otherwise(0).cast("bigint").alias("n_dropped")]
    return hit.select(out)
