"""Token counts with a digest cache: only content that no earlier run has counted is encoded, and once.

1. Every text is normalised (below) and named by the SHA-256 of what remains; the cache holds (version, digest, count), where
   the version is the SHA-256 of the tokenizer's file. These rows are narrow: the text stays where it is.
2. The digests are joined to the stored counts of this version. What is missing is made distinct, and one text of each missing
   digest is encoded. Copies meet by digest after a partial step in every task, so a text that fills a third of the table
   is shuffled once a task. Where few digests are missing, their list is broadcast (its size is checked) and texts that the
   cache knows are not shuffled at all.
3. The new counts are appended to the cache, and all documents take theirs by a join on the digest that splits hot digests.

Normalising must not change a count. The tokenizer drops white space and never joins pieces over it, so runs of 0x20 and 0x09-0x0D
become one space, and those at the ends go. It lower-cases; here that is done for ASCII texts without "<|" only, as upper and lower letters
compose differently with marks, and special strings count by their exact letters. `normalise` takes another rule.

A task counts a text as the sum over its words, split at the same white space, and asks the library for words it does not hold: some thousands in one
string, each token going to the word in which its offset lies. Words of up to `WORD_BYTES` bytes are held in two halves of up to `WORDS`; when the
newer is full the older is forgotten. Words of any length are encoded whole.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); every row gives one row, so repeated rows give equal rows; null ids
stay null; an empty table gives none and adds nothing to the cache; other columns are ignored, whatever their names. An append that is cut off
leaves no rows behind; two runs that append the same digest leave equal rows, and reading takes one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardatlas.operators.joins import salted_join

from .frames import small_side, stored

WORDS = 1 << 17                 # words in each half of what a task holds
WORD_BYTES = 64
PIECE = 1 << 15                 # code points that the library gets in one string; a longer word alone
HOT_ROWS = 50_000               # documents of one digest that one task joins
_TEXTS = 64                     # texts whose words are looked up together
_CACHE = "version string, digest binary, n_tokens bigint"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space, none at the ends, and A-Z as a-z where that cannot matter."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    single = F.btrim(F.regexp_replace(plain, "[\\x20\\x09-\\x0D]+", " "))
    ascii_only = (F.octet_length(plain) == F.length(plain)) & ~F.contains(plain, F.lit("<|"))
    return F.when(ascii_only, F.lower(single)).otherwise(single)


class WordCounts:
    """Counts of the tokens of whole texts. `encode` takes a string and gives, for each of its tokens, the code point where it begins."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.new, self.old = encode, {}, {}

    def _learnt(self, words: list[bytes]) -> dict[bytes, int]:
        """Tokens of words that are not held: strings of about `PIECE` code points, words apart by one space."""
        found: dict[bytes, int] = {}
        part, starts, size = [], [], 0
        for word in [*words, None]:
            if part and (word is None or size > PIECE):
                at = np.asarray(self.encode(" ".join(part)), dtype=np.int64)
                n = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(part)).tolist()
                found.update(zip(words[len(found):], n))
                part, starts, size = [], [], 0
            if word is not None:
                part.append(word.decode())
                starts.append(size)
                size += len(part[-1]) + 1
        for word, n in found.items():
            if len(word) <= WORD_BYTES:
                self.new[word] = n
        return found

    def of(self, texts: list[str]) -> list[int]:
        words = [t.encode().split() for t in texts]              # at 0x20 and 0x09-0x0D
        counts, fresh = {}, []
        for word in {w for ws in words for w in ws}:
            n = self.new.get(word)
            if n is None:
                n = self.old.get(word)
                if n is None:
                    fresh.append(word)
                    continue
                self.new[word] = n
            counts[word] = n
        counts |= self._learnt(fresh)
        if len(self.new) > WORDS:
            self.old, self.new = self.new, {}
        return [sum(map(counts.__getitem__, ws)) for ws in words]


def file_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def library_encoder(path: str) -> Callable[[str], list[int]]:
    """Where the tokens of a string begin, as the tokenizers library gives them for its .json file; no begin, end or added special tokens, no truncation, no
    padding; special strings in a text as the library handles them by default."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [begin for begin, _ in tokenizer.encode(text, add_special_tokens=False).offsets]


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a version; no rows where there is no cache yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(_CACHE).parquet(path) if there else spark.createDataFrame([], _CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, version: str, encoder: Callable[[], Callable[[str], list[int]]], id_col: str = "doc_id",
                 text_col: str = "text", *, normalise: Callable[[Column], Column] = normalised) -> DataFrame:
    """(doc, n_bytes, n_tokens) of every row. `cache` is a folder that all share; `encoder` makes, inside a task, the function that
    encodes. It gets words, so the tokenizer must treat white space as a bound, as one that drops it does."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(normalise(F.col(text_col)), 256)).alias("digest")
    rows = stored(docs.select(F.col(id_col).alias("doc"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
                              digest), "digests")
    known = read_cache(spark, cache, version)
    texts = docs.select(digest, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not known.isEmpty():
        missing = stored(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
        texts = texts.join(small_side(missing, 64), "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or WordCounts(encoder())
            n = [k for at in range(0, batch.num_rows, _TEXTS) for k in words.of(batch.column("text").slice(at, _TEXTS).to_pylist())]
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "n_tokens": pa.array(n, type=pa.int64())})

    fresh = texts.dropDuplicates(["digest"]).mapInArrow(count, "digest binary, n_tokens bigint")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return salted_join(rows, read_cache(spark, cache, version), ["digest"], HOT_ROWS, "left").select("doc", "n_bytes", "n_tokens")
