"""Token counts with a cache of digests.

A text is known by the digest of its content, a count by that digest and the digest of the tokenizer. Counts that the
cache holds are looked up, each distinct text that it lacks is encoded once, and the new counts are appended. The cache
is an ordinary Parquet table with one folder per tokenizer, so a new tokenizer version never meets old counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.session import materialise
from cuesheet.sources.tables import read_if_exists

CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"
SPACE = "▁"
#: Characters of distinct words a task remembers before it starts anew: bounds memory, not results.
REMEMBERED = 1 << 24


def content() -> Column:
    """The normalised content: a null text is empty. Every byte counts for the tokenizer, so nothing else is changed."""
    return F.coalesce("text", F.lit(""))


def content_digest() -> Column:
    return F.unhex(F.sha2(content().cast("binary"), 256))


class PieceCounter:
    """Counts what the sentencepiece library returns for a text, without begin or end tokens.

    No piece of a usual vocabulary has a space mark behind another character. Then no token crosses the border before a
    run of spaces, the count of a text is the sum over its words, and a word needs to be encoded once. A vocabulary with
    such a piece, or a text that the library's normalisation changes by more than the mark, is encoded whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces) and len(self.library.encode("a")) > 0
        self.known: dict[str, int] = {}
        self.remembered = 0

    def words(self, text: str) -> list[str] | None:
        """The words of the normal form without their first space mark; None if the text must be encoded whole."""
        marked = SPACE + text.replace(" ", SPACE)
        if not text or self.library.normalize(text) != marked:
            return None
        if SPACE + SPACE not in marked and not marked.endswith(SPACE):
            return marked[1:].split(SPACE)
        words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]
        return words if all(words) else None  # a lone mark cannot be had from the library by itself

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) if self.by_word else None for t in texts]
        new = list({w for words in cut if words for w in words} - self.known.keys())
        if self.remembered > REMEMBERED:
            new = list({w for words in cut if words for w in words})
            self.known, self.remembered = {}, 0
        self.known.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        self.remembered += sum(map(len, new))
        return [len(self.library.encode(t, num_threads=1)) if words is None else sum(map(self.known.__getitem__, words))
                for t, words in zip(texts, cut, strict=True)]


def encode(texts: DataFrame, model: bytes) -> DataFrame:
    """``(digest, n_tokens)`` from ``(digest, text)``."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_pydict({
                    "digest": part.column("digest"),
                    "n_tokens": pa.array(counter(part.column("text").to_pylist()), pa.int64())})

    return texts.select("digest", "text").mapInArrow(counts, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One row per digest. Two jobs that appended the same text at once have written the same count."""
    found = read_if_exists(spark, path, CACHE_SCHEMA).where(F.col("tokenizer") == tokenizer)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, cache: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``documents``; the cache gains all counts it lacked.

    ``model_path`` is a sentencepiece model; its bytes are read here and sent to the tasks, and their digest is the
    tokenizer's version. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and equal texts get the same
    counts; no rows give no rows; columns other than doc_id and text are ignored. Copies are merged by digest and text
    inside each task before anything is shuffled, so a text held by a third of all rows moves once per task.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    version = hashlib.sha256(model).hexdigest()
    distinct = docs.select(content_digest().alias("digest"), content().alias("text")).distinct()
    missing = distinct.join(read_cache(spark, cache, version).hint("merge"), "digest", "left_anti")
    encode(missing, model).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    slim = materialise(docs.select("doc_id", F.octet_length(content()).cast("bigint").alias("n_bytes"),
                                   content_digest().alias("digest")))
    sizes = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    counted = skew.salted_lookup(slim, read_cache(spark, cache, version), ["digest"], sizes, "_n", ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
