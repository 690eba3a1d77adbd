"""Lexicon-based features: sentiment, emotions, word classes, tenses.

Lexicons are DataFrames with one row per word. They are broadcast only after a size check; beyond it the join is a
salted shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.functions.wordlists import PRONOUNS
from cuesheet.operators import lines as L
from cuesheet.operators import skew
from cuesheet.operators.lexical import word_share

# Fine tags that make up each tense.
PAST_TAGS = ("VBD", "VBN")
PRESENT_TAGS = ("VB", "VBP", "VBZ", "VBG")
FUTURE_TAGS = ("MD",)
MAX_EMOTIONS = 1000


def emotion_names(lexicon: DataFrame) -> list[str]:
    """The emotions of a lexicon: they become columns, so their number is checked."""
    names = [r[0] for r in lexicon.select("emotion").where(F.col("emotion").isNotNull()).distinct()
             .orderBy("emotion").limit(MAX_EMOTIONS + 1).collect()]
    if len(names) > MAX_EMOTIONS:
        raise ValueError(f"a lexicon with more than {MAX_EMOTIONS} emotions cannot be widened")
    return names


def pivot_lexicon(lexicon: DataFrame, emotions: Sequence[str] | None = None) -> DataFrame:
    """(word, emotion, value) to one row per word and one int column per emotion, 0 where missing."""
    names = list(emotions) if emotions is not None else emotion_names(lexicon)
    wide = lexicon.groupBy("word").agg(*[
        F.coalesce(F.max(F.when(F.col("emotion") == e, F.col("value"))), F.lit(0)).cast("int").alias(e) for e in names])
    return wide.where(F.col("word").isNotNull())


def _matched(facts: DataFrame, table: DataFrame, spread: Sequence[str]) -> DataFrame:
    return skew.lookup(facts, table.withColumnRenamed("word", "tok"), ["tok"], spread)


def line_polarity(line_table: DataFrame, polarity: DataFrame) -> DataFrame:
    """Mean polarity of the matched words per line, 0 where none matches. ``polarity`` is (word, polarity)."""
    toks = line_table.select("doc_id", "pos", F.explode_outer(text.tokens(F.col("line"))).alias("tok"))
    return _matched(toks, polarity.select("word", "polarity"), ["doc_id", "pos"]).groupBy("doc_id", "pos").agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"))


def sentiment(line_table: DataFrame, polarity: DataFrame) -> DataFrame:
    """Mean and population deviation of line polarity."""
    return line_polarity(line_table, polarity).groupBy("doc_id").agg(
        F.avg("polarity").alias("avg_sentiment"), F.stddev_pop("polarity").alias("sentiment_std"))


def avg_sentiment(line_table: DataFrame, polarity: DataFrame) -> DataFrame:
    return sentiment(line_table, polarity).select("doc_id", "avg_sentiment")


def sentiment_std(line_table: DataFrame, polarity: DataFrame) -> DataFrame:
    return sentiment(line_table, polarity).select("doc_id", "sentiment_std")


def _distinct_words(line_table: DataFrame) -> DataFrame:
    return L.document_tokens(line_table).select("doc_id", "tok").distinct()


def emotion_columns(line_table: DataFrame, lexicon: DataFrame, emotions: Sequence[str] | None = None,
                    prefix: str = "emotion_", counts: DataFrame | None = None) -> DataFrame:
    """Share of each emotion over the distinct words of a document; all 0.0 where nothing matches."""
    names = list(emotions) if emotions is not None else emotion_names(lexicon)
    wide = pivot_lexicon(lexicon, names)
    words = _distinct_words(line_table) if counts is None else counts.select("doc_id", "tok")
    hits = _matched(words, wide, ["doc_id"])
    sums = hits.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.col(f"`{e}`")), F.lit(0)).alias(f"_{e}") for e in names])
    total = sum((F.col(f"`_{e}`") for e in names), F.lit(0))
    return sums.select("doc_id", *[
        F.coalesce(F.col(f"`_{e}`") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(f"{prefix}{e}") for e in names])


def emotion_distribution(line_table: DataFrame, lexicon: DataFrame, emotions: Sequence[str] | None = None,
                         counts: DataFrame | None = None) -> DataFrame:
    """The same shares as a map with every emotion of the lexicon as a key."""
    names = list(emotions) if emotions is not None else emotion_names(lexicon)
    shares = emotion_columns(line_table, lexicon, names, "", counts)
    entries = [x for e in names for x in (F.lit(e), F.col(f"`{e}`"))]
    filled = F.create_map(*entries).cast("map<string,double>")
    return shares.select("doc_id", filled.alias("emotion_distribution"))


def lexicon_coverage(line_table: DataFrame, words: DataFrame) -> DataFrame:
    """How many distinct lexicon words a document holds."""
    marked = words.select("word").distinct().withColumn("_hit", F.lit(1))
    return _matched(_distinct_words(line_table), marked, ["doc_id"]).groupBy("doc_id").agg(
        F.count("_hit").alias("lexicon_words"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def tag_profile(line_table: DataFrame, tags: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Counts behind the grammatical features. ``tags`` is (word, pos, tag): coarse class and fine tag per word.

    Tokens are merged per document before the lookup.
    """
    hits = _matched(L.token_counts(line_table) if counts is None else counts, tags.select("word", F.col("pos").alias("class"), "tag"), ["doc_id"])

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return hits.groupBy("doc_id").agg(
        F.sum("n").alias("tokens"),
        counted(F.col("class") == "NOUN").alias("noun"),
        counted(F.col("class") == "VERB").alias("verb"),
        counted(F.col("class") == "ADJ").alias("adjective"),
        counted(F.col("class") == "PRON").alias("pronoun"),
        counted(F.col("tag").isin(*PAST_TAGS)).alias("past"),
        counted(F.col("tag").isin(*PRESENT_TAGS)).alias("present"),
        counted(F.col("tag").isin(*FUTURE_TAGS)).alias("future"),
    )


def _present_shares(parts: Sequence[str], whole: Column) -> Column:
    """Map of the shares; a part that never occurs has no key, and all keys are 0.0 where the whole is 0."""
    entries = F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).cast("double").alias("value")) for p in parts])
    kept = F.filter(entries, lambda e: (whole == 0) | (e["value"] > 0))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(
        e["key"].alias("key"), F.when(whole == 0, F.lit(0.0)).otherwise(e["value"] / whole).alias("value"))))


def grammar(line_table: DataFrame, tags: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``pos_distribution`` (over all tokens), ``pronoun_usage`` and ``tense_distribution`` (over tensed verbs)."""
    tensed = F.col("past") + F.col("present") + F.col("future")
    return tag_profile(line_table, tags, counts).select(
        "doc_id",
        _present_shares(["noun", "verb", "adjective"], F.col("tokens")).alias("pos_distribution"),
        _share(F.col("pronoun"), F.col("tokens")).alias("pronoun_usage"),
        _present_shares(["past", "present", "future"], tensed).alias("tense_distribution"),
    )


def pos_distribution(line_table: DataFrame, tags: DataFrame) -> DataFrame:
    return grammar(line_table, tags).select("doc_id", "pos_distribution")


def tense_distribution(line_table: DataFrame, tags: DataFrame) -> DataFrame:
    return grammar(line_table, tags).select("doc_id", "tense_distribution")


def pronoun_usage(line_table: DataFrame, words: Sequence[str] = tuple(PRONOUNS)) -> DataFrame:
    """Share of tokens that are pronouns, from a closed word list; no tag table needed."""
    return word_share(line_table, words, "pronoun_usage")
