"""Counting features. Everything is measured inside the line's own row and then summed per document, so only one
partial sum per document and task is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.functions.wordlists import INTENSITY_WORDS, STOP_WORDS
from cuesheet.operators import lines as L


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def line_count(line_table: DataFrame) -> DataFrame:
    return line_table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("line_count"))


def word_count(line_table: DataFrame) -> DataFrame:
    return line_table.groupBy("doc_id").agg(F.sum(text.token_count(F.col("line"))).alias("word_count"))


def avg_sentence_length(line_table: DataFrame) -> DataFrame:
    """Tokens per sentence. A break needs white space, which no token holds, so sentences need not be cut out."""
    return line_table.groupBy("doc_id").agg(
        _ratio(F.sum(text.token_count(F.col("line"))), F.sum(text.sentence_count(F.col("line")))).alias("avg_sentence_length"))


def lexical_diversity(line_table: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact distinct tokens over tokens; distinct tokens are merged before they leave a task."""
    return (L.token_counts(line_table) if counts is None else counts).groupBy("doc_id").agg(
        _ratio(F.count(F.lit(1)), F.sum("n")).alias("lexical_diversity"))


def word_share(line_table: DataFrame, words: Sequence[str], name: str) -> DataFrame:
    """Share of tokens that are in a word list."""
    return line_table.select("doc_id", text.tokens(F.col("line")).alias("toks")).groupBy("doc_id").agg(
        _ratio(F.sum(text.count_in(F.col("toks"), words)), F.sum(F.size("toks"))).alias(name))


def stopword_ratio(line_table: DataFrame, words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    return word_share(line_table, words, "stopword_ratio")


def intensity_score(line_table: DataFrame, words: Sequence[str] = tuple(INTENSITY_WORDS)) -> DataFrame:
    return word_share(line_table, words, "intensity_score")


def question_rate(line_table: DataFrame) -> DataFrame:
    return line_table.groupBy("doc_id").agg(
        F.avg(text.has_question(F.col("line")).cast("int")).alias("question_rate"))


def exclamation_rate(line_table: DataFrame) -> DataFrame:
    return line_table.groupBy("doc_id").agg(
        F.avg(text.ends_with_exclamation(F.col("line")).cast("int")).alias("exclamation_rate"))


def lexical_profile(line_table: DataFrame, stop_words: Sequence[str] = tuple(STOP_WORDS),
                    intensity_words: Sequence[str] = tuple(INTENSITY_WORDS)) -> DataFrame:
    """All counting features but the distinct-token one, in a single pass and a single shuffle of sums."""
    toks = F.col("toks")
    measured = line_table.select("doc_id", "line", text.tokens(F.col("line")).alias("toks")).select(
        "doc_id",
        F.size(toks).cast("bigint").alias("w"),
        text.sentence_count(F.col("line")).alias("s"),
        text.count_in(toks, stop_words).alias("stop"),
        text.count_in(toks, intensity_words).alias("intense"),
        text.has_question(F.col("line")).cast("int").alias("q"),
        text.ends_with_exclamation(F.col("line")).cast("int").alias("x"),
    )
    return measured.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("w").alias("word_count"),
        _ratio(F.sum("w"), F.sum("s")).alias("avg_sentence_length"),
        _ratio(F.sum("stop"), F.sum("w")).alias("stopword_ratio"),
        F.avg("q").alias("question_rate"),
        F.avg("x").alias("exclamation_rate"),
        _ratio(F.sum("intense"), F.sum("w")).alias("intensity_score"),
    )
