"""Text expressions. All of them run in the JVM on one row at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any script, as the inside of a character class.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Words and single punctuation marks; letters with their marks and digits of any script.
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{SPACES}]"
# Terms of the weighting: words of two characters or more.
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"
SENTENCE_BREAK = rf"[.!?][{SPACES}]+"
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
              "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def normalise_line(text: Column) -> Column:
    """Strip, then turn inner line breaks into spaces."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def strip_markup(text: Column) -> Column:
    """Drop ``<i>`` tags, ``{\\an8}`` overrides, music notes; turn ``\\N`` breaks into spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}|♪", ""), r"\\[Nnh]", " ")


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))


def token_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(TOKEN)).cast("bigint")


def sentences(line: Column) -> Column:
    """Sentences of one line: a break is ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(F.regexp_replace(line, f"([.!?])[{SPACES}]+", "$1\x01"), "\x01")


def sentence_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SENTENCE_BREAK)).cast("bigint") + F.lit(1)


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def count_in(words: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*vocabulary))).cast("bigint")


def without(words: Column, vocabulary: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*vocabulary)) if vocabulary else words


def ends_with_exclamation(line: Column) -> Column:
    return strip(line).endswith("!")


def has_question(line: Column) -> Column:
    return F.contains(line, F.lit("?"))
