"""Cues, lines and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text


def split_documents(docs: DataFrame, doc: str = "doc_id", body: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One raw line per row from documents that hold all their lines in one text."""
    return docs.select(F.col(doc).alias("doc_id"), *keep, F.posexplode(F.split(body, "\n")).alias("pos", "text")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def lines(cues: DataFrame, markup: bool = True) -> DataFrame:
    """Normalised non-blank lines: ``(doc_id, pos, ..., line)``. ``pos`` keeps the order of the source.

    Markup stays in the text unless ``markup=False``.
    """
    body = F.col("text") if markup else text.strip_markup(F.col("text"))
    return cues.withColumn("line", text.normalise_line(body)).where(F.col("line") != "").drop("text")


def document_tokens(line_table: DataFrame) -> DataFrame:
    """Lower-cased tokens, one per row, with the line they come from."""
    return line_table.select("doc_id", "pos", F.explode(text.tokens(F.col("line"))).alias("tok"))


def token_counts(line_table: DataFrame) -> DataFrame:
    """Occurrences of each distinct lower-cased token per document."""
    return document_tokens(line_table).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))
