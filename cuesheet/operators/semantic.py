"""Features of line vectors ``(doc_id, pos, vector)``; lines without a vector are null there.

Vectors are summed as whole vectors inside each task, not dimension by dimension, so one partial vector per document
and task is shuffled.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.vectors import as_double, dot, let, unit
from cuesheet.operators.ordering import position_chunk, with_previous


def _present(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vector").isNotNull()).select("doc_id", "pos", as_double(F.col("vector")).alias("vector"))


def semantic_variance(vectors: DataFrame) -> DataFrame:
    """Population variance of each dimension over the lines, averaged over dimensions; 0 below two vectors."""
    stats = _present(vectors).groupBy("doc_id").agg(
        Summarizer.metrics("variance", "count").summary(array_to_vector("vector")).alias("s"))
    spread = vector_to_array(F.col("s.variance"))
    n = F.col("s.count")
    mean = F.aggregate(spread, F.lit(0.0), lambda a, x: a + x) / F.size(spread)
    return stats.select("doc_id", F.when(n < 2, 0.0).otherwise(mean * (n - 1) / n).alias("semantic_variance"))


def pairwise_similarity(vectors: DataFrame) -> DataFrame:
    """Mean cosine over all line pairs in linear time: (|sum u|² - sum |u|²) / (n (n - 1)) with unit vectors u."""
    units = _present(vectors).select("doc_id", unit(F.col("vector")).alias("u"))
    stats = units.withColumn("_sq", dot(F.col("u"), F.col("u"))).groupBy("doc_id").agg(
        Summarizer.metrics("sum").summary(array_to_vector("u")).alias("s"),
        F.sum("_sq").alias("sq"), F.count(F.lit(1)).alias("n"))
    total = vector_to_array(F.col("s.sum"))
    pairs = F.col("n") * (F.col("n") - 1)
    return stats.select("doc_id", F.when(F.col("n") < 2, 0.0).otherwise(
        let(total, lambda t: (dot(t, t) - F.col("sq")) / pairs)).alias("semantic_similarity_score"))


def coherence(vectors: DataFrame) -> DataFrame:
    """Mean cosine of consecutive lines; 0 below two lines. Cut into chunks of positions: vectors are shuffled once."""
    units = _present(vectors).select("doc_id", "pos", unit(F.col("vector")).alias("u"))
    before = with_previous(units, ["doc_id"], ["pos"], "u", "_u", chunk=position_chunk("pos"))
    return before.groupBy("doc_id").agg(
        F.coalesce(F.avg(F.when(F.col("_u").isNotNull(), dot(F.col("u"), F.col("_u")))), F.lit(0.0)).alias("coherence_score"))
