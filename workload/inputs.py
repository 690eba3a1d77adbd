"""Tables of the benchmark folder in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import lines as L
from cuesheet.sources.tables import read_table, spread


def document_cues(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return L.split_documents(docs)


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines(document_cues(spark, sf))


def timed_cues(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the documents with times by a rule: four seconds apart, every fifth twenty seconds later."""
    start = F.col("pos") * 4000 + F.floor(F.col("pos") / 5).cast("bigint") * 20_000
    return document_cues(spark, sf).withColumn("start_ms", start).withColumn("end_ms", start + 1500)


def line_vectors(line_table: DataFrame) -> DataFrame:
    """Three counts of a line as its vector, over seven: characters, letters a to z, blanks and one."""
    counts = [F.length("line"), F.regexp_count("line", F.lit("[a-z]")), F.regexp_count("line", F.lit(" ")) + 1]
    return line_table.select("doc_id", "pos", F.array(*[c / 7.0 for c in counts]).alias("vector"))


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_table(spark, sf, "benchmark")
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


def polarity(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_words(spark, sf).withColumn("polarity", ((F.length("word") * 7) % 21 - 10) / F.lit(10.0))


def emotions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("word")
    rows = F.array(
        F.struct(F.lit("anger").alias("emotion"), (n % 2 == 0).cast("int").alias("value")),
        F.struct(F.lit("fear").alias("emotion"), (n % 3 == 0).cast("int").alias("value")),
        F.struct(F.lit("joy").alias("emotion"), (n % 5 == 0).cast("int").alias("value")),
        F.struct(F.lit("trust").alias("emotion"),
                 F.when(F.left("word", F.lit(1)).isin(*"aeiou"), F.lit(1)).alias("value")),
    )
    return benchmark_words(spark, sf).select("word", F.inline(rows)).where(F.col("value").isNotNull())


def tags(spark: SparkSession, sf: str) -> DataFrame:
    slot = F.length("word") % 6
    return benchmark_words(spark, sf).select(
        "word",
        F.get(F.array(*map(F.lit, ["NOUN", "VERB", "VERB", "ADJ", "PRON", "AUX"])), slot).alias("pos"),
        F.get(F.array(*map(F.lit, ["NN", "VBD", "VBZ", "JJ", "PRP", "MD"])), slot).alias("tag"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


def event_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))
