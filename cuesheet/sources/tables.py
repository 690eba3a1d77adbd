"""Feature tables, logs and the other tabular inputs and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.operators.encoding import parse_dict, parse_list


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a part of a small input of few splits before costly per-row work; large inputs stay as they are.

    For a plain scan only: the number of splits is read from the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_feature_csv(spark: SparkSession, path: str, lists: Sequence[str] = ("tfidf_keywords",),
                     number_lists: Sequence[str] = ("topic_distribution",),
                     dicts: Sequence[str] = ("emotion_distribution", "pos_distribution", "tense_distribution"),
                     schema: str | T.StructType | None = None) -> DataFrame:
    """Import an old feature CSV: a byte-order mark is dropped from the first header, literals become arrays and maps.

    Without a schema the column types are found in one extra pass.
    """
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})
    parsed = {c: parse_list(F.col(c)) for c in lists if c in df.columns}
    parsed |= {c: parse_list(F.col(c), "double") for c in number_lists if c in df.columns}
    parsed |= {c: parse_dict(F.col(c)) for c in dicts if c in df.columns}
    return df.withColumns(parsed) if parsed else df


def write_features(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet with native arrays and maps."""
    df.write.mode(mode).parquet(path)


def write_log(df: DataFrame, path: str) -> None:
    """Fold logs and importances as CSV."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that may not have been written yet. Any other trouble with it is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
