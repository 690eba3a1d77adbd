"""Word lexicons: tab-separated (word, emotion, value)."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "word string, emotion string, value int"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Rows that do not have the three columns are dropped; a missing file gives an empty lexicon and a warning."""
    try:
        return spark.read.option("mode", "DROPMALFORMED").csv(path, sep="\t", schema=SCHEMA, quote="").dropna(subset=["word"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        logging.getLogger(__name__).warning("no lexicon at %s: every word counts as unknown", path)
        return spark.createDataFrame([], SCHEMA)
