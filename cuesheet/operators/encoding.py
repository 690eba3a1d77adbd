"""Widening, imputing and encoding of feature tables.

What a step learns from the data (names, medians, modes, categories) is small and checked; rows never leave Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.operators.ordering import exact_medians, value_codes

MAX_KEYS = 10_000


# -- literals of old CSV files --------------------------------------------------------------------------------------

def parse_list(text: Column, of: str = "string") -> Column:
    """List literal to array; an unparsable text gives an empty array."""
    return F.coalesce(F.from_json(text, f"array<{of}>", {"allowSingleQuotes": "true"}), F.array().cast(f"array<{of}>"))


def parse_dict(text: Column, of: str = "double") -> Column:
    return F.coalesce(F.from_json(text, f"map<string,{of}>", {"allowSingleQuotes": "true"}),
                      F.create_map().cast(f"map<string,{of}>"))


# -- widening -------------------------------------------------------------------------------------------------------

def top_values(values: DataFrame, column: str, limit: int) -> DataFrame:
    """Most frequent values, ties in ascending order: counted in each task first, then a bounded top-k."""
    return values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(limit)


def keyword_vocabulary(df: DataFrame, column: str = "tfidf_keywords", max_vocab_size: int = 500) -> list[str]:
    words = df.select(F.explode(column).alias("w")).where(F.col("w").isNotNull())
    return [r["w"] for r in top_values(words, "w", max_vocab_size).collect()]


def multi_hot(df: DataFrame, vocabulary: Sequence[str], column: str = "tfidf_keywords", prefix: str = "kw_") -> DataFrame:
    """One 0/1 column per word in place of the list column; a null list has no word."""
    return df.select("*", *[
        F.coalesce(F.array_contains(column, w), F.lit(False)).cast("int").alias(f"{prefix}{w}") for w in vocabulary
    ]).drop(column)


def map_key_names(df: DataFrame, column: str) -> list[str]:
    keys = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").limit(MAX_KEYS + 1).collect()
    if len(keys) > MAX_KEYS:
        raise ValueError(f"{column} has more than {MAX_KEYS} keys and cannot be widened")
    return [r["k"] for r in keys]


def expand_dict(df: DataFrame, column: str, prefix: str, names: Sequence[str] | None = None) -> DataFrame:
    """One column per key in place of the map; an absent key is null."""
    keys = map_key_names(df, column) if names is None else names
    return df.select("*", *[F.col(column)[k].alias(f"{prefix}_{k}") for k in keys]).drop(column)


def expand_list(df: DataFrame, column: str, prefix: str, length: int | None = None) -> DataFrame:
    """One column per position in place of the list, as many as the longest list has."""
    if length is None:
        length = df.agg(F.max(F.size(column))).first()[0] or 0
        if length > MAX_KEYS:
            raise ValueError(f"{column} has {length} positions and cannot be widened")
    return df.select("*", *[F.get(column, F.lit(i)).alias(f"{prefix}_{i}") for i in range(length)]).drop(column)


def expand_fixed(df: DataFrame, column: str, prefix: str, length: int) -> DataFrame:
    """One column per position; a list of another length, or none, gives zeros."""
    fits = F.size(column) == length
    return df.select("*", *[
        F.when(fits, F.get(column, F.lit(i))).otherwise(F.lit(0.0)).alias(f"{prefix}_{i}") for i in range(length)
    ]).drop(column)


# -- categories -----------------------------------------------------------------------------------------------------

def split_by_type(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Categorical (string) and numeric columns."""
    cols = [(n, t) for n, t in df.dtypes if n not in exclude]
    return [n for n, t in cols if t == "string"], [n for n, t in cols if t != "string"]


def cardinalities(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts, nulls not counted, in one pass over (column, value) pairs.

    A distinct count per column would copy every row once per column and column set; pairs are merged in each task.
    """
    if not columns:
        return {}
    counts = {c: 0 for c in columns}
    counts.update({r["column"]: r["n"] for r in cardinality_table(df, columns).collect()})
    return counts


def cardinality_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (
        df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    )


def apply_codes(df: DataFrame, codes: DataFrame, column: str, spread: Sequence[str] | None = None) -> DataFrame:
    """Replace a column by its codes; null and unseen values become -1."""
    named = codes.withColumnRenamed("code", "_code")
    others = list(spread) if spread else [c for c in df.columns if c != column]
    joined = skew.lookup(df, named, [column], others, "left")
    return joined.withColumn(column, F.coalesce("_code", F.lit(-1)).cast("bigint")).drop("_code").select(*df.columns)


def ordinal_encode(df: DataFrame, column: str, spread: Sequence[str] | None = None) -> DataFrame:
    """Codes of the sorted distinct values from 0; null becomes -1."""
    return apply_codes(df, value_codes(df, column), column, spread)


# -- imputing -------------------------------------------------------------------------------------------------------

def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, ties to the smallest; values are counted per column in one shuffle."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    best = (
        df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    )
    found = {r["column"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill nulls (and NaN in numbers) with one learned value per column; the column keeps its place."""
    types = dict(df.dtypes)
    filled = {}
    for c, v in values.items():
        if v is None:
            continue
        held = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if types[c] != "string" else F.col(c)
        filled[c] = F.coalesce(held, F.lit(v))
    return df.withColumns(filled) if filled else df


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return impute(df, exact_medians(df, columns))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return impute(df, fit_modes(df, columns))


# -- one-hot --------------------------------------------------------------------------------------------------------

def fit_categories(df: DataFrame, column: str, max_card: int = 100) -> list[str]:
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(max_card + 1).collect()
    if len(rows) > max_card:
        raise ValueError(f"{column} has more than {max_card} values; use ordinal codes")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column per known category; an unknown value has zeros everywhere."""
    return df.select("*", *[
        F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{column}_{c}") for c in categories]).drop(column)
