"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.session import materialise

ROWS_PER_SALT = 1_000_000
BROADCAST_ROWS = 200_000


def hot_keys(counts: DataFrame, keys: Sequence[str], count: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame | None:
    """Every key with more than ``rows_per_salt`` rows and the number of salts it gets, or None where there is none.

    ``counts`` has one row per key. The table stays distributed: it is broadcast behind a check of its size, and joined
    by a shuffle beyond it.
    """
    heavy = materialise(counts.where(F.col(count) > rows_per_salt).select(
        *keys, F.ceil(F.col(count) / rows_per_salt).cast("int").alias("_salts")))
    return None if heavy.isEmpty() else heavy


def _beside(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    return df.join(F.broadcast(hot) if is_small(hot) else hot, list(keys), "left")


def add_salt(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Number the rows of a hot key 0..salts-1 by a hash of ``spread``; every other row gets salt 0."""
    return (
        _beside(df, keys, hot)
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_salts")
    )


def replicate(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """One copy per salt for the hot keys, one copy for the others."""
    return (
        _beside(df, keys, hot)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )


def salted_lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], counts: DataFrame | None, count: str,
                  spread: Sequence[str], how: str = "inner", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join many facts to one table row per key when both are large.

    ``counts`` tells how many facts a key has; None says that no key is hot. Facts of hot keys are spread over salts and
    only the table rows of those keys are copied.
    """
    # "merge" sorts and spills: a wrong size estimate must not turn a large table into a broadcast
    hot = None if counts is None else hot_keys(counts, keys, count, rows_per_salt)
    if hot is None:
        return facts.join(table.hint("merge"), list(keys), how)
    left = add_salt(facts, keys, hot, spread)
    return left.join(replicate(table, keys, hot).hint("merge"), [*keys, "_salt"], how).drop("_salt")


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Checked size: counts at most ``max_rows + 1`` rows."""
    return table.limit(max_rows + 1).count() <= max_rows


def lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join facts to a table with unique keys: broadcast behind a check of its size, salted shuffle beyond it."""
    if is_small(table, max_rows):
        return facts.join(F.broadcast(table), list(keys), how)
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return salted_lookup(facts, table, keys, counts, "_n", spread, how, rows_per_salt)
