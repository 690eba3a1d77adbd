"""Order-dependent operators that never sort one key in one task.

Rows are cut into chunks that follow the order. A window runs inside each chunk; what has to pass from one chunk to
the next is one row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.session import materialise

POSITIONS_PER_CHUNK = 65_536


def range_chunks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Cut by sampled range bounds into ``_chunk`` numbers that follow the order.

    The order must be total, so that no two rows tie and any key, however hot, is split evenly. The result is
    materialised because a second sampling could choose other bounds.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id().cast("bigint")))


def position_chunk(position: str, size: int = POSITIONS_PER_CHUNK) -> Column:
    """Chunk number from a position that is unique within its document: a chunk has at most ``size`` rows."""
    return F.floor(F.col(position) / F.lit(size)).cast("bigint")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str,
                  chunk: Column | None = None) -> DataFrame:
    """Add the value of ``column`` in the previous row of the same key, null in the first row."""
    cut = df.withColumn("_chunk", chunk) if chunk is not None else range_chunks(df, [F.col(c) for c in (*keys, *order)])
    boxed = F.struct(F.col(column).alias("v"))
    inside = cut.withColumn("_in_chunk", F.lag(boxed).over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    tails = cut.groupBy(*keys, "_chunk").agg(F.max_by(boxed, F.struct(*order)).alias("_tail"))
    carried = tails.select(*keys, "_chunk", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    return (
        inside.join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_in_chunk", "_carried")["v"])
        .drop("_chunk", "_in_chunk", "_carried")
    )


def with_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column,
                       name: str) -> DataFrame:
    """Add the sum of ``weight`` over this row and all earlier rows of the same key."""
    cut = range_chunks(df.withColumn("_weight", weight), [*(F.col(k) for k in keys), *order])
    inside = cut.withColumn("_inside", F.sum("_weight").over(
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_chunk").agg(F.sum("_weight").alias("_total"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        inside.join(offsets, [*keys, "_chunk"], "left")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_chunk", "_weight", "_inside", "_offset")
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add a 0-based position within each key along a total order."""
    numbered = with_running_total(df, keys, order, F.lit(1).cast("bigint"), name)
    return numbered.withColumn(name, F.col(name) - F.lit(1))


def value_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Distinct non-null values of a column numbered from 0 in ascending order."""
    return with_position(df.select(column).where(F.col(column).isNotNull()).distinct(), [], [F.col(column)], code)


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each numeric column, nulls ignored, for any number of rows and distinct values.

    Values are counted before anything is ordered, so one value held by a third of all rows is one row here. Only the
    one or two middle values per column reach the driver.
    """
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counted = (
        df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_running_total(counted, ["column"], [F.col("value")], F.col("n"), "upto")
    sizes = {r["column"]: r["size"] for r in ranked.groupBy("column").agg(F.max("upto").alias("size")).collect()}
    middles = [
        (F.col("column") == c) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        for c, size in sizes.items() for rank in {(size + 1) // 2, size // 2 + 1}
    ]
    found: dict[str, set[float]] = {}
    if middles:
        for r in ranked.where(reduce(lambda a, b: a | b, middles)).collect():
            found.setdefault(r["column"], set()).add(r["value"])
    return {c: (sum(found[c]) / len(found[c]) if c in found else None) for c in columns}
